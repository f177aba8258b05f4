"""Queries of the behaviour windows, selections and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behaviour as ops
from ..operators import evaluate as ev
from ..operators import select as sel
from .registry import query
from .views import conns, dns, flows, read, scores

SERIES_GAPS = "g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY host, lhour, cat ORDER BY ts) AS gap FROM (SELECT *, floor((ts + 19800) / 86400)::BIGINT AS lhour FROM conns))"


def _windows(spark, sf_dir):
    """Windows of a local day instead of an hour, as the given events are sparse."""
    c = conns(spark, sf_dir)
    return ops.behaviour_windows(c.withColumn("ts", (F.col("ts") + 19_800) / 24)).withColumn("lhour", F.col("lhour"))


DAYS = (
    "w AS (SELECT host, floor((ts + 19800) / 86400)::BIGINT AS lhour, cat, count(*) AS n, ln(1 + sum(up)) AS log_bytes_up, (sum(up) - sum(down)) / (sum(up) + "
    "sum(down) + 1.0) AS egress_asymmetry, count(DISTINCT peer) / count(*) AS distinct_endpoint_ratio, ln(1 + avg(dur)) AS log_duration_mean FROM conns GROUP BY ALL)"
)


#: Windows of a week for a network, whose gaps are enough for the timing features.
WEEKS = """
c AS (SELECT host % 10 AS host, floor(ts / 604800)::BIGINT AS lhour, cat, peer, up, down, dur, ts / 168 AS t FROM conns),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY host, lhour, cat ORDER BY t) AS gap FROM c),
b AS (SELECT host, lhour, cat, count(*) AS n, ln(1 + count(*)) AS log_n_flows, ln(1 + sum(up)) AS log_bytes_up, ln(1 + sum(down)) AS log_bytes_down, (sum(up) - sum(down)) / (sum(up) + sum(down) + 1.0) AS egress_asymmetry,
  count(DISTINCT peer) / count(*) AS distinct_endpoint_ratio, ln(1 + avg(dur)) AS log_duration_mean, stddev_pop(gap) / nullif(avg(gap), 0) AS cv FROM g GROUP BY ALL),
o AS (SELECT host, lhour, cat, gap, row_number() OVER (PARTITION BY host, lhour, cat ORDER BY gap) AS i, row_number() OVER (PARTITION BY host, lhour, cat ORDER BY t) - 1 AS j, count(*) OVER p::DOUBLE AS k, min(gap) OVER p AS lo, max(gap) OVER p AS hi, avg(gap) OVER p AS m
  FROM g WHERE gap IS NOT NULL WINDOW p AS (PARTITION BY host, lhour, cat)),
d AS (SELECT *, (gap - lo) / nullif(hi - lo, 0) AS u, 1 - exp(-gap / nullif(m, 0)) AS e FROM o),
ks AS (SELECT host, lhour, cat, any_value(k) AS k, coalesce(max(greatest(i / k - u, u - (i - 1) / k)), 1.0) AS ks_uniform, coalesce(max(greatest(i / k - e, e - (i - 1) / k)), 1.0) AS ks_exponential FROM d GROUP BY ALL),
x AS (SELECT host, lhour, cat, gap, j, least(k, 128) AS k, avg(gap) OVER (PARTITION BY host, lhour, cat) AS m FROM d WHERE j < 128),
s AS (SELECT host, lhour, cat, any_value(k) AS k, f, sqrt(pow(sum((gap - m) * cos(2 * pi() * f * j / k)), 2) + pow(sum((gap - m) * sin(2 * pi() * f * j / k)), 2)) AS a FROM (SELECT *, unnest(range(1, k::BIGINT // 2 + 1)) AS f FROM x) GROUP BY host, lhour, cat, f),
fp AS (SELECT host, lhour, cat, CASE WHEN avg(a) > 0 THEN least(1.0, max(a) / avg(a) / any_value(k)) ELSE 0 END AS prominence FROM s GROUP BY ALL)"""
AG12_TIMING = {"iat_cv": ("coalesce(cv, 0)", "0.0"), "ks_uniform": ("ks_uniform", "1.0"), "ks_exponential": ("ks_exponential", "1.0"), "fft_prominence": ("coalesce(prominence, 0)", "0.0")}


@query(
    f"WITH {WEEKS} SELECT b.host, b.lhour, b.cat, n, "
    f"{', '.join(f'round(CASE WHEN coalesce(k, 0) >= 4 THEN {a} ELSE {z} END, 6) AS {c}' for c, (a, z) in AG12_TIMING.items())}, "
    f"{', '.join(f'round({c}, 6) AS {c}' for c in ops.FEATURES if c not in AG12_TIMING)} "
    "FROM b LEFT JOIN ks ON b.host = ks.host AND b.lhour = ks.lhour AND b.cat = ks.cat LEFT JOIN fp ON b.host = fp.host AND b.lhour = fp.lhour AND b.cat = fp.cat"
)
def ag12_behaviour_windows(spark, sf_dir):
    """All ten features; an hour of the operator is a week of the given events, which are sparse."""
    c = conns(spark, sf_dir).withColumns({"host": F.col("host") % 10, "ts": F.col("ts") / 168})
    return ops.behaviour_windows(c).select("host", "lhour", "cat", "n", *[F.round(x, 6).alias(x) for x in ops.FEATURES])


@query(
    f"WITH {DAYS} SELECT cat, count(*) AS windows, count(DISTINCT host) AS hosts, count(DISTINCT (host, lhour // 24)) AS host_days, min(lhour) AS first_hour, "
    f"max(lhour) AS last_hour FROM w GROUP BY 1"
)
def ag13_corpus_summary(spark, sf_dir):
    return ops.corpus_summary(_windows(spark, sf_dir))


@query(
    "WITH p AS (SELECT dst, count(DISTINCT src) AS clients, count(*) AS flows FROM flows GROUP BY 1) SELECT *, (SELECT quantile_cont(clients, 0.9) FROM p) AS p90, "
    "(SELECT quantile_cont(clients, 0.99) FROM p) AS p99 FROM p"
)
def ag14_fanin_profile(spark, sf_dir):
    return ops.fanin_profile(flows(spark, sf_dir))


@query(
    "WITH r AS (SELECT DISTINCT host, floor(ts / 86400)::BIGINT AS lhour, cat, peer FROM conns), m AS (SELECT *, min({'l': lhour, 'c': cat}) OVER (PARTITION BY "
    "host, peer) AS fp, min({'l': lhour, 'c': cat}) OVER (PARTITION BY host, cat) AS fc FROM r), "
    "x AS (SELECT host, lhour, cat, CASE WHEN lhour < 19733 THEN fp = {'l': lhour, 'c': cat} ELSE fp.l >= 19733 END AS np, CASE WHEN lhour < 19733 THEN fc = {'l': "
    "lhour, 'c': cat} ELSE fc.l >= 19733 END AS nc FROM m) SELECT host, lhour, cat, round(avg(np::INT), 6) AS peer_novelty, max(nc::INT) AS service_novelty FROM x "
    "GROUP BY ALL"
)
def ag15_novelty(spark, sf_dir):
    rows = conns(spark, sf_dir).withColumn("lhour", F.floor(F.col("ts") / 86_400).cast("long"))
    n = ops.novelty(rows, freeze=19_733)
    return n.select("host", "lhour", "cat", F.round("peer_novelty", 6).alias("peer_novelty"), "service_novelty")


@query(
    f"WITH {DAYS}, c AS (SELECT host, lhour, cat, log_bytes_up AS x, sum(log_bytes_up) OVER (PARTITION BY lhour, cat) AS s, count(*) OVER (PARTITION BY lhour, cat) AS "
    f"k FROM w) SELECT host, lhour, cat, round(CASE WHEN k > 1 THEN (s - x) / (k - 1) ELSE 0 END, 6) AS cohort FROM c"
)
def ag16_cohort(spark, sf_dir):
    return ops.cohort(_windows(spark, sf_dir), "log_bytes_up").select("host", "lhour", "cat", F.round("cohort", 6).alias("cohort"))


@query(f"WITH {DAYS} SELECT host, lhour, cat, round((log_bytes_up - (SELECT avg(log_bytes_up) FROM w)) / (SELECT stddev_pop(log_bytes_up) + 1e-6 FROM w), 6) AS log_bytes_up FROM w")
def ag17_standardise(spark, sf_dir):
    w = _windows(spark, sf_dir)
    s = ops.standardise(w, ops.reference_stats(w, ["log_bytes_up"]), ["log_bytes_up"])
    return s.select("host", "lhour", "cat", F.round("log_bytes_up", 6).alias("log_bytes_up"))


@query("SELECT host, day, max(score) AS score, count(*) AS live, max(attack::INT) AS attack FROM scores GROUP BY ALL")
def ag18_day_scores(spark, sf_dir):
    return ops.day_scores(scores(spark, sf_dir))


@query(
    f"WITH {DAYS} SELECT host, lhour // 24 AS day, count(*) FILTER (WHERE cat = 'click') AS click_n, round(coalesce(avg(log_bytes_up) FILTER (WHERE cat = 'click'), 0), "
    f"6) AS click_mean, round(coalesce(max(log_bytes_up) FILTER (WHERE cat = 'view'), 0), 6) AS view_max FROM w GROUP BY ALL"
)
def ag19_bag_features(spark, sf_dir):
    b = ops.bag_features(_windows(spark, sf_dir), ["log_bytes_up"], ["click", "view", "error", "purchase", "signup"])
    return b.select("host", "day", F.col("click_n"), F.round("click_log_bytes_up_mean", 6).alias("click_mean"), F.round("view_log_bytes_up_max", 6).alias("view_max"))


@query(
    "SELECT event_type AS file, count(*) AS packets, round(avg((dport = 443)::INT), 6) AS tls_share, round(avg((proto = 17)::INT), 6) AS udp_share, "
    "round(avg((bwd_pkts = 0)::INT), 6) AS silent_share, count(DISTINCT src) AS hosts FROM flows GROUP BY 1"
)
def ag20_capture_audit(spark, sf_dir):
    from ..operators.capture import capture_audit

    a = capture_audit(flows(spark, sf_dir).withColumn("file", F.col("event_type")))
    return a.select("file", "packets", *[F.round(c, 6).alias(c) for c in ("tls_share", "udp_share", "silent_share")], "hosts")


def _audited(spark, sf_dir):
    """Packets and DNS messages of five files; some of the web's are QUIC, and some hellos have no readable name."""
    k, p, kind = F.col("k"), F.col("page_id"), F.col("event_type")
    packets = flows(spark, sf_dir).select(
        F.concat(F.lit("f"), k % 5).alias("file"), "dst", "sport", F.when((kind == "view") & (k % 2 == 0), 443).otherwise(F.col("dport")).alias("dport"), "proto",
        (kind == "purchase").alias("hello"), F.when((kind == "purchase") & (k % 4 != 0), F.concat(F.lit("h"), k, F.lit(".example.com"))).alias("sni"),
    )
    first = F.when(p % 9 == 0, "doh.").when(p % 4 == 1, "github.").when(p % 4 == 2, "zoom.us.").otherwise("")
    messages = dns(spark, sf_dir).select(
        F.concat(F.lit("f"), p % 5).alias("file"), "ts", F.concat(first, "name").alias("name"), F.when(F.col("rcode") == 0, F.concat(F.lit("203.0.113."), p % 250)).alias("answer")
    )
    return packets, messages


AUDITED = """p AS (SELECT 'f' || (k % 5) AS file, dst, proto, CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 443 ELSE dport END AS dport, event_type = 'purchase' AS hello,
  CASE WHEN event_type = 'purchase' AND k % 4 <> 0 THEN 'h' || k || '.example.com' END AS sni FROM flows),
m AS (SELECT page_id, 'f' || (page_id % 5) AS file, CASE WHEN page_id % 9 = 0 THEN 'doh.' WHEN page_id % 4 = 1 THEN 'github.' WHEN page_id % 4 = 2 THEN 'zoom.us.' ELSE '' END || name AS name,
  CASE WHEN rcode = 0 THEN '203.0.113.' || (page_id % 250) END AS answer FROM dns),
w AS (SELECT answer AS dst, max_by(name, page_id) AS name FROM m WHERE answer IS NOT NULL GROUP BY 1),
o AS (SELECT file, name FROM p LEFT JOIN w USING (dst) WHERE dst LIKE '203.%')"""


@query(
    f"WITH {AUDITED}, a AS (SELECT file, count(*) AS packets, count(*) FILTER (WHERE proto = 6 AND dport = 443) AS tcp443, count(*) FILTER (WHERE proto = 17 AND dport = 443) AS quic, "
    "count(*) FILTER (WHERE hello) AS hellos, count(sni) AS sni FROM p GROUP BY 1), b AS (SELECT file, count(*) AS queries, count(*) FILTER (WHERE name LIKE 'doh.%') AS doh FROM m GROUP BY 1), "
    "c AS (SELECT file, count(*) AS outside, count(name) AS named FROM o GROUP BY 1) SELECT *, round(coalesce(sni / nullif(hellos, 0), 0), 6) AS sni_share, "
    "round(coalesce(quic / nullif(quic + tcp443, 0), 0), 6) AS quic_share, round(coalesce(doh / nullif(queries, 0), 0), 6) AS doh_share, round(coalesce(named / nullif(outside, 0), 0), 6) AS named_share "
    "FROM a JOIN b USING (file) JOIN c USING (file)"
)
def ag20_packet_audit(spark, sf_dir):
    from ..operators.capture import packet_audit

    a = packet_audit(*_audited(spark, sf_dir))
    return a.withColumns({c: F.round(c, 6) for c in ("sni_share", "quic_share", "doh_share", "named_share")})


@query(
    f"WITH {AUDITED}, c AS (SELECT file, CASE WHEN name LIKE 'github.%' THEN 'Code_Repo_Paste' WHEN name LIKE 'zoom.us.%' THEN 'Messaging_API' WHEN name IS NOT NULL THEN 'Browse' "
    "ELSE 'Unknown_External' END AS category, count(*)::BIGINT AS packets FROM o GROUP BY ALL) SELECT *, round(packets / sum(packets) OVER (PARTITION BY file), 6) AS share FROM c"
)
def ag20_category_histogram(spark, sf_dir):
    from ..operators.capture import category_histogram

    return category_histogram(*_audited(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(
    "WITH m AS (SELECT k % 10 AS mac, count(*) AS n, count(DISTINCT src) AS sources FROM flows GROUP BY 1), c AS (SELECT * FROM m WHERE n >= 0.01 * (SELECT sum(n) "
    "FROM m) ORDER BY sources, mac LIMIT 1) SELECT mac, n, sources FROM c"
)
def ag22_infer_local(spark, sf_dir):
    from ..operators.capture import infer_local

    return infer_local(flows(spark, sf_dir).withColumn("mac", F.col("k") % 10)).select("mac", "n", "sources")


@query(
    "SELECT CASE k % 4 WHEN 0 THEN 'router' WHEN 1 THEN 'audit' WHEN 2 THEN 'incident' ELSE 'commissioning' END AS reason, count(*) AS n, round(count(*) / (SELECT "
    "count(*) FROM flows), 6) AS share FROM flows GROUP BY 1"
)
def ag30_load_report(spark, sf_dir):
    from ..operators.capture import load_report

    names = F.array(*map(F.lit, ["router", "audit", "incident", "commissioning"]))
    r = load_report(flows(spark, sf_dir).withColumn("reason", F.get(names, F.col("k") % 4)))
    return r.withColumn("share", F.round("share", 6))


@query(
    "SELECT round(avg((dport = 443)::INT), 6) AS tls_share, round(avg((k % 2 = 0)::INT), 6) AS named_flow_ratio, max(fwd_bytes) AS snaplen, (max((proto = 17)::INT) = "
    "1) AS quic_readable FROM flows"
)
def ag31_visibility_profile(spark, sf_dir):
    from ..operators.capture import visibility_profile

    p = visibility_profile(flows(spark, sf_dir).withColumn("named", F.col("k") % 2 == 0))
    return p.select(F.round("tls_share", 6).alias("tls_share"), F.round("named_flow_ratio", 6).alias("named_flow_ratio"), "snaplen", "quic_readable")


GATE = "v AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 96 ELSE 128 END AS snaplen, k % 4 <> 1 AS quic, k / 100.0 AS named, (k % 7) / 7.0 AS sni FROM flows)"


@query(
    f"WITH {GATE} SELECT event_id, CASE WHEN snaplen <> 128 OR named > 0.5 * 1.15 THEN 'recommission' WHEN named < 0.25 OR named < 0.5 * 0.85 OR NOT quic THEN "
    f"'refuse' WHEN sni < 0.5 * 0.85 THEN 'warn_and_score' ELSE 'score' END AS action FROM v"
)
def prj24_visibility_gate(spark, sf_dir):
    k = F.col("k")
    v = flows(spark, sf_dir).select(
        "event_id", F.when(k % 10 == 0, 96).otherwise(128).alias("snaplen"), (k % 4 != 1).alias("quic_readable"), (k / 100.0).alias("named_flow_ratio"), ((k % 7) / 7.0).alias("tls_sni_ratio"), F.lit(128).alias("c_snaplen"), F.lit(True).alias("c_quic_readable"),
        F.lit(0.5).alias("c_named_flow_ratio"), F.lit(0.5).alias("c_tls_sni_ratio"),
    )
    return ops.visibility_gate(v).select("event_id", "action")


@query(
    "WITH h AS (SELECT user_id, count(*) AS live, count(DISTINCT floor(ts / 86400)) AS days, max(k) AS refs, avg(value) / 500 AS named FROM flows GROUP BY 1) "
    "SELECT user_id, array_to_string(list_filter([CASE WHEN live < 60 THEN 'live windows' END, CASE WHEN days < 27 THEN 'distinct days' END, CASE WHEN refs < 99 "
    "THEN 'reference samples' END, CASE WHEN named < 0.1 THEN 'named-flow ratio' END, CASE WHEN user_id % 9 = 0 THEN 'incident open' END], lambda x: x IS NOT "
    "NULL), ';') AS blockers FROM h"
)
def prj25_promotion_blockers(spark, sf_dir):
    h = flows(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("live_windows"), F.count_distinct(F.floor(F.col("ts") / 86_400)).alias("distinct_days"), F.max("k").alias("reference_samples"),
        (F.avg("value") / 500).alias("named_flow_ratio"),
    )
    h = h.withColumns({"saw_weekend": F.lit(True), "score_drift": F.lit(0.0), "teacher_disagreement": F.lit(0.0), "incident_open": F.col("user_id") % 9 == 0, "visibility_ok": F.lit(True)})
    return ops.promotion_blockers(h, live=60, days=27, references=99, named=0.1).select("user_id", F.array_join("blockers", ";").alias("blockers"))


TIERS = (
    "t AS (SELECT * FROM (VALUES ('crown_jewel', 1.0, 1.0), ('elevated', 0.2, 0.1), ('standard', 0.05, 0.05), ('bulk', 0.02, 0.05)) t(tier, audit, budget)), hs AS "
    "(SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'crown_jewel' WHEN 1 THEN 'elevated' WHEN 2 THEN 'standard' ELSE 'bulk' END AS tier FROM flows)"
)


def _tiers(spark):
    return spark.createDataFrame(
        [("crown_jewel", 1.0, 1.0, 0.5), ("elevated", 0.2, 0.1, 0.5), ("standard", 0.05, 0.05, 0.5), ("bulk", 0.02, 0.05, 0.5)],
        "tier string, audit double, budget double, p_detect double",
    )


def _tier(col):
    return F.element_at(F.array(*map(F.lit, ["crown_jewel", "elevated", "standard", "bulk"])), (F.col(col) % 4 + 1).cast("int"))


@query(
    f"WITH {TIERS} SELECT tier, count(*) AS hosts, round(sum(least(1.0, audit + budget + 1 / 30)), 6) AS load, round(1 / (max(audit) * 0.5), 6) AS expected_days FROM "
    f"hs JOIN t USING (tier) GROUP BY 1"
)
def prj26_coverage_report(spark, sf_dir):
    hosts = flows(spark, sf_dir).select("user_id").distinct().withColumn("tier", _tier("user_id"))
    c = ops.coverage_report(hosts, _tiers(spark))
    return c.select("tier", "hosts", F.round("load", 6).alias("load"), F.round("expected_days", 6).alias("expected_days"))


@query(
    "WITH l AS (SELECT DISTINCT host, floor(ts / 86400)::BIGINT AS day FROM conns WHERE cat = 'error' AND up > 100000) SELECT conn_id, l.host IS NOT NULL AS attack "
    "FROM conns c LEFT JOIN l ON c.host = l.host AND floor(c.ts / 86400)::BIGINT = l.day"
)
def jn10_label_windows(spark, sf_dir):
    from ..operators.capture import label_windows

    c = conns(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / 86_400))
    labels = c.where("cat = 'error' and up > 100000").select(F.col("host").alias("src"), F.lit(None).cast("long").alias("dst"), "day")
    return label_windows(c, labels, by=["day"]).select("conn_id", "attack")


AUCS = (
    "per AS (SELECT host, score, sum(attack::INT) AS p, sum((NOT attack)::INT) AS q FROM scores GROUP BY ALL), wn AS (SELECT host, p, q, p * (sum(q) OVER (PARTITION "
    "BY host ORDER BY score) - q + q / 2) AS w FROM per), au AS (SELECT host, sum(p) AS n_pos, sum(q) AS n_neg, sum(w) / nullif(sum(p) * sum(q), 0) AS auc FROM wn "
    "GROUP BY 1)"
)


@query(
    "WITH a AS (SELECT host, avg(score) AS a FROM scores WHERE attack GROUP BY 1), b AS (SELECT host, avg(score) AS b FROM scores WHERE NOT attack GROUP BY 1) SELECT "
    "host, round(a, 6) AS a, round(b, 6) AS b FROM a JOIN b USING (host)"
)
def jn11_paired_hosts(spark, sf_dir):
    return ev.paired_hosts(scores(spark, sf_dir))


@query(
    "WITH s AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scores) SELECT (sum(r) FILTER (WHERE attack) - "
    "count(*) FILTER (WHERE attack) * (count(*) FILTER (WHERE attack) + 1) / 2) / (count(*) FILTER (WHERE attack) * count(*) FILTER (WHERE NOT attack)) AS auc FROM s"
)
def ev1_roc_auc(spark, sf_dir):
    return ev.roc_auc(scores(spark, sf_dir)).select("auc")


@query(f"WITH {AUCS} SELECT round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std, count(*) AS hosts, sum(n_pos)::BIGINT AS positives FROM au WHERE n_pos >= 1 AND n_neg >= 5")
def ev2_within_host_auc(spark, sf_dir):
    return ev.within_host_auc(scores(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "hosts", "positives")


@query(
    "WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS i, count(*) OVER () AS n FROM scores), b AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE "
    "AS budget), k AS (SELECT budget, greatest(1, round_even(budget * (SELECT count(*) FROM scores), 0))::BIGINT AS k FROM b) "
    "SELECT budget, k, round(sum(attack::INT) / (SELECT sum(attack::INT) FROM scores), 6) AS attack_recall, round(sum(teacher_flag::INT) / (SELECT "
    "sum(teacher_flag::INT) FROM scores), 6) AS flag_recall FROM k JOIN r ON r.i <= k.k GROUP BY budget, k"
)
def ev3_budget_curve(spark, sf_dir):
    b = ev.budget_curve(scores(spark, sf_dir), [0.01, 0.05, 0.1])
    return b.select("budget", "k", F.round("attack_recall", 6).alias("attack_recall"), F.round("flag_recall", 6).alias("flag_recall"))


@query(
    "WITH g AS (SELECT unnest([100, 300, 500, 700, 900])::DOUBLE AS threshold), h AS (SELECT threshold, sum((score >= threshold)::INT)::BIGINT AS alerts, "
    "sum((score >= threshold AND attack)::INT)::BIGINT AS confirmed, sum(attack::INT) AS pos, count(*) AS n FROM scores, g GROUP BY 1), p AS (SELECT *, CASE WHEN "
    "alerts > 0 THEN confirmed / alerts ELSE 0 END AS pr, confirmed / pos AS re FROM h) "
    "SELECT threshold, alerts, confirmed, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, "
    "6) AS f1, round(1000 * alerts / n, 6) AS per_thousand FROM p"
)
def ev4_threshold_sweep(spark, sf_dir):
    t = ev.threshold_sweep(scores(spark, sf_dir), [100.0, 300.0, 500.0, 700.0, 900.0])
    return t.select("threshold", "alerts", "confirmed", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "per_thousand")])


@query(
    "WITH a AS (SELECT host, avg(score) AS a FROM scores WHERE attack GROUP BY 1), b AS (SELECT host, avg(score) AS b FROM scores WHERE NOT attack GROUP BY 1), d "
    "AS (SELECT round(a, 6) - round(b, 6) AS d FROM a JOIN b USING (host)), s AS (SELECT sum((d > 0)::INT)::INT AS wins, sum((d < 0)::INT)::INT AS losses, avg(d) "
    "AS mean_diff, median(d) AS median_diff FROM d), "
    "t AS (SELECT *, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5))) FROM (SELECT "
    "unnest(range(greatest(wins, losses), wins + losses + 1)) AS i)) AS tail FROM s) SELECT wins, losses, round(mean_diff, 6) AS mean_diff, round(median_diff, 6) "
    "AS median_diff, round(least(1.0, 2 * tail), 6) AS p FROM t"
)
def ev5_sign_test(spark, sf_dir):
    s = ev.sign_test(jn11_paired_hosts(spark, sf_dir))
    return s.select("wins", "losses", *[F.round(c, 6).alias(c) for c in ("mean_diff", "median_diff", "p")])


@query()
def ev6_boot_auc(spark, sf_dir):
    b = ev.boot_auc(scores(spark, sf_dir))
    return b.select(F.round(F.col("ci")[0], 6).alias("low"), F.round(F.col("ci")[1], 6).alias("high"), F.round("mean", 6).alias("mean"))


@query(
    "WITH g AS (SELECT teacher_flag, host, avg(score) AS v FROM scores GROUP BY ALL), s AS (SELECT teacher_flag, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sp, "
    "stddev_samp(v) AS ss FROM g GROUP BY 1) SELECT teacher_flag, n, round(m, 6) AS mean, round(sp, 6) AS std_pop, round(([12.706, 4.303, 3.182, 2.776, 2.571, "
    "2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086])[n - 1]::DOUBLE * ss / sqrt(n), 6) AS half_width "
    "FROM s"
)
def ev7_ci_report(spark, sf_dir):
    g = scores(spark, sf_dir).groupBy("teacher_flag", "host").agg(F.avg("score").alias("v"))
    c = ev.ci_report(g, ["teacher_flag"], "v")
    return c.select("teacher_flag", "n", *[F.round(x, 6).alias(x) for x in ("mean", "std_pop", "half_width")])


@query(
    "WITH r AS (SELECT event_type AS t, CASE WHEN k % 5 = 0 THEN 'click' WHEN k % 7 = 0 THEN 'view' ELSE event_type END AS p FROM flows), s AS (SELECT t AS class, "
    "count(*) AS support, sum((t = p)::INT)::BIGINT AS hits FROM r GROUP BY 1), c AS (SELECT p AS class, count(*) AS called FROM r GROUP BY 1), x AS (SELECT *, "
    "hits / called AS pr, hits / support AS re, (called - hits) / ((SELECT count(*) FROM r) - support) AS fp FROM s JOIN c USING (class)) "
    "SELECT class, support, hits, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, round(fp, 6) AS fpr FROM x"
)
def ev8_classification_report(spark, sf_dir):
    k = F.col("k")
    r = flows(spark, sf_dir).select(F.col("event_type").alias("truth"), F.when(k % 5 == 0, "click").when(k % 7 == 0, "view").otherwise(F.col("event_type")).alias("predicted"))
    return ev.classification_report(r).select("class", "support", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query(
    "WITH o AS (SELECT c_mktsegment = 'BUILDING' AS a, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT x, sum(a::INT) AS na, "
    "sum((NOT a)::INT) AS nb FROM o GROUP BY 1), g AS (SELECT abs(sum(na) OVER (ORDER BY x) / sum(na) OVER () - sum(nb) OVER (ORDER BY x) / sum(nb) OVER ()) AS g "
    "FROM n) "
    "SELECT 'o_totalprice' AS feature, round(avg(x) FILTER (WHERE a), 4) AS mean_a, round(avg(x) FILTER (WHERE NOT a), 4) AS mean_b, round((SELECT max(g) FROM g), 6) AS ks FROM o"
)
def ev9_drift_report(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = ev.drift_report(o.where("c_mktsegment = 'BUILDING'"), o.where("c_mktsegment <> 'BUILDING'"), ["o_totalprice"])
    return d.select("feature", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.round("ks", 6).alias("ks"))


@query(
    "WITH t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM scores WHERE teacher_flag) SELECT round(threshold, 6) AS threshold, round((SELECT avg((score > "
    "threshold)::INT) FROM scores WHERE teacher_flag), 6) AS rate_a, round((SELECT avg((score > threshold)::INT) FROM scores WHERE NOT teacher_flag), 6) AS rate_b "
    "FROM t"
)
def ev10_threshold_transfer(spark, sf_dir):
    s = scores(spark, sf_dir)
    t = ev.threshold_transfer(s.where("teacher_flag"), s.where("not teacher_flag"))
    return t.select(*[F.round(c, 6).alias(c) for c in ("threshold", "rate_a", "rate_b")])


@query(
    "WITH p AS (SELECT src, dst, max(value) AS s FROM flows GROUP BY ALL), g AS (SELECT unnest([50, 100, 200])::DOUBLE AS threshold) SELECT threshold, sum((s >= "
    "threshold)::INT)::BIGINT AS pairs, sum((s >= threshold)::INT) * 24.0 / 720 AS per_day FROM p, g GROUP BY 1"
)
def ev11_beacon_sensitivity(spark, sf_dir):
    return ev.beacon_sensitivity(flows(spark, sf_dir).select("src", "dst", F.col("value").alias("score")), [50.0, 100.0, 200.0], hours=720.0)


@query(
    "WITH x AS (SELECT score, n_chars::DOUBLE AS n FROM scores JOIN documents USING (doc_id)), r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION "
    "BY score) - 1) / 2 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS b FROM x) SELECT round(corr(a, b), 6) AS spearman FROM r"
)
def ev12_spearman(spark, sf_dir):
    x = scores(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n")), "doc_id")
    return ev.spearman(x, "score", "n").select(F.round("spearman", 6).alias("spearman"))


@query(
    f"WITH {DAYS}, p AS (SELECT host, lhour, max((cat = 'click')::INT) AS own, max((cat <> 'click')::INT) AS rest FROM w GROUP BY ALL), s AS (SELECT host, "
    f"unnest(range(min(lhour), max(lhour) + 1)) AS lhour FROM p GROUP BY 1) SELECT host, round(corr(coalesce(own, 0), coalesce(rest, 0)), 6) + 0.0 AS corr, "
    f"count(*) AS hours FROM s LEFT JOIN p USING (host, lhour) GROUP BY 1"
)
def ev13_joint_corr(spark, sf_dir):
    j = ev.joint_corr(_windows(spark, sf_dir), "click")
    return j.select("host", (F.round("corr", 6) + 0.0).alias("corr"), "hours")


@query(
    "SELECT hour, host, count(*) AS n, sum((score > 900)::INT)::BIGINT AS alarms, round(avg((score > 900)::INT), 6) AS rate FROM scores WHERE NOT attack GROUP BY "
    "GROUPING SETS ((hour), (host), ())"
)
def ev14_heldout_report(spark, sf_dir):
    return ev.heldout_report(scores(spark, sf_dir), cut=900.0).withColumn("rate", F.round("rate", 6))


@query(
    "WITH h AS (SELECT host, count(*)::INT AS n, sum((score >= 500)::INT)::INT AS k FROM scores WHERE attack GROUP BY 1), t AS (SELECT host, n, k, unnest(range(k, "
    "n + 1)) AS i FROM h WHERE k > 0) SELECT host, n, k, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.4) + (n - i) * ln(0.6))), 6) "
    "AS p FROM t GROUP BY ALL UNION ALL SELECT host, n, k, 1.0 FROM h WHERE k = 0"
)
def ev15_binomial_check(spark, sf_dir):
    h = scores(spark, sf_dir).where("attack").groupBy("host").agg(F.count("*").cast("int").alias("n"), F.sum((F.col("score") >= 500).cast("int")).cast("int").alias("k"))
    return h.withColumn("p", F.round(ev.binomial_tail(F.col("n"), F.col("k"), 0.4), 6))


HASH = "(('0x' || substr(md5('7|' || {0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(
    f"WITH a AS (SELECT host, bool_or(attack) AS att, count(DISTINCT day) AS days FROM scores GROUP BY 1), r AS (SELECT s.*, att, days, row_number() OVER "
    f"(PARTITION BY s.host ORDER BY {HASH.format('doc_id')}, doc_id) AS i FROM scores s JOIN a USING (host)) SELECT doc_id FROM r WHERE att OR i <= ceil(0.5 * 24 * "
    f"days)"
)
def ev16_thin_to_density(spark, sf_dir):
    return sel.thin_to_density(scores(spark, sf_dir), target=0.5).select("doc_id")


@query(
    f"WITH h AS (SELECT host, day, hour, max(score) AS score FROM scores GROUP BY ALL) SELECT host, day, score, row_number() OVER (PARTITION BY host, day ORDER BY "
    f"{HASH.format("host || '|' || day || '|' || hour")}, hour) - 1 AS hour FROM h"
)
def ev17_permute_hours(spark, sf_dir):
    h = scores(spark, sf_dir).groupBy("host", "day", "hour").agg(F.max("score").alias("score"))
    return sel.permute_hours(h).select("host", "day", "score", F.col("hour").cast("long").alias("hour"))


@query("SELECT doc_id, round(row_number() OVER (PARTITION BY host ORDER BY score, doc_id) / count(*) OVER (PARTITION BY host), 9) AS rank FROM scores")
def win19_host_rank(spark, sf_dir):
    return ops.host_rank(scores(spark, sf_dir)).select("doc_id", F.round("rank", 9).alias("rank"))


@query(
    "WITH m AS (SELECT host, median(score) AS med, count(*) AS n FROM scores GROUP BY 1), d AS (SELECT host, greatest(1e-6, 1.4826 * median(abs(score - med))) AS "
    "mad FROM scores JOIN m USING (host) GROUP BY 1), p AS (SELECT median(score) AS pm FROM scores), q AS (SELECT greatest(1e-6, 1.4826 * median(abs(score - pm))) "
    "AS pd FROM scores, p) "
    "SELECT doc_id, round(CASE WHEN n < 20 THEN (score - pm) / pd ELSE (score - med) / mad END, 6) AS z FROM scores JOIN m USING (host) JOIN d USING (host), p, q"
)
def ml7_host_norm(spark, sf_dir):
    s = scores(spark, sf_dir)
    return ops.apply_host_norm(s, ops.fit_host_norm(s)).select("doc_id", F.round("z", 6).alias("z"))


@query(
    "WITH x AS (SELECT doc_id, host, day, score, hour::DOUBLE AS hour FROM scores), l AS (SELECT host, doc_id, 'score' AS f, score AS x, (doc_id // 20) % 2 = 0 AS "
    "fit FROM x UNION ALL SELECT host, doc_id, 'hour', hour, (doc_id // 20) % 2 = 0 FROM x), m AS (SELECT host, f, median(x) AS med, count(*) AS n FROM l WHERE "
    "fit GROUP BY ALL HAVING count(*) >= 5), "
    "d AS (SELECT l.host, l.f, any_value(med) AS med, 1.4826 * median(abs(x - med)) + 1e-6 AS mad FROM l JOIN m USING (host, f) WHERE fit GROUP BY ALL) SELECT "
    "l.host, doc_id AS id, round(avg(pow((x - med) / mad, 2)), 6) AS distance FROM l JOIN d ON l.host = d.host AND l.f = d.f WHERE NOT fit GROUP BY ALL"
)
def ml6_bag_distance(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("id", F.col("doc_id"))
    return ops.bag_distance(s.where("(doc_id div 20) % 2 = 0"), s.where("(doc_id div 20) % 2 = 1"), ["score", "hour"]).withColumn("distance", F.round("distance", 6))


@query(
    "SELECT doc_id, CASE WHEN count(*) OVER w >= 5 THEN round(quantile_cont(score, 0.9) OVER w, 6) ELSE 'inf'::DOUBLE END AS threshold FROM scores WINDOW w AS "
    "(PARTITION BY host ORDER BY doc_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
)
def win20_rolling_quantile(spark, sf_dir):
    r = ops.rolling_quantile(scores(spark, sf_dir).withColumn("seq", F.col("doc_id")), q=0.9, n=20, least=5)
    return r.select("doc_id", F.round("threshold", 6).alias("threshold"))


@query()
def win21_guarded_threshold(spark, sf_dir):
    f = flows(spark, sf_dir).select(F.col("dst").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("score"), (F.col("k") % 10 != 0).alias("eligible"))
    return ops.guarded_threshold(f, least=50, every=50)


@query(
    "WITH p AS (SELECT src AS host, event_id AS seq, sum((value - 50) / 50 - 0.5) OVER (PARTITION BY src ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p FROM "
    "flows), s AS (SELECT host, seq, p - least(0, min(p) OVER (PARTITION BY host ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS s FROM p) SELECT host, min(seq) AS "
    "alarm_at, round(arg_min(s, seq), 6) AS value FROM s WHERE s > 3 GROUP BY 1"
)
def win22_cusum(spark, sf_dir):
    rows = flows(spark, sf_dir).select(F.col("src").alias("host"), F.col("event_id").alias("seq"), F.col("value").alias("score"))
    return ops.cusum(rows, mu0=50.0, sigma=50.0, h=3.0).withColumn("value", F.round("value", 6))


@query(
    "WITH h AS (SELECT *, ts >= (min(ts) OVER () + max(ts) OVER ()) / 2 AS late FROM flows), s AS (SELECT user_id, ts, event_type AS a, lead(event_type) OVER "
    "(PARTITION BY user_id, late ORDER BY ts, event_id) AS b, late FROM h), p AS (SELECT a, b, count(*) AS n FROM s WHERE NOT late AND b IS NOT NULL GROUP BY "
    "ALL), t AS (SELECT a, sum(n) AS t FROM p GROUP BY 1) "
    "SELECT user_id AS host, round(-avg(ln((coalesce(n, 0) + 1) / (coalesce(t, 0) + 5))), 6) AS surprise FROM s LEFT JOIN p USING (a, b) LEFT JOIN t USING (a) WHERE late AND b IS NOT NULL GROUP BY 1"
)
def win23_markov_surprise(spark, sf_dir):
    """Transitions of the first half of the time span, against those of the second."""
    f = flows(spark, sf_dir)
    middle = f.agg(((F.min("ts") + F.max("ts")) / 2).alias("middle"))  # one row
    rows = f.join(F.broadcast(middle)).select(
        F.col("user_id").alias("host"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("state"), (F.col("ts") >= F.col("middle")).alias("late"),
    )
    return ops.markov_surprise(rows.where("not late"), rows.where("late")).withColumn("surprise", F.round("surprise", 6))


@query(
    "WITH RECURSIVE o AS (SELECT host, floor(ts / 604800)::BIGINT AS day, cat, row_number() OVER (PARTITION BY host, floor(ts / 604800) ORDER BY floor(ts / 3600), "
    "cat) AS i FROM conns), r AS (SELECT host, day, i, (cat = 'view')::INT AS steps FROM o WHERE i = 1 UNION ALL SELECT o.host, o.day, o.i, r.steps + (r.steps < 3 "
    "AND o.cat = (['view', 'click', 'purchase'])[r.steps + 1])::INT FROM r JOIN o ON o.host = r.host AND o.day = r.day AND o.i = r.i + 1) SELECT host, day, "
    "max(steps) AS steps FROM r GROUP BY ALL"
)
def win26_chain_steps(spark, sf_dir):
    w = conns(spark, sf_dir).select("host", F.floor(F.col("ts") / 604_800).alias("day"), F.floor(F.col("ts") / 3600).alias("hour"), "cat")
    return ops.chain_steps(w, ["view", "click", "purchase"])


@query(
    "WITH p AS (SELECT host, day, arg_max(hour, score * 100 - hour) AS hour FROM scores GROUP BY ALL) SELECT host, quantile_cont(hour, 0.25) AS q25, "
    "quantile_cont(hour, 0.5) AS q50, quantile_cont(hour, 0.75) AS q75, count(*) AS days FROM p GROUP BY 1"
)
def win27_trigger_hours(spark, sf_dir):
    t = ops.trigger_hours(scores(spark, sf_dir))
    return t.select("host", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "days")


CT = (
    "cf AS (SELECT event_id, src, dst, sport, dport, ts, 'one' AS sensor, CASE dport WHEN 80 THEN 'http' WHEN 53 THEN 'dns' WHEN 443 THEN 'ssl' WHEN 22 THEN 'ssh' "
    "WHEN 445 THEN 'smb' ELSE 'other' END AS service, CASE WHEN rst > 0 THEN 'RST' WHEN fin > 0 THEN 'FIN' WHEN bwd_pkts = 0 THEN 'REQ' ELSE 'CON' END AS state, k % 4 "
    "AS ttl_bucket FROM flows), ci AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM cf)"
)


@query(
    f"WITH {CT} SELECT a.event_id, count(*) FILTER (WHERE b.service = a.service AND b.src = a.src)::INT AS ct_srv_src, count(*) FILTER (WHERE b.service = a.service AND b.dst = a.dst)::INT AS ct_srv_dst, "
    f"count(*) FILTER (WHERE b.dst = a.dst)::INT AS ct_dst_ltm, count(*) FILTER (WHERE b.src = a.src)::INT AS ct_src_ltm, count(*) FILTER (WHERE b.src = a.src AND b.dport = a.dport)::INT AS ct_src_dport_ltm, "
    f"count(*) FILTER (WHERE b.dst = a.dst AND b.sport = a.sport)::INT AS ct_dst_sport_ltm, count(*) FILTER (WHERE b.dst = a.dst AND b.src = a.src)::INT AS ct_dst_src_ltm, "
    f"count(*) FILTER (WHERE b.state = a.state AND b.ttl_bucket = a.ttl_bucket)::INT AS ct_state_ttl, count(*) FILTER (WHERE b.service = 'http')::INT AS ct_flw_http_mthd "
    f"FROM ci a JOIN ci b ON b.i BETWEEN a.i - 99 AND a.i GROUP BY 1"
)
def win18_ct_features(spark, sf_dir):
    from ..functions import net

    f = flows(spark, sf_dir)
    c = F.col
    f = f.withColumns({"sensor": F.lit("one"), "service": net.port_service(c("dport"), c("proto")), "state": net.conn_state(c("rst"), c("fin"), c("bwd_pkts"), c("fwd_pkts")), "ttl_bucket": c("k") % 4})
    return ops.ct_features(f, n=100).select(
        "event_id", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "ct_state_ttl", "ct_flw_http_mthd"
    )


@query(
    "WITH p AS (SELECT user_id AS host, count(*) AS flows FROM flows GROUP BY 1) SELECT host FROM (SELECT host FROM p ORDER BY flows DESC, host LIMIT 20) UNION SELECT "
    "host FROM p WHERE host IN (SELECT user_id FROM flows WHERE value > 300)"
)
def top5_select_hosts(spark, sf_dir):
    f = flows(spark, sf_dir)
    profile = f.groupBy(F.col("user_id").alias("host")).agg(F.count("*").alias("flows"))
    return sel.select_hosts(profile, f.where("value > 300").select(F.col("user_id").alias("host")).distinct(), n=20)


@query("SELECT doc_id FROM scores QUALIFY row_number() OVER (PARTITION BY day, hour ORDER BY score DESC, host, doc_id) <= greatest(1, round_even(0.1 * count(*) OVER (PARTITION BY day, hour), 0))")
def top6_escalate_hourly(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("host", F.struct("host", "doc_id"))
    return sel.escalate_hourly(s, share=0.1).select("doc_id")


@query(
    "WITH k AS (SELECT greatest(1, round_even(0.05 * count(*), 0))::INT AS k FROM scores), t AS (SELECT host, day, row_number() OVER (ORDER BY score DESC, doc_id) "
    "AS i FROM scores), d AS (SELECT host, day, max(score) AS s FROM scores GROUP BY ALL), x AS (SELECT count(*) AS h, count(DISTINCT (host, day)) AS a FROM t, k "
    "WHERE i <= k), y AS (SELECT greatest(1, round_even(0.05 * count(*), 0))::BIGINT AS b FROM d) SELECT h AS hours, a AS host_days_by_hour, b AS "
    "host_days_by_day, round(a / b, 6) AS scatter FROM x, y"
)
def top7_budget_scatter(spark, sf_dir):
    return sel.budget_scatter(scores(spark, sf_dir)).withColumn("scatter", F.round("scatter", 6))


@query(
    f"WITH {TIERS}, d AS (SELECT DISTINCT user_id AS host, floor(ts / 86400)::BIGINT AS day, CASE user_id % 4 WHEN 0 THEN 'crown_jewel' WHEN 1 THEN 'elevated' WHEN "
    f"2 THEN 'standard' ELSE 'bulk' END AS tier FROM flows) SELECT host, day, tier FROM d JOIN t USING (tier) WHERE {HASH.format("host || '|' || day")} < audit"
)
def top8_audit_sample(spark, sf_dir):
    days = flows(spark, sf_dir).select(F.col("user_id").alias("host"), F.floor(F.col("ts") / 86_400).alias("day")).distinct().withColumn("tier", _tier("host"))
    return sel.audit_sample(days, _tiers(spark)).select("host", "day", "tier")


@query(
    "SELECT event_id, CASE WHEN k % 10 = 0 THEN 'refuse' WHEN k % 10 = 1 THEN 'audit' WHEN k % 10 = 2 THEN 'commissioning' WHEN k % 10 = 3 THEN 'incident' WHEN value "
    ">= 60 THEN 'router' END AS reason FROM flows"
)
def top9_escalate_days(spark, sf_dir):
    k = F.col("k") % 10
    d = flows(spark, sf_dir).withColumns({"refused": k == 0, "audited": k == 1, "state": F.when(k == 2, "COMMISSIONING").otherwise("SENTRY_PRIMARY"), "incident": k == 3, "score": F.col("value")})
    return sel.escalate_days(d, cut=60.0).select("event_id", "reason")


@query(
    "WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT floor(ts / 86400)::BIGINT AS day FROM flows)) SELECT "
    "event_id, i <= floor(n * 0.66) AS train FROM flows JOIN d ON floor(ts / 86400)::BIGINT = day"
)
def top10_temporal_split(spark, sf_dir):
    return sel.temporal_split(flows(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / 86_400)), share=0.66).select("event_id", "train")


@query(
    f"WITH f AS (SELECT event_id AS id, user_id AS family, row_number() OVER (PARTITION BY user_id ORDER BY {HASH.format('event_id')}, event_id) AS i FROM flows) "
    f"SELECT id, floor({HASH.format('family')} * 5)::INT AS fold FROM f WHERE i <= 30"
)
def top11_family_folds(spark, sf_dir):
    rows = flows(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("family"))
    return sel.family_folds(rows, most=30).select("id", "fold")


@query(f"SELECT event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format('event_id')}, event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.8) AS train FROM flows")
def top12_stratified_split(spark, sf_dir):
    return sel.stratified_split(flows(spark, sf_dir).select(F.col("event_id").alias("id"), "event_type"), by="event_type").select("id", "train")


@query("SELECT 'score' AS scorer, doc_id AS id, (SELECT count(*) FROM scores o WHERE o.score > s.score) + 1 AS rank FROM scores s WHERE attack")
def top13_rank_of(spark, sf_dir):
    return sel.rank_of(scores(spark, sf_dir).withColumn("id", F.col("doc_id")), scores=["score"])


NEXT = (
    "CASE WHEN o.c = 'open_incident' THEN 'INCIDENT_HOLD' WHEN o.c = 'release_incident' AND {s} = 'INCIDENT_HOLD' THEN 'RECOMMISSIONING' WHEN o.c = 'mark_stale' AND "
    "{s} <> 'INCIDENT_HOLD' THEN 'RECOMMISSIONING' WHEN o.c = 'escalate' AND {s} = 'SENTRY_PRIMARY' THEN 'ESCALATED' WHEN o.c = 'step' AND {s} = 'ESCALATED' THEN "
    "'SENTRY_PRIMARY' WHEN o.c = 'step' AND o.ready AND {s} IN ('COMMISSIONING', 'RECOMMISSIONING') THEN 'SENTRY_PRIMARY' ELSE {s} END"
)


@query(
    "WITH RECURSIVE o AS (SELECT user_id AS host, event_id AS seq, CASE event_type WHEN 'click' THEN 'step' WHEN 'view' THEN 'escalate' WHEN 'purchase' THEN "
    "'open_incident' WHEN 'signup' THEN 'release_incident' ELSE 'mark_stale' END AS c, k % 2 = 0 AS ready, row_number() OVER (PARTITION BY user_id ORDER BY "
    "event_id) AS i FROM flows), "
    f"r AS (SELECT host, seq, i, {NEXT.format(s="'COMMISSIONING'")} AS state FROM o WHERE i = 1 UNION ALL SELECT o.host, o.seq, o.i, {NEXT.format(s='r.state')} "
    f"FROM r JOIN o ON o.host = r.host AND o.i = r.i + 1) SELECT host, seq, state FROM r"
)
def stm8_lifecycle_batch(spark, sf_dir):
    kinds = {"click": "step", "view": "escalate", "purchase": "open_incident", "signup": "release_incident", "error": "mark_stale"}
    from ..functions import net

    e = flows(spark, sf_dir).select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), net.lookup(kinds, F.col("event_type")).alias("command"), (F.col("k") % 2 == 0).alias("ready"))
    return ops.lifecycle(e)

"""Queries of the session, scan, flood, DNS, beacon, exfiltration and TLS operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net, stats
from ..operators import beacon, dns as dns_ops, enrich, flood, scan, sessions
from .registry import query
from .views import conns, dense, dns, flows, packets, read, wired

DAY = 86_400


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- joins


@query(
    "WITH names AS (SELECT event_id AS uid, 's' || k AS server_name FROM flows WHERE event_type = 'purchase' AND k % 3 <> 0), a AS (SELECT dst AS peer, ts, 'n' || "
    "event_id AS name FROM flows WHERE event_type = 'view'), "
    "c AS (SELECT f.event_id, f.dst AS peer, f.ts, a.name FROM flows f ASOF LEFT JOIN a ON f.dst = a.peer AND f.ts >= a.ts) "
    "SELECT event_id, coalesce(server_name, name, peer) AS name, CASE WHEN server_name IS NOT NULL THEN 'server' WHEN name IS NOT NULL THEN 'dns' ELSE 'address' "
    "END AS named_by FROM c LEFT JOIN names n ON c.event_id = n.uid"
)
def jn1_server_name(spark, sf_dir):
    """Server names of purchases, some of them sent twice; answers from views."""
    f = flows(spark, sf_dir).select("event_id", "event_type", "k", "ts", F.col("dst").alias("peer"), F.col("event_id").alias("uid"))
    bought = f.where("event_type = 'purchase'")
    names = bought.where("k % 3 <> 0").select("uid", F.concat(F.lit("s"), "k").alias("server_name"), "event_id")
    names = names.unionByName(bought.select("uid", F.when(F.col("k") % 3 == 0, "").otherwise("early").alias("server_name"), (F.col("event_id") - 1).alias("event_id")))
    answers = f.where("event_type = 'view'").select("peer", "ts", F.concat(F.lit("n"), "event_id").alias("name"))
    return enrich.name_connections(f.select("event_id", "uid", "peer", "ts"), names, answers).select("event_id", "name", "named_by")


@query(
    "WITH a AS (SELECT dst AS peer, ts, 'n' || event_id AS name FROM flows WHERE event_type = 'view'), c AS (SELECT event_id, dst AS peer, ts FROM flows WHERE "
    "event_type <> 'view') SELECT c.event_id, c.peer, a.name FROM c ASOF LEFT JOIN a ON c.peer = a.peer AND c.ts >= a.ts"
)
def jn2_asof_dns_name(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("peer", F.col("dst"))
    answers = f.where("event_type = 'view'").select("peer", "ts", F.concat(F.lit("n"), "event_id").alias("name"))
    return enrich.asof_names(f.where("event_type <> 'view'").select("event_id", "peer", "ts"), answers).select("event_id", "peer", "name")


@query(
    "SELECT threat_class, any_value(CASE threat_class WHEN 'DDoS' THEN 'T1498' WHEN 'C2 Beacon' THEN 'T1071' WHEN 'DGA' THEN 'T1568' WHEN 'Port Scan' THEN 'T1046' "
    "ELSE 'T1048' END) AS technique, count(*) AS n FROM alerts GROUP BY 1"
)
def jn3_lookup(spark, sf_dir):
    from ..operators.alerts import map_mitre
    from .views import alerts

    return map_mitre(alerts(spark, sf_dir)).groupBy("threat_class").agg(F.any_value("technique").alias("technique"), F.count("*").alias("n"))


@query(
    "WITH f AS (SELECT event_id, 'j4-' || (k % 10) AS ja4, 'j3-' || (k % 7) AS ja3, 's-' || (k % 5) AS ja3s FROM flows) SELECT event_id, CASE WHEN ja4 = 'j4-3' "
    "THEN 'A' WHEN ja3 = 'j3-2' THEN 'B' ELSE 'C' END AS blocked_as, CASE WHEN ja4 = 'j4-3' THEN 'ja4' WHEN ja3 = 'j3-2' THEN 'ja3' ELSE 'ja3s' END AS blocked_by "
    "FROM f WHERE ja4 = 'j4-3' OR ja3 = 'j3-2' OR ja3s = 's-1'"
)
def jn4_blocklist_hits(spark, sf_dir):
    k = F.col("k")
    f = flows(spark, sf_dir).select("event_id", F.concat(F.lit("j4-"), k % 10).alias("ja4"), F.concat(F.lit("j3-"), k % 7).alias("ja3"), F.concat(F.lit("s-"), k % 5).alias("ja3s"))
    listed = spark.createDataFrame([("J4-3", "A"), ("j3-2", "B"), ("s-1", "C")], "fingerprint string, label string")
    return enrich.blocklist_hits(f, listed).select("event_id", "blocked_as", "blocked_by")


EVENTS = """
t AS (SELECT src, floor(ts / 86400)::BIGINT * 86400 AS window_start, dst, dport, count(*) AS n, max((proto = 6 AND syn > 0 AND rst > 0 AND NOT (ack > 0 AND bwd_pkts > 0))::INT) AS rst, min((bwd_pkts > 0)::INT) AS answered FROM flows GROUP BY ALL),
known AS (SELECT '192.168.10.' || i AS host FROM range(0, 15) r(i)), opened AS (SELECT '192.168.10.' || i AS host, p AS port FROM range(0, 5) r(i), (VALUES (80), (443)) v(p)),
m AS (SELECT t.*, (rst = 0 AND answered = 0)::INT AS silent, (dst LIKE '192.168.%' AND dst NOT IN (SELECT host FROM known))::INT AS is_new, (dst IN (SELECT host FROM opened) AND NOT EXISTS (SELECT 1 FROM opened o WHERE o.host = t.dst AND o.port = t.dport))::INT AS closed FROM t),
h AS (SELECT src, window_start, dst, sum(n) AS n, sum(rst) AS rst, sum(silent) AS rwa, max(is_new) AS neip, sum(closed) AS netcp, list(dport) AS ports FROM m GROUP BY ALL),
told AS (SELECT src, floor((ts + 0.5) / 86400)::BIGINT * 86400 AS window_start, count(*) AS icmp_error FROM flows WHERE proto = 17 AND k % 5 < 3 AND k % 16 IN (0, 1, 2, 3, 9, 10, 13) GROUP BY ALL),
ev AS (SELECT * REPLACE (coalesce(icmp_error, 0)::BIGINT AS icmp_error) FROM (SELECT src, window_start, sum(rst)::BIGINT AS rst, sum(rwa)::BIGINT AS rwa, sum(neip)::BIGINT AS neip, sum(netcp)::BIGINT AS netcp, len(list_distinct(flatten(list(ports))))::BIGINT AS ports, count(*) AS hosts, max_by(dst, n::BIGINT * 1000000 + hash_rank) AS top_dst FROM
  (SELECT *, row_number() OVER (PARTITION BY src, window_start ORDER BY dst) AS hash_rank FROM h) GROUP BY ALL) LEFT JOIN told USING (src, window_start))"""


def _icmp(spark, sf_dir):
    """Answers to UDP flows half a second later: errors of all codes, most of which quote the flow's packet."""
    f, k = flows(spark, sf_dir).where("proto = 17"), F.col("k")
    quoted = {f"q_{c}": F.when(k % 2 == 0, F.col(c)) for c in ("src", "dst", "sport", "dport", "proto")}
    return f.where(k % 5 < 3).select((F.col("ts") + 0.5).alias("ts"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(3).alias("icmp_type"), (k % 16).alias("icmp_code"), *[c.alias(n) for n, c in quoted.items()], "event_id")


def _events(spark, sf_dir):
    hosts = spark.range(0, 15).select(F.concat(F.lit("192.168.10."), "id").alias("host"))
    ports = spark.range(0, 5).select(F.concat(F.lit("192.168.10."), "id").alias("host"), F.explode(F.array(F.lit(80), F.lit(443))).alias("port"))
    return scan.network_events(flows(spark, sf_dir), known_hosts=hosts, known_ports=ports, icmp=_icmp(spark, sf_dir), seconds=DAY)


@query("SELECT event_id, CASE WHEN k % 2 = 0 THEN event_id END AS cause FROM flows WHERE proto = 17 AND k % 5 < 3")
def ag3_icmp_causes(spark, sf_dir):
    """The flow that each ICMP error is about, from the header that it quotes."""
    return scan.icmp_causes(_icmp(spark, sf_dir), flows(spark, sf_dir)).select("event_id", "cause")


@query(f"WITH {EVENTS} SELECT * FROM ev")
def ag3_network_events(spark, sf_dir):
    return _events(spark, sf_dir)


@query(
    "WITH t AS (SELECT DISTINCT src, floor(ts / 86400)::BIGINT * 86400 AS window_start, dst, dport FROM flows WHERE bwd_pkts = 0), r AS (SELECT DISTINCT src, "
    "floor(ts / 86400)::BIGINT * 86400 AS window_start, dst, dport FROM flows WHERE rst > 0) SELECT * FROM t ANTI JOIN r USING (src, window_start, dst, dport)"
)
def jn5_unanswered_not_reset(spark, sf_dir):
    keyed = flows(spark, sf_dir).withColumn("window_start", scan.window_start("ts", DAY))
    keys = ["src", "window_start", "dst", "dport"]
    return keyed.where("bwd_pkts = 0").select(*keys).distinct().join(keyed.where("rst > 0").select(*keys).distinct(), keys, "left_anti")


@query("WITH h AS (SELECT DISTINCT src, dst FROM flows WHERE dst LIKE '192.168.%'), k AS (SELECT '192.168.10.' || i AS dst FROM range(0, 15) r(i)) SELECT src, dst FROM h ANTI JOIN k USING (dst)")
def jn6_unknown_hosts(spark, sf_dir):
    known = spark.range(0, 15).select(F.concat(F.lit("192.168.10."), "id").alias("dst"))
    pairs = flows(spark, sf_dir).where(net.is_internal(F.col("dst"))).select("src", "dst").distinct()
    return pairs.join(known, "dst", "left_anti").select("src", "dst")


@query("SELECT entity, role, count(*) AS n FROM (SELECT src AS entity, 'src' AS role FROM flows UNION ALL SELECT dst, 'dst' FROM flows) GROUP BY ALL")
def jn7_by_role(spark, sf_dir):
    from ..operators.alerts import by_role

    return by_role(flows(spark, sf_dir).select("src", "dst")).groupBy("entity", "role").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT event_id, src, dst, ts FROM flows WHERE event_type = 'signup'), d AS (SELECT src, dst, ts FROM flows WHERE event_type = 'error') SELECT "
    "event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.dst = s.dst AND d.src = s.src AND abs(d.ts - s.ts) <= 86400)"
)
def jn8_suppress_ddos_scanners(spark, sf_dir):
    f = flows(spark, sf_dir)
    floods = f.where("event_type = 'error'").select("dst", "ts", F.array("src").alias("sources"))
    return scan.suppress_flooding_sources(f.where("event_type = 'signup'"), floods, seconds=DAY).select("event_id")


@query(
    "WITH b AS (SELECT src, dst, count(*) AS n, max(ts) AS last FROM flows WHERE event_type = 'click' GROUP BY ALL), v AS (SELECT src, dst, avg(value) AS verdict "
    "FROM flows WHERE event_type = 'purchase' GROUP BY ALL), h AS (SELECT src, count(*) AS lookups FROM flows WHERE event_type = 'view' GROUP BY 1) SELECT b.src, "
    "b.dst, n, round(verdict, 4) AS verdict, lookups FROM b LEFT JOIN v USING (src, dst) LEFT JOIN h USING (src)"
)
def jn9_attach_evidence(spark, sf_dir):
    from ..operators.alerts import attach_evidence

    f = flows(spark, sf_dir)
    b = f.where("event_type = 'click'").groupBy("src", "dst").agg(F.count("*").alias("n"))
    v = f.where("event_type = 'purchase'").groupBy("src", "dst").agg(F.round(F.avg("value"), 4).alias("verdict"))
    h = f.where("event_type = 'view'").groupBy("src").agg(F.count("*").alias("lookups"))
    return attach_evidence(attach_evidence(b, v, ["src", "dst"]), h, ["src"])


# ---- sessions


def flow_table(probe: int, until: str = "true") -> str:
    """SQL for the flows of the packets for which ``until`` holds: a state is carried from each packet of a key to the next."""
    return (
        "raw AS (SELECT ts, src, dst, 40000 AS sport, dport, proto, syn * 2 + ack * 16 + rst * 4 + fin AS flags, fwd_bytes AS size FROM flows UNION ALL "
        "SELECT ts + 1, dst, src, dport, 40000, proto, 16, bwd_bytes FROM flows WHERE bwd_pkts > 0), "
        "p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, src, sport, flags, size) AS i FROM (SELECT *, least(src || '|' || sport, dst || '|' || dport) || '|' || "
        f"greatest(src || '|' || sport, dst || '|' || dport) || '|' || proto AS key FROM raw) WHERE {until}), "
        "x AS (SELECT key, 0::BIGINT AS i, NULL::DOUBLE AS ts, -1 AS flow_no, false AS open, false AS single, NULL::DOUBLE AS first, NULL::DOUBLE AS last, NULL::DOUBLE AS closed_at, "
        "true AS absorbed, NULL::VARCHAR AS ended FROM p WHERE i = 1 UNION ALL "
        "SELECT key, i, ts, flow_no + new::INT, NOT absorbed AND ended IS NULL, new, first, CASE WHEN absorbed THEN last ELSE ts END, CASE WHEN absorbed THEN closed_at WHEN ended IN ('fin', 'rst') THEN ts END, absorbed, ended "
        "FROM (SELECT *, CASE WHEN absorbed THEN NULL WHEN flags & 1 > 0 THEN 'fin' WHEN flags & 4 > 0 THEN 'rst' WHEN ts - first > 86400 THEN 'active' END AS ended "
        "FROM (SELECT * REPLACE (CASE WHEN new THEN ts ELSE first END AS first) FROM (SELECT *, NOT absorbed AND (NOT open OR ts - last > limit_) AS new FROM ("
        "SELECT p.key, p.i, p.ts, p.flags, x.flow_no, x.open, x.first, x.last, x.closed_at, "
        f"CASE WHEN x.single THEN {probe} ELSE 7200 END AS limit_, NOT x.open AND coalesce(p.ts - x.closed_at <= 10, false) AND NOT (p.flags & 2 > 0 AND p.flags & 16 = 0) AS absorbed "
        "FROM x JOIN p ON p.key = x.key AND p.i = x.i + 1))))), "
        "own AS (SELECT key, flow_no, p.*, ended FROM x JOIN p USING (key, i) WHERE NOT absorbed), "
        "f AS (SELECT key, flow_no, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(src, i) AS fsrc, arg_min(dst, i) AS fdst, arg_min(sport, i)::INT AS fsport, arg_min(dport, i)::INT AS fdport, any_value(proto)::INT AS proto, "
        "count(*) AS n, max(ended) AS why FROM own GROUP BY key, flow_no), "
        "flow AS (SELECT f.key, f.flow_no, first_ts, last_ts, fsrc AS src, fdst AS dst, fsport AS sport, fdport AS dport, f.proto, count(*) FILTER (src = fsrc AND own.sport = fsport) AS fwd_pkts, "
        "count(*) FILTER (src <> fsrc OR own.sport <> fsport) AS bwd_pkts, coalesce(sum(size) FILTER (src = fsrc AND own.sport = fsport), 0)::BIGINT AS fwd_bytes, "
        "coalesce(sum(size) FILTER (src <> fsrc OR own.sport <> fsport), 0)::BIGINT AS bwd_bytes, coalesce(any_value(why), CASE WHEN any_value(f.flow_no) < max(top) THEN CASE WHEN any_value(n) = 1 THEN 'probe' "
        "ELSE 'idle' END ELSE 'end' END) AS ended, any_value(n) = 1 AS stub FROM f JOIN own USING (key, flow_no) JOIN (SELECT key, max(flow_no) AS top FROM f GROUP BY key) USING (key) GROUP BY ALL)"
    )


@query(f"WITH RECURSIVE {flow_table(300)} SELECT * FROM flow")
def ses1_assemble_flows(spark, sf_dir):
    return sessions.assemble_flows(packets(spark, sf_dir), idle=7200.0, active=DAY, probe=300.0)


@query(
    "WITH g AS (SELECT src, dst, ts, event_id, fwd_bytes, coalesce((ts - lag(ts) OVER w > 86400)::INT, 0) AS new FROM flows WINDOW w AS (PARTITION BY src, dst "
    "ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY src, dst ORDER BY ts, event_id)::BIGINT AS session FROM g) SELECT src, dst, session, "
    "min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, sum(fwd_bytes)::BIGINT AS amount FROM s GROUP BY ALL"
)
def ses2_extract_connections(spark, sf_dir):
    return sessions.idle_sessions(flows(spark, sf_dir), ["src", "dst"], idle=DAY)


MERGED = """
o AS (SELECT src, dst, ts, fwd_bytes, row_number() OVER (PARTITION BY src, dst ORDER BY ts, event_id) AS i FROM flows),
r AS (SELECT src, dst, i, ts AS anchor, ts, fwd_bytes FROM o WHERE i = 1 UNION ALL SELECT o.src, o.dst, o.i, CASE WHEN o.ts - r.anchor < 86400 THEN r.anchor ELSE o.ts END, o.ts, o.fwd_bytes FROM r JOIN o ON o.src = r.src AND o.dst = r.dst AND o.i = r.i + 1)"""


@query(f"WITH RECURSIVE {MERGED} SELECT src, dst, anchor AS t, sum(fwd_bytes)::DOUBLE AS b FROM r GROUP BY ALL")
def ses3_merge_checkins(spark, sf_dir):
    return sessions.merge_checkins(flows(spark, sf_dir), ["src", "dst"], gap=float(DAY))


@query("SELECT event_id, src, dst FROM flows QUALIFY coalesce(ts - lag(ts) OVER (PARTITION BY src, dst ORDER BY ts, event_id) > 3600, true)")
def ses4_session_starts(spark, sf_dir):
    return sessions.session_starts(flows(spark, sf_dir), ["src", "dst"], gap=3600.0).select("event_id", "src", "dst")


@query(
    "WITH n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM flows) SELECT user_id, (i // 20)::INT "
    "AS session, min(ts) AS first_ts, round(max(ts) - min(ts), 3) AS span FROM n GROUP BY ALL HAVING count(*) = 20"
)
def ses5_count_sessions(spark, sf_dir):
    s = sessions.count_sessions(flows(spark, sf_dir), ["user_id"], n=20, horizon=1e9)
    return s.select("user_id", "session", F.col("rows")[0]["ts"].alias("first_ts"), F.round(F.element_at("rows", -1)["ts"] - F.col("rows")[0]["ts"], 3).alias("span"))


@query(
    f"WITH RECURSIVE {MERGED}, c AS (SELECT src, dst, anchor AS t, row_number() OVER (PARTITION BY src, dst ORDER BY anchor DESC) AS back FROM (SELECT DISTINCT "
    f"src, dst, anchor FROM r)) SELECT src, dst, greatest(0, count(*) - 1) AS gaps, round(max(t) - min(t), 3) AS span FROM c WHERE back <= 5 GROUP BY ALL"
)
def ses6_model_series(spark, sf_dir):
    s = sessions.model_series(sessions.checkin_series(flows(spark, sf_dir), ["src", "dst"], gap=float(DAY)), n=5)
    return s.select("src", "dst", F.size("series").cast("long").alias("gaps"), F.round(stats.total(F.col("series")), 3).alias("span"))


@query(
    "WITH p AS (SELECT user_id, event_id, ts, CASE WHEN k % 2 = 0 THEN fwd_bytes ELSE -fwd_bytes END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, "
    "event_id) AS i FROM flows WHERE fwd_bytes > 0) SELECT user_id, string_agg(s::VARCHAR, ',' ORDER BY i) AS sizes FROM p WHERE i <= 20 GROUP BY 1"
)
def ses7_splt(spark, sf_dir):
    p = flows(spark, sf_dir).select("user_id", "event_id", "ts", F.col("fwd_bytes").alias("size"), (F.col("k") % 2 == 0).alias("forward"))
    return sessions.splt(p, ["user_id"]).select("user_id", F.array_join(F.transform("splt", lambda x: x["size"].cast("string")), ",").alias("sizes"))


@query(
    "WITH g AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM flows), i AS (SELECT *, "
    "sum((coalesce(gap, 0) > 7200)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g), s AS (SELECT user_id, island, max(ts) - min(ts) AS "
    "active, max(CASE WHEN gap > 7200 THEN gap END) AS idle FROM i GROUP BY ALL) "
    "SELECT user_id, count(*) AS stretches, round(avg(active), 4) AS active_mean, round(max(active), 4) AS active_max, round(avg(idle), 4) AS idle_mean, "
    "round(max(idle), 4) AS idle_max FROM s GROUP BY 1"
)
def ses8_active_idle(spark, sf_dir):
    return _rounded(sessions.active_idle(flows(spark, sf_dir), ["user_id"], gap=7200.0), "active_mean", "active_max", "idle_mean", "idle_max", digits=4)


@query(
    "WITH n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM flows), s AS (SELECT a.user_id, a.i AS start, "
    "a.ts AS first_ts, b.ts AS last_ts FROM n a JOIN n b ON a.user_id = b.user_id AND b.i = a.i + 19 WHERE a.i % 5 = 0) SELECT user_id, start, first_ts, last_ts, "
    "round((last_ts - first_ts) / 19, 4) AS mean_gap FROM s"
)
def ses9_strided_windows(spark, sf_dir):
    return _rounded(
        sessions.strided_windows(flows(spark, sf_dir), ["user_id"], n=20, stride=5), "mean_gap", digits=4,
    ).select("user_id", F.col("start").cast("long").alias("start"), "first_ts", "last_ts", "mean_gap")


# ---- scans


@query("SELECT src, floor(ts / 86400)::BIGINT * 86400 AS window_start, count(DISTINCT dport) AS ports FROM flows GROUP BY ALL")
def ag4_fanout(spark, sf_dir):
    return scan.fanout(flows(spark, sf_dir), seconds=DAY)


CANDIDATES = "SELECT * FROM flows WHERE NOT (dport IN (53, 80, 123, 443, 853, 5353) AND dst LIKE '203.0.113.%')"


@query(
    f"WITH c AS ({CANDIDATES}), n AS (SELECT src, floor(ts / 86400)::BIGINT * 86400 AS window_start, dport, count(DISTINCT dst) AS hosts FROM c GROUP BY ALL) SELECT "
    f"src, window_start, dport AS port, hosts FROM n QUALIFY row_number() OVER (PARTITION BY src, window_start ORDER BY hosts DESC, dport) = 1"
)
def ag5_sweep(spark, sf_dir):
    return scan.sweep(flows(spark, sf_dir), seconds=DAY)


@query(
    "WITH n AS (SELECT src, floor(ts / 86400)::BIGINT * 86400 AS window_start, count(DISTINCT dport) AS ports, count(DISTINCT dst) AS hosts FROM flows GROUP BY "
    "ALL) SELECT *, CASE WHEN hosts = 1 AND ports > 1 THEN 'vertical' WHEN hosts > 1 AND ports = 1 THEN 'horizontal' WHEN hosts > 1 AND ports > 1 THEN 'block' "
    "ELSE 'single' END AS scan_type FROM n"
)
def ag6_scan_type(spark, sf_dir):
    return scan.scan_type(flows(spark, sf_dir), seconds=DAY)


@query(f"SELECT event_id FROM ({CANDIDATES})")
def prj29_scan_candidates(spark, sf_dir):
    return scan.scan_candidates(flows(spark, sf_dir)).select("event_id")


@query(
    f"WITH {EVENTS} SELECT src, window_start, (neip >= 2 OR netcp >= 1 OR rwa >= 4 OR ports >= 6 OR hosts >= 4) AS is_scan, CASE WHEN neip >= 2 OR netcp >= 1 OR rwa >= "
    f"4 THEN 'indicators' WHEN ports >= 6 OR hosts >= 4 THEN 'backstop' END AS by FROM ev"
)
def ml2_scan_decide(spark, sf_dir):
    return scan.scan_decide(_events(spark, sf_dir), rwa=4, fan=6, reach=4).select("src", "window_start", "is_scan", "by")


@query(
    f"WITH {EVENTS}, a AS (SELECT src, window_start, icmp_error + rst + rwa + neip + netcp AS alpha, sum((icmp_error + rst + rwa + neip + netcp = 0)::INT) OVER (PARTITION BY src ORDER BY window_start) AS island "
    f"FROM ev) SELECT src, window_start, least(sum((alpha > 0)::INT) OVER (PARTITION BY src, island ORDER BY window_start), 2333)::BIGINT AS succession FROM a"
)
def win16_succession(spark, sf_dir):
    return scan.succession(_events(spark, sf_dir).withColumn("alpha", scan.suspicion())).select("src", "window_start", "succession")


@query(
    f"WITH RECURSIVE {EVENTS}, a AS (SELECT src, window_start, icmp_error + neip + netcp AS alpha, row_number() OVER (PARTITION BY src ORDER BY window_start) AS i FROM ev), "
    "s AS (SELECT src, window_start, i, CASE WHEN alpha > 0 THEN 0.8 / (1 - 0.8) ELSE 0.2 / 0.8 END::DOUBLE AS ratio FROM a WHERE i = 1 UNION ALL "
    "SELECT a.src, a.window_start, a.i, (CASE WHEN s.ratio >= 999 OR s.ratio <= 0.001 THEN 1.0 ELSE s.ratio END * CASE WHEN a.alpha > 0 THEN 0.8 / (1 - 0.8) ELSE "
    "0.2 / 0.8 END)::DOUBLE FROM s JOIN a ON a.src = s.src AND a.i = s.i + 1) "
    "SELECT src, window_start, round(ratio, 6) AS ratio, CASE WHEN ratio >= 999 THEN 'scanner' WHEN ratio <= 0.001 THEN 'normal' ELSE 'pending' END AS decision FROM s"
)
def win17_sprt(spark, sf_dir):
    return _rounded(scan.sprt(_events(spark, sf_dir).withColumn("alpha", scan.indicator_sum())), "ratio")


@query(
    "WITH s AS (SELECT src, count(DISTINCT dport) AS ports, count(DISTINCT dst) AS hosts, sum((bwd_pkts = 0)::INT)::BIGINT AS failed, count(*) AS flows FROM flows "
    "GROUP BY 1), t AS (SELECT *, CASE WHEN ports >= 100 THEN 3 WHEN ports >= 20 THEN 2 WHEN ports >= 5 THEN 1 ELSE 0 END + CASE WHEN hosts >= 100 THEN 3 WHEN "
    "hosts >= 20 THEN 2 WHEN hosts >= 5 THEN 1 ELSE 0 END + CASE WHEN failed * 2 > flows THEN 2 ELSE 0 END AS score FROM s) SELECT * FROM t ORDER BY score DESC, "
    "flows DESC, src LIMIT 3"
)
def ag21_quick_scan(spark, sf_dir):
    return scan.quick_scan(flows(spark, sf_dir))


# ---- floods

RECORDS = (
    "rec AS (SELECT * REPLACE (CASE WHEN proto <> 17 THEN sport WHEN k % 7 < 4 THEN 123 WHEN k % 7 < 6 THEN 389 ELSE 53 END AS sport), greatest(1, fwd_pkts + bwd_pkts) AS pkts, fwd_bytes + bwd_bytes AS bytes, (proto = 6 AND syn = 1 AND ack = 0) AS syn_only, (proto = 6 AND syn = "
    "1 AND ack = 1 AND bwd_pkts > 0) AS handshake FROM flows)"
)


def _ranked(counts: str) -> str:
    """The entries (less, v) of a map of counts, commonest first, those with one count in order of the value."""
    return f"list_sort(list_transform(map_entries({counts}), lambda e: {{'less': -e.value::BIGINT, 'v': e.key}}))"


FLOODS = (
    f"{RECORDS}, w AS (SELECT event_id, dst, ts, count(*) OVER f AS n, min(ts) OVER f AS first, sum(bytes) OVER f AS n_bytes, sum(pkts) OVER f AS n_pkts, "
    f"avg(syn_only::INT) OVER f AS syn_share, avg((proto = 17)::INT) OVER f AS udp_share, avg((proto = 6)::INT) OVER f AS tcp_share, coalesce(avg(handshake::INT) FILTER (proto = 6) OVER f, 0.0) AS handshake_share, "
    "histogram(src) OVER f AS by_source, histogram(sport) FILTER (proto = 17) OVER f AS by_sport, sum((proto = 17)::INT) OVER f AS n_udp, "
    "count(DISTINCT src) OVER f AS sources, entropy(src) OVER f AS entropy_bits, list(dport) OVER f AS ports FROM rec WINDOW f AS (PARTITION BY dst ORDER BY ts "
    "RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)), "
    "fw AS (SELECT *, n / CASE WHEN n = 1 THEN 1.0 ELSE greatest(1.0, least(7200.0, ts - first)) END AS rate, list_max(list_transform(list_distinct(ports), lambda "
    f"p: len(list_filter(ports, lambda q: q = p)))) / n AS port_share, {_ranked('by_source')} AS ranked, {_ranked('by_sport')}[1] AS sport_1 FROM w), "
    "fa AS (SELECT *, coalesce(-sport_1.less / n_udp, 0.0) AS amplifier_share, CASE sport_1.v WHEN 123 THEN 'NTP' WHEN 389 THEN 'CLDAP' WHEN 53 THEN 'DNS' END AS service FROM fw)"
)
FAMILY = (
    "CASE WHEN n >= 5 AND syn_share >= 0.4 AND port_share >= 0.3 THEN 'SYN flood' WHEN n >= 5 AND udp_share >= 0.4 AND amplifier_share >= 0.6 THEN "
    "'UDP reflection/amplification (' || service || ')' WHEN n >= 5 AND udp_share >= 0.4 THEN 'UDP flood' WHEN n >= 5 AND tcp_share >= 0.4 AND port_share >= 0.8 THEN 'TCP flood' END"
)


def _records(spark, sf_dir):
    """The flows with UDP answers of three amplifying services."""
    k = F.col("k") % 7
    sport = F.when(F.col("proto") != 17, F.col("sport")).when(k < 4, 123).when(k < 6, 389).otherwise(53)
    return flood.flow_record(flows(spark, sf_dir).withColumn("sport", sport))


def _windows(spark, sf_dir):
    return flood.flood_window(_records(spark, sf_dir), seconds=7200.0)


def _families(spark, sf_dir):
    return flood.flood_family(_windows(spark, sf_dir), shape=0.4, port_share=0.3, least_flows=5, spoof_sources=5)


@query(
    f"WITH {FLOODS} SELECT event_id, dst, n, sources, round(rate, 6) AS rate, round(entropy_bits, 6) AS entropy_bits, round(syn_share, 6) AS syn_share, "
    f"round(udp_share, 6) AS udp_share, round(handshake_share, 6) AS handshake_share, round(port_share, 6) AS port_share, round(n_bytes / n_pkts, 6) AS "
    f"bytes_per_packet, array_to_string(list_transform(ranked[:5], lambda x: x.v || ':' || (-x.less)), ',') AS top_sources, sport_1.v AS top_sport, "
    f"round(amplifier_share, 6) AS amplifier_share FROM fa"
)
def win1_flood_window(spark, sf_dir):
    w = _rounded(_windows(spark, sf_dir), "rate", "entropy_bits", "syn_share", "udp_share", "handshake_share", "port_share", "bytes_per_packet", "amplifier_share")
    heavy = F.array_join(F.transform("top_sources", lambda x: F.concat_ws(":", x["src"], x["n"].cast("string"))), ",").alias("top_sources")
    return w.select(
        "event_id", "dst", "n", F.col("sources").cast("long").alias("sources"), "rate", "entropy_bits", "syn_share", "udp_share", "handshake_share", "port_share", "bytes_per_packet", heavy,
        "top_sport", "amplifier_share",
    )


@query(
    "WITH s AS (SELECT dst, ts, src, fwd_bytes + bwd_bytes AS bytes, (proto = 6 AND syn = 1 AND ack = 0)::INT AS syn, unnest([floor(ts / 1800)::BIGINT * 1800, "
    "floor(ts / 1800)::BIGINT * 1800 - 1800]) AS start FROM flows) SELECT dst, start, count(*) AS n, count(DISTINCT src) AS sources, sum(bytes)::BIGINT AS bytes, "
    "sum(syn)::BIGINT AS syn, round(entropy(src), 6) AS entropy_bits FROM s GROUP BY ALL"
)
def win1_flood_slices(spark, sf_dir):
    w = flood.flood_slices(flood.flow_record(flows(spark, sf_dir)), seconds=3600, step=1800)
    return _rounded(w, "entropy_bits").withColumn("start", F.unix_timestamp("start"))


@query(
    f"WITH {FLOODS}, x AS (SELECT *, {FAMILY} AS family FROM fa) SELECT event_id, family, (coalesce(family IN ('SYN flood', 'UDP flood', 'TCP flood'), false) AND sources >= 5 AND "
    "sources / n >= 0.9 AND handshake_share <= 0.05) AS spoofed, (n >= 5 AND family IS NULL AND sources <= 3 AND port_share < 0.3) AS looks_like_scan FROM x"
)
def win2_flood_family(spark, sf_dir):
    return _families(spark, sf_dir).select("event_id", "family", "spoofed", "looks_like_scan")


@query()
def win3_throttle(spark, sf_dir):
    return flood.evaluations(_windows(spark, sf_dir).select("event_id", "dst", "ts", "n"), seconds=3600.0, growth=5).select("event_id", "dst", "n")


EWMA = (
    f"{FLOODS}, e AS (SELECT event_id, dst, rate, {FAMILY} AS family, row_number() OVER (PARTITION BY dst ORDER BY ts, event_id) AS i FROM fa), x AS (SELECT dst, i, "
    f"event_id, rate, family, NULL::DOUBLE AS baseline, CASE WHEN family IS NULL THEN rate END AS after FROM e WHERE i = 1 UNION ALL SELECT e.dst, e.i, e.event_id, "
    f"e.rate, e.family, x.after, CASE WHEN e.family IS NOT NULL THEN x.after WHEN x.after IS NULL THEN e.rate ELSE 0.95 * x.after + 0.05 * e.rate END FROM x JOIN e ON "
    f"e.dst = x.dst AND e.i = x.i + 1)"
)


@query(f"WITH RECURSIVE {EWMA} SELECT event_id, round(baseline, 9) AS baseline, (baseline IS NULL OR rate >= 1.5 * baseline) AS over FROM x")
def win4_ewma_baseline(spark, sf_dir):
    return _rounded(flood.ewma_baseline(_families(spark, sf_dir).select("event_id", "dst", "ts", "rate", "family"), factor=1.5), "baseline", digits=9).select("event_id", "baseline", "over")


@query(
    f"WITH RECURSIVE {EWMA}, d AS (SELECT x.event_id, x.family, x.rate, x.baseline, CASE x.family WHEN 'SYN flood' THEN syn_share WHEN 'TCP flood' THEN port_share "
    f"ELSE udp_share END AS share, sources FROM x JOIN fa USING (event_id) WHERE x.family IS NOT NULL AND x.rate >= 0.0001 AND sources >= 2 AND (baseline IS NULL "
    f"OR x.rate >= 1.5 * baseline)) "
    "SELECT event_id, family, round(0.6 + 0.2 * least(1.0, greatest(0.0, log10(greatest(1.0, rate / 0.0001)))) + 0.2 * least(1.0, greatest(0.0, (share - 0.4) / 0.6)), 6) AS confidence FROM d"
)
def win5_flood_alerts(spark, sf_dir):
    judged = _families(spark, sf_dir).select("event_id", "dst", "ts", "rate", "family", "sources", "syn_share", "port_share", "udp_share")
    return flood.flood_alerts(flood.ewma_baseline(judged, factor=1.5), rate=0.0001, sources=2, shape=0.4).select("event_id", "family", "confidence")


# ---- DNS

DNSV = (
    "m AS (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS base, CASE qtype WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA' WHEN 16 THEN 'TXT' WHEN 5 THEN 'CNAME' "
    "WHEN 15 THEN 'MX' WHEN 33 THEN 'SRV' ELSE 'ANY' END AS type FROM dns)"
)


def _dns(spark, sf_dir):
    return dns_ops.with_base(dns(spark, sf_dir))


@query(
    f"WITH {DNSV} SELECT page_id, (sum((rcode = 3)::INT) OVER w)::BIGINT AS nxdomain_count, sum((rcode = 3)::INT) OVER w >= 2 AS suspect FROM m WINDOW w AS (PARTITION "
    f"BY client ORDER BY ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)"
)
def ag9_nxdomain_rate(spark, sf_dir):
    return dns_ops.nxdomain_rate(_dns(spark, sf_dir), seconds=600.0, least=2).select("page_id", "nxdomain_count", "suspect")


@query(
    f"WITH {DNSV}, g AS (SELECT client, base, floor(ts / 3000)::BIGINT * 3000 AS window_start, count(*) AS n, sum(length(name))::BIGINT AS bytes_out, "
    f"sum(bytes)::BIGINT AS bytes_in FROM m GROUP BY ALL) SELECT * FROM g WHERE n >= 3 AND bytes_out > 0 AND bytes_in > 0"
)
def ag10_dns_bytes(spark, sf_dir):
    m = _dns(spark, sf_dir)
    return dns_ops.dns_bytes(m.withColumn("bytes", F.length("name").cast("long")), m, seconds=3000)


@query(
    f"WITH {DNSV}, n AS (SELECT client, type, count(*) AS n, sum((rcode = 3)::INT) AS nx FROM m GROUP BY ALL) SELECT client, sum(n)::BIGINT AS messages, round(sum(nx) "
    f"/ sum(n), 6) AS nx_rate, string_agg(type || '=' || n, ',' ORDER BY n DESC, type) AS types FROM n GROUP BY 1"
)
def ag11_dns_host_summary(spark, sf_dir):
    s = dns_ops.dns_host_summary(_dns(spark, sf_dir))
    listed = F.transform(F.sort_array(F.transform(F.map_entries("types"), lambda e: F.struct(-e["value"], e["key"]))), lambda x: F.concat(x["key"], F.lit("="), (-x["col1"]).cast("string")))
    return s.select("client", "messages", F.round("nx_rate", 6).alias("nx_rate"), F.array_join(listed, ",").alias("types"))


@query(
    f"WITH {DNSV}, w AS (SELECT page_id, count(*) OVER w AS replies, (sum((rcode = 3)::INT) OVER w)::BIGINT AS nx, count(DISTINCT CASE WHEN rcode = 3 THEN base "
    f"END) OVER w AS nx_bases FROM m WINDOW w AS (PARTITION BY client ORDER BY ts RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW)) "
    "SELECT page_id, replies, nx, nx_bases, round(0.6 + 0.25 * least(1.0, (nx / replies - 0.5) / 0.5) + 0.15 * least(1.0, nx / 80), 6) AS confidence FROM w WHERE "
    "nx >= 3 AND nx / replies >= 0.5 AND replies >= 4 AND nx_bases >= 2"
)
def win6_nx_burst(spark, sf_dir):
    m = dns_ops.nx_burst(_dns(spark, sf_dir), seconds=3000.0, nx=3, replies=4, bases=2)
    return m.select("page_id", "replies", "nx", F.col("nx_bases").cast("long").alias("nx_bases"), "confidence")


@query(
    f"WITH {DNSV}, w AS (SELECT page_id, count(*) OVER w AS queries, count(DISTINCT name) OVER w AS names, (sum((type IN ('TXT', 'CNAME', 'MX', 'SRV', "
    f"'ANY'))::INT) OVER w)::BIGINT AS rare FROM m WINDOW w AS (PARTITION BY client, base ORDER BY ts RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW)) "
    "SELECT page_id, queries, names, rare, round(0.6 + 0.25 * least(1.0, (rare / queries - 0.5) / 0.5) + 0.15 * least(1.0, names / 100), 6) AS confidence FROM w "
    "WHERE queries >= 3 AND names >= 2 AND rare / queries >= 0.5"
)
def win7_rtype_anomaly(spark, sf_dir):
    m = dns_ops.rtype_anomaly(_dns(spark, sf_dir), seconds=3000.0, least=3, names=2)
    return m.select("page_id", "queries", F.col("names").cast("long").alias("names"), "rare", "confidence")


@query(
    f"WITH {DNSV}, w AS (SELECT page_id, count(DISTINCT name) OVER w AS names, avg(length(string_split(name, '.')[1])) OVER w AS mean_label FROM m WINDOW w AS "
    f"(PARTITION BY client, base ORDER BY ts RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW)) "
    "SELECT page_id, names, round(mean_label, 6) AS mean_label, round(0.6 + 0.2 * least(1.0, (mean_label - 4) / 40) + 0.2 * least(1.0, names / 200), 6) AS "
    "confidence FROM w WHERE names >= 2 AND mean_label >= 4"
)
def win8_subdomain_fanout(spark, sf_dir):
    m = dns_ops.subdomain_fanout(_dns(spark, sf_dir), seconds=3000.0, names=2, label=4.0)
    return m.select("page_id", F.col("names").cast("long").alias("names"), F.round("mean_label", 6).alias("mean_label"), "confidence")


@query(
    "WITH v AS (SELECT event_id, k, least(1.0, value / 100) AS share FROM flows) SELECT event_id, round(0.6 + 0.25 * least(1.0, (share - 0.5) / 0.5) + 0.15 * "
    "least(1.0, k / 80), 6) AS nx_confidence, round(0.6 + 0.25 * least(1.0, (share - 0.5) / 0.5) + 0.15 * least(1.0, k / 100), 6) AS rtype_confidence, "
    "round(0.6 + 0.2 * least(1.0, (share * 60 - 20) / 40) + 0.2 * least(1.0, k / 200), 6) AS fanout_confidence FROM v"
)
def win9_dns_confidence(spark, sf_dir):
    share, k = F.least(F.lit(1.0), F.col("value") / 100), F.col("k")
    return flows(spark, sf_dir).select(
        "event_id", dns_ops.nx_confidence(share, k).alias("nx_confidence"), dns_ops.rtype_confidence(share, k).alias("rtype_confidence"), dns_ops.fanout_confidence(share * 60, k).alias("fanout_confidence")
    )


# ---- beacons, exfiltration, TLS

SCORED = """
kept AS (SELECT *, floor(ts / 2592000)::BIGINT * 2592000 AS window_start FROM flows),
hours AS (SELECT window_start, count(DISTINCT floor(ts / 3600)) AS captured_hours FROM kept GROUP BY 1), rare AS (SELECT dst, window_start, count(DISTINCT src) AS sources FROM kept WHERE dport <> 53 GROUP BY ALL),
o AS (SELECT src, dst, window_start, ts, fwd_bytes, row_number() OVER (PARTITION BY src, dst, window_start ORDER BY ts, event_id) AS i FROM kept WHERE dport <> 53),
r AS (SELECT src, dst, window_start, i, ts AS anchor, fwd_bytes FROM o WHERE i = 1 UNION ALL SELECT o.src, o.dst, o.window_start, o.i, CASE WHEN o.ts - r.anchor < 3600 THEN r.anchor ELSE o.ts END, o.fwd_bytes FROM r JOIN o ON o.src = r.src AND o.dst = r.dst AND o.window_start = r.window_start AND o.i = r.i + 1),
c AS (SELECT src, dst, window_start, anchor AS t, sum(fwd_bytes)::DOUBLE AS b FROM r GROUP BY ALL), g AS (SELECT *, t - lag(t) OVER (PARTITION BY src, dst, window_start ORDER BY t) AS gap FROM c),
med AS (SELECT src, dst, window_start, median(gap) AS mg, median(b) AS mb, count(*) AS checkins, max(t) - min(t) AS span, count(DISTINCT floor(t / 3600)) AS seen FROM g GROUP BY ALL HAVING count(*) >= 5),
sc AS (SELECT med.src, med.dst, med.window_start, any_value(checkins) AS checkins, 1 - least(1.0, CASE WHEN any_value(mg) <= 0 THEN 1 ELSE median(abs(gap - mg)) / any_value(mg) END) AS t, 1 - least(1.0, CASE WHEN any_value(mb) <= 0 THEN 1 ELSE median(abs(b - mb)) / any_value(mb) END) AS s, any_value(seen) AS seen
  FROM med JOIN g USING (src, dst, window_start) GROUP BY ALL)"""


def _scores(spark, sf_dir):
    return beacon.beacon_scores(flows(spark, sf_dir), window_seconds=30 * DAY, gap=3600.0, least_checkins=5, least_span=0.0, drop_ports=(53,))


SPECTRA = """
gi AS (SELECT src, dst, window_start, gap, row_number() OVER (PARTITION BY src, dst, window_start ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY src, dst, window_start) AS n FROM (SELECT * FROM g WHERE gap IS NOT NULL) JOIN med USING (src, dst, window_start)),
sp AS (SELECT src, dst, window_start, q, sqrt(pow(sum(gap * cos(2 * pi() * q * i / n)), 2) + pow(sum(gap * sin(2 * pi() * q * i / n)), 2)) AS a FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS q FROM gi) GROUP BY src, dst, window_start, q),
pr AS (SELECT src, dst, window_start, least(1.0, (max(a) - median(a)) / (stddev_pop(a) + 1e-9) / 8) AS f FROM sp GROUP BY ALL),
bs AS (SELECT src, dst, window_start, checkins, t, s, f, 1 / sources AS r, seen / captured_hours AS c FROM sc JOIN pr USING (src, dst, window_start) JOIN rare USING (dst, window_start) JOIN hours USING (window_start)),
bt AS (SELECT *, 0.30 * t + 0.20 * f + 0.20 * s + 0.15 * r + 0.15 * c AS score FROM bs)"""


@query(f"WITH RECURSIVE {SCORED}, {SPECTRA} SELECT src, dst, window_start, checkins, {', '.join(f'round({x}, 6) AS {x}' for x in ('t', 'f', 's', 'r', 'c', 'score'))} FROM bt")
def ag7_beacon_score(spark, sf_dir):
    s = _rounded(_scores(spark, sf_dir), "t", "f", "s", "r", "c", "score")
    return s.select("src", "dst", "window_start", F.col("checkins").cast("long").alias("checkins"), "t", "f", "s", "r", "c", "score")


@query(
    f"WITH RECURSIVE {SCORED}, {SPECTRA}, best AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, window_start) AS i FROM bt WHERE score >= 0.3), "
    "x AS (SELECT src, dst, window_start, stddev_pop(gap) / avg(gap) AS cv, max(t) - min(t) AS span, list(round(gap, 3) ORDER BY t) FILTER (WHERE gap IS NOT NULL) AS gaps FROM g GROUP BY ALL) "
    "SELECT src, dst, window_start, round(score, 6) AS score, checkins, round(cv, 6) AS cv, round(span, 3) AS span, array_to_string(list_transform(gaps[1:24], "
    "lambda v: round(v * 1000)::BIGINT), ',') AS first_gaps FROM best JOIN x USING (src, dst, window_start) WHERE i = 1"
)
def ag8_beacon_alerts(spark, sf_dir):
    a = beacon.beacon_alerts(_scores(spark, sf_dir).withColumn("score", F.col("score")), least=0.3)
    millis = F.array_join(F.transform("first_gaps", lambda x: F.round(F.round(x, 3) * 1000).cast("long").cast("string")), ",")
    return a.select(
        "src", "dst", "window_start", F.round("score", 6).alias("score"), F.col("checkins").cast("long").alias("checkins"), F.round("cv", 6).alias("cv"),
        F.round("span", 3).alias("span"), millis.alias("first_gaps"),
    )


@query(
    "WITH h AS (SELECT src, dst, dport, avg(fwd_bytes) AS mean_bytes, (max(ts) - min(ts)) / greatest(1, count(*) - 1) AS mean_gap FROM flows GROUP BY ALL) SELECT "
    "src, dst, dport, (dport = 123 OR (dport = 53 AND mean_gap >= 30) OR (mean_bytes < 100 AND mean_gap BETWEEN 10 AND 120) OR (dport IN (80, 443) AND mean_gap "
    "BETWEEN 4 AND 31 AND mean_bytes < 500)) AS benign_periodic FROM h"
)
def prj30_benign_periodic(spark, sf_dir):
    h = flows(spark, sf_dir).groupBy("src", "dst", "dport").agg(F.avg("fwd_bytes").alias("mean_bytes"), ((F.max("ts") - F.min("ts")) / F.greatest(F.lit(1), F.count("*") - 1)).alias("mean_gap"))
    return beacon.benign_periodic(h).select("src", "dst", "dport", "benign_periodic")


@query(f"WITH RECURSIVE {SCORED}, {SPECTRA} SELECT src, dst, round(arg_max(score, window_start), 6) AS score FROM bt GROUP BY ALL ORDER BY arg_max(score, window_start) DESC, src, dst LIMIT 10")
def top1_beacons(spark, sf_dir):
    return _rounded(beacon.top_beacons(_scores(spark, sf_dir)), "score")


@query(
    "WITH w AS (SELECT event_id, sum(fwd_bytes) OVER w AS out_bytes, sum(bwd_bytes) OVER w AS in_bytes FROM flows WHERE bwd_pkts > 0 AND dst LIKE '203.%' WINDOW w "
    "AS (PARTITION BY src, dst ORDER BY last_seen RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)), r AS (SELECT *, out_bytes / greatest(1, in_bytes) AS ratio FROM "
    "w) "
    "SELECT event_id, out_bytes::BIGINT AS out_bytes, in_bytes::BIGINT AS in_bytes, round(0.6 + 0.2 * least(1.0, greatest(0.0, log10(ratio / 4))) + 0.2 * "
    "least(1.0, greatest(0.0, log10(out_bytes / 20000))), 6) AS confidence FROM r WHERE out_bytes >= 20000 AND ratio >= 4"
)
def win10_exfil_ratio(spark, sf_dir):
    return beacon.exfil_ratio(wired(flows(spark, sf_dir)), seconds=float(DAY), least_bytes=20_000, ratio=4.0).select("event_id", "out_bytes", "in_bytes", "confidence")


def _tls(spark, sf_dir):
    k = F.col("k")
    return flows(spark, sf_dir).select(
        "event_id", "ts", "src", F.concat(F.lit("s"), k % 3).alias("dst"), "fwd_bytes", F.concat(F.lit("j"), k % 2).alias("ja4"), (k % 4).alias("shape"),
        (k % 4).alias("flags"), F.lit("one").alias("sensor"),
    )




def _regular(numbers: str) -> str:
    """How regular a list of numbers is: 1 less the median distance from the median over it; 0 for fewer than three."""
    median, mad = f"list_aggregate({numbers}, 'median')", f"list_aggregate({numbers}, 'mad')"
    return f"CASE WHEN len({numbers}) < 3 OR {median} <= 0 THEN 0 ELSE 1 - least(1.0, {mad} / {median}) END"


TLS = "tls AS (SELECT event_id, ts, src, 's' || (k % 3) AS dst, fwd_bytes, 'j' || (k % 2) AS ja4, k % 4 AS shape, k % 4 AS flags FROM flows)"


@query(
    f"WITH {TLS}, d AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY ts, event_id) = 1)::INT AS f, (row_number() OVER (PARTITION BY ja4, src ORDER BY "
    f"ts, event_id) = 1)::INT AS fc FROM tls), p AS (SELECT *, sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS population, sum(fc) OVER (PARTITION "
    f"BY ja4 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clients FROM d), "
    "w AS (SELECT event_id, population, clients, flags, count(*) OVER w AS n, list(shape) OVER w AS shapes, list(fwd_bytes::DOUBLE) OVER w AS sizes, list_sort(list(ts) OVER w) AS times FROM p WINDOW w AS (PARTITION BY src, dst, ja4 ORDER BY "
    "ts RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW)), "
    "g AS (SELECT *, list_transform(range(1, len(times)), lambda i: times[i + 1] - times[i]) AS gaps FROM w WHERE n >= 4), "
    "x AS (SELECT event_id, n, CASE WHEN population < 5 THEN 0 ELSE 1 - least(1.0, (clients - 1) / 4) END AS r, "
    f"{_regular('gaps')} AS t, {_regular('sizes')} AS s, list_max(list_transform(list_distinct(shapes), lambda s: len(list_filter(shapes, lambda x: x = s)))) / n AS p, least(1.0, flags / 3) AS h FROM g) "
    "SELECT event_id, n AS sessions, round(r, 6) AS r, round(t, 6) AS t, round(s, 6) AS s, round(p, 6) AS p, round(h, 6) AS h, round(0.3 * r + 0.2 * t + 0.15 * s + 0.15 * p + 0.2 * h, 6) AS score FROM x"
)
def win11_tls_profile(spark, sf_dir):
    t = _rounded(beacon.tls_profile(_tls(spark, sf_dir), seconds=864_000.0, least_sessions=4), "r", "t", "s", "p", "h", "score")
    return t.select("event_id", F.col("sessions").cast("long").alias("sessions"), "r", "t", "s", "p", "h", "score")


@query(
    f"WITH {TLS}, d AS (SELECT *, (row_number() OVER (PARTITION BY ja4, src ORDER BY ts, event_id) = 1)::INT AS fc FROM tls) SELECT event_id, (sum(fc) OVER (PARTITION "
    f"BY ja4 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS clients FROM d"
)
def win12_running_distinct(spark, sf_dir):
    return beacon.running_distinct(_tls(spark, sf_dir), of="src", order=["ts", "event_id"], by=["ja4"], name="clients").select("event_id", "clients")


@query(f"WITH {TLS} SELECT ja4, count(*) AS sessions, count(DISTINCT src) AS clients FROM tls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top2_fingerprints(spark, sf_dir):
    return beacon.top_fingerprints(_tls(spark, sf_dir))

"""Behaviour windows of hosts, their context, normalisers and scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered, stats

FEATURES = ["log_n_flows", "log_bytes_up", "log_bytes_down", "egress_asymmetry", "iat_cv", "ks_uniform", "ks_exponential", "fft_prominence", "distinct_endpoint_ratio", "log_duration_mean"]


def behaviour_windows(conns: DataFrame, *, tz_seconds: int = 0) -> DataFrame:
    """Per (host, local hour, category): n and ten features, from connections (host, peer, cat, ts, dur, up, down).

    With fewer than four gaps the timing features are 0, 1, 1 and 0. One shuffle; a window's gaps are one array.
    """
    keyed = conns.withColumn("lhour", F.floor((F.col("ts") + tz_seconds) / 3600).cast("long"))
    g = keyed.groupBy("host", "lhour", "cat").agg(
        F.count("*").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"), F.count_distinct("peer").alias("peers"), F.avg("dur").alias("dur"), F.sort_array(F.collect_list("ts")).alias("times")
    )
    g = g.withColumn("gaps", stats.differences(F.col("times")))
    few = F.size("gaps") < 4
    timing = {
        "iat_cv": F.when(few, 0.0).otherwise(stats.iat_cv(F.col("gaps"))), "ks_uniform": F.when(few, 1.0).otherwise(stats.ks_uniform(F.col("gaps"))),
        "ks_exponential": F.when(few, 1.0).otherwise(stats.ks_exponential(F.col("gaps"))), "fft_prominence": F.when(few, 0.0).otherwise(stats.fft_prominence_capped("gaps")),
    }
    out = g.withColumns({
        "log_n_flows": F.log1p("n"), "log_bytes_up": F.log1p("up"), "log_bytes_down": F.log1p("down"), "egress_asymmetry": (F.col("up") - F.col("down")) / (F.col("up") + F.col("down") + 1.0),
        "distinct_endpoint_ratio": F.col("peers") / F.col("n"), "log_duration_mean": F.log1p("dur"), **timing,
    })
    return out.select("host", "lhour", "cat", "n", *FEATURES)


def corpus_summary(windows: DataFrame) -> DataFrame:
    day = F.floor(F.col("lhour") / 24)
    return windows.groupBy("cat").agg(
        F.count("*").alias("windows"), F.count_distinct("host").alias("hosts"), F.count_distinct("host", day).alias("host_days"), F.min("lhour").alias("first_hour"),
        F.max("lhour").alias("last_hour"),
    )


def fanin_profile(flows: DataFrame) -> DataFrame:
    """Per peer: distinct clients and flows, beside the 90th and 99th percentile of client counts over peers."""
    per = flows.groupBy("dst").agg(F.count_distinct("src").alias("clients"), F.count("*").alias("flows"))
    cut = ordered.quantiles(per, "clients", {"p90": 0.9, "p99": 0.99})  # one row
    return per.crossJoin(F.broadcast(cut)).select("dst", "clients", "flows", "p90", "p99")


def novelty(rows: DataFrame, *, freeze: int) -> DataFrame:
    """Per (host, lhour, cat): the share of its peers, and whether its category, are new to the host.

    Rows (host, lhour, cat, peer) are taken in the order of hour and category. Until ``freeze`` a peer is new in its
    first row; after it, if the host never had it before the freeze. No running sets: each row is held against first
    times.
    """
    at = F.struct("lhour", "cat")
    first_peer = F.min(at).over(Window.partitionBy("host", "peer"))
    first_cat = F.min(at).over(Window.partitionBy("host", "cat"))
    early = lambda first: first["lhour"] < freeze
    new = lambda first: F.when(F.col("lhour") < freeze, first == at).otherwise(~early(first))
    marked = rows.select("host", "lhour", "cat", "peer").distinct().withColumns({"__peer": first_peer, "__cat": first_cat})
    marked = marked.withColumns({"new_peer": new(F.col("__peer")), "new_cat": new(F.col("__cat"))})
    return marked.groupBy("host", "lhour", "cat").agg(F.avg(F.col("new_peer").cast("int")).alias("peer_novelty"), F.max(F.col("new_cat").cast("int")).alias("service_novelty"))


def cohort(windows: DataFrame, feature: str) -> DataFrame:
    """The mean of a feature over the other hosts in the same hour and category; 0 where there are none.

    An hour's hosts are added up where they lie, so no task takes them all.
    """
    totals = windows.groupBy(F.col("lhour").alias("__hour"), F.col("cat").alias("__cat")).agg(F.sum(feature).alias("__total"), F.count(feature).alias("__n"))
    joined = windows.join(totals, F.col("lhour").eqNullSafe(F.col("__hour")) & F.col("cat").eqNullSafe(F.col("__cat")), "left")
    others = (F.col("__total") - F.col(feature)) / (F.col("__n") - 1)
    return joined.withColumn("cohort", F.when(F.col("__n") > 1, others).otherwise(0.0)).drop("__hour", "__cat", "__total", "__n")


def reference_stats(windows: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population deviation, plus a little, of each feature."""
    return windows.agg(*[F.avg(f).alias(f"{f}_mean") for f in features], *[(F.stddev_pop(f) + 1e-6).alias(f"{f}_std") for f in features])


def standardise(windows: DataFrame, reference: DataFrame, features: list[str]) -> DataFrame:
    joined = windows.crossJoin(F.broadcast(reference))  # one row
    return joined.withColumns({f: (F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_std") for f in features}).select(*windows.columns)


def day_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("host", "day").agg(F.max("score").alias("score"), F.count("*").alias("live"), F.max(F.col("attack").cast("int")).alias("attack"))


def bag_features(windows: DataFrame, features: list[str], categories: list[str]) -> DataFrame:
    """Per host-day: presence, mean and maximum of each feature in each category, absent ones 0."""
    day = windows.withColumn("day", F.floor(F.col("lhour") / 24))
    aggs = [F.count(F.lit(1)).alias("n"), *[a for f in features for a in (F.avg(f).alias(f"{f}_mean"), F.max(f).alias(f"{f}_max"))]]
    return day.groupBy("host", "day").pivot("cat", categories).agg(*aggs).fillna(0)


def ct_features(flows: DataFrame, *, n: int = 100) -> DataFrame:
    """Counts over the n connections of a sensor up to each one: of its service, ends, ports, pair and state.

    A sensor's connections are shared out among tasks by their numbers.
    """
    same = {
        "ct_srv_src": ["service", "src"], "ct_srv_dst": ["service", "dst"], "ct_dst_ltm": ["dst"], "ct_src_ltm": ["src"], "ct_src_dport_ltm": ["src", "dport"], "ct_dst_sport_ltm": ["dst", "sport"],
        "ct_dst_src_ltm": ["dst", "src"], "ct_state_ttl": ["state", "ttl_bucket"],
    }
    of = {"ct_flw_http_mthd": F.col("service") == "http", "ct_ftp_cmd": F.col("service").isin("ftp", "ftp-data")}
    return ordered.last_counts(flows, ["sensor"], ["ts", "event_id"], n=n, same=same, of=of)


def host_rank(scores: DataFrame) -> DataFrame:
    """The share of the host's rows that score no higher, ties by id."""
    w = Window.partitionBy("host")
    return scores.withColumn("rank", F.row_number().over(w.orderBy("score", "doc_id")) / F.count("*").over(w))


def fit_host_norm(scores: DataFrame, *, least: int = 20, floor: float = 1e-6) -> DataFrame:
    """Per host: median and scaled deviation of its scores, or the pooled ones where it has too few rows."""
    middle = ordered.quantiles(scores, "score", {"pooled_med": 0.5})  # one row, as is the next
    spread = ordered.quantiles(scores.crossJoin(F.broadcast(middle)).withColumn("__off", F.abs(F.col("score") - F.col("pooled_med"))), "__off", {"off": 0.5})
    pooled = middle.crossJoin(spread).select("pooled_med", F.greatest(F.lit(floor), 1.4826 * F.col("off")).alias("pooled_mad"))
    mid = scores.groupBy("host").agg(F.median("score").alias("med"), F.count("*").alias("n"))
    own = scores.join(mid, "host").groupBy("host", "med", "n").agg(F.greatest(F.lit(floor), 1.4826 * F.median(F.abs(F.col("score") - F.col("med")))).alias("mad"))
    own = own.crossJoin(F.broadcast(pooled))
    few = F.col("n") < least
    return own.select("host", "n", F.when(few, F.col("pooled_med")).otherwise(F.col("med")).alias("med"), F.when(few, F.col("pooled_mad")).otherwise(F.col("mad")).alias("mad"))


def apply_host_norm(scores: DataFrame, norm: DataFrame) -> DataFrame:
    return scores.join(norm, "host").withColumn("z", (F.col("score") - F.col("med")) / F.col("mad"))


def bag_distance(fit: DataFrame, score: DataFrame, features: list[str], *, least: int = 5) -> DataFrame:
    """Per row of score: the mean squared robust distance of its features from its host's medians."""
    long = lambda df, *ids: df.select(*ids, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    f = long(fit, "host")
    mid = f.groupBy("host", "feature").agg(F.median("x").alias("med"), F.count("*").alias("n")).where(F.col("n") >= least)
    mad = f.join(mid, ["host", "feature"]).groupBy("host", "feature", "med").agg((1.4826 * F.median(F.abs(F.col("x") - F.col("med"))) + 1e-6).alias("mad"))
    d = long(score, "host", "id").join(mad, ["host", "feature"])
    return d.groupBy("host", "id").agg(F.avg(F.pow((F.col("x") - F.col("med")) / F.col("mad"), 2)).alias("distance"))


def rolling_quantile(rows: DataFrame, *, q: float = 0.99, n: int = 2000, least: int = 50) -> DataFrame:
    """The q quantile of the n scores before each row of a stream; infinite until there are enough."""
    w = Window.partitionBy("host").orderBy("seq").rowsBetween(-n, -1)
    return rows.withColumn("threshold", F.when(F.count("score").over(w) >= least, F.percentile("score", q).over(w)).otherwise(F.lit(float("inf"))))


def guarded_threshold(rows: DataFrame, *, q: float = 0.99, least: int = 200, step: float = 0.5, ring: int = 5000, freeze: int = 8, every: int = 250) -> DataFrame:
    """Per key, over rows (key, seq, score, eligible) in order: the threshold in force at each row.

    The reference is a ring of eligible scores. A proposal comes every ``every`` rows, is refused under ``least``
    references, moves by at most ``step`` scaled deviations, and counts from the next row. ``freeze`` alerts in a row
    stop all moves. Rows stream through each task in order; what is held is the ring.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, threshold, alerts, frozen, since = None, [], np.inf, 0, False, 0
        for batch in batches:
            out = []
            for k, seq, score, eligible in batch[["key", "seq", "score", "eligible"]].itertuples(index=False):
                if k != key:
                    key, held, threshold, alerts, frozen, since = k, [], np.inf, 0, False, 0
                alert = score > threshold
                out.append((k, seq, score, float(threshold), bool(alert), bool(frozen)))
                alerts = alerts + 1 if alert else 0
                frozen = frozen or alerts >= freeze
                if eligible and not alert:
                    held = (held + [score])[-ring:]
                since += 1
                if since >= every:
                    since = 0
                    if len(held) >= least and not frozen:
                        x = np.asarray(held)
                        wanted = float(np.quantile(x, q))
                        most = step * 1.4826 * float(np.median(np.abs(x - np.median(x))))
                        threshold = wanted if np.isinf(threshold) else threshold + float(np.clip(wanted - threshold, -most, most))
            if out:
                yield pd.DataFrame(out, columns=["key", "seq", "score", "threshold", "alert", "frozen"])

    schema = "key string, seq long, score double, threshold double, alert boolean, frozen boolean"
    return rows.select(
        F.col("key").cast("string").alias("key"), "seq", F.col("score").cast("double").alias("score"), "eligible",
    ).repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, schema)


def cusum(rows: DataFrame, *, mu0: float, sigma: float, k: float = 0.5, h: float = 10.6) -> DataFrame:
    """Per host: when the one-sided cumulative sum of its standardised scores first passes h, and its value there.

    The sum that restarts at 0 is the running sum less its least value so far (or 0). Rows may share a seq, as a replayed
    event's do: they are added by rising score, and the value is that of the row at which the sum passes h.
    """
    in_order = Window.partitionBy("host").orderBy("seq", "score")
    w = in_order.rowsBetween(Window.unboundedPreceding, 0)
    p = rows.withColumns({"__p": F.sum((F.col("score") - mu0) / sigma - k).over(w), "__i": F.row_number().over(in_order)})
    s = p.withColumn("s", F.col("__p") - F.least(F.lit(0.0), F.min("__p").over(w)))
    return s.where(F.col("s") > h).groupBy("host").agg(F.min("seq").alias("alarm_at"), F.min_by("s", "__i").alias("value"))


def markov_surprise(train: DataFrame, test: DataFrame, *, smoothing: float = 1.0) -> DataFrame:
    """Per host of test (host, seq, state): minus the mean log probability of its steps under the smoothed transition
    counts of train."""
    w = Window.partitionBy("host").orderBy("seq")
    steps = lambda df: df.withColumn("to", F.lead("state").over(w)).where("to is not null").select("host", F.col("state").alias("from"), "to")
    pairs = steps(train).groupBy("from", "to").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("from").agg(F.sum("n").alias("total"))
    states = train.agg(F.count_distinct("state").alias("states"))  # one row
    seen = steps(test).join(pairs, ["from", "to"], "left").join(totals, "from", "left").crossJoin(F.broadcast(states))
    p = (F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("total", F.lit(0)) + smoothing * F.col("states"))
    return seen.groupBy("host").agg((-F.avg(F.log(p))).alias("surprise"))


def chain_steps(windows: DataFrame, chain: list[str]) -> DataFrame:
    """Per host and day, how many steps of the chain of categories were walked in order of the hour."""
    h = windows.groupBy("host", "day").agg(F.sort_array(F.collect_list(F.struct("hour", "cat"))).alias("h"))
    wanted = F.array(*map(F.lit, chain))
    walked = F.aggregate("h", F.lit(0), lambda i, x: F.when(F.get(wanted, i) == x["cat"], i + 1).otherwise(i))
    return h.select("host", "day", walked.alias("steps"))


def trigger_hours(scores: DataFrame) -> DataFrame:
    """Per host: quartiles of the hour at which its days score highest."""
    peak = scores.groupBy("host", "day").agg(F.max_by("hour", F.struct("score", -F.col("hour"))).alias("hour"))
    return peak.groupBy("host").agg(F.percentile("hour", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("days"))


def visibility_gate(rows: DataFrame, *, tolerance: float = 0.15, floor: float = 0.25) -> DataFrame:
    """action and reasons from current against commissioning figures (columns c_*)."""
    c = F.col
    regime = (c("snaplen") != c("c_snaplen")) | (c("quic_readable") & ~c("c_quic_readable"))
    better = c("named_flow_ratio") > c("c_named_flow_ratio") * (1 + tolerance)
    lost = c("named_flow_ratio") < floor
    low = ~lost & (c("named_flow_ratio") < c("c_named_flow_ratio") * (1 - tolerance))
    sni = c("tls_sni_ratio") < c("c_tls_sni_ratio") * (1 - tolerance)
    quic = c("c_quic_readable") & ~c("quic_readable")
    action = F.when(regime | better, "recommission").when(lost | low | quic, "refuse").when(sni, "warn_and_score").otherwise("score")
    worse = ~(regime | better)
    reasons = [
        (regime, "regime changed"), (~regime & better, "naming improved"), (worse & lost, "naming under floor"), (worse & low, "naming fell"),
        (worse & sni, "server names fell"), (worse & quic, "QUIC unreadable"),
    ]
    return rows.withColumns({"action": action, "reasons": F.array_compact(F.array(*[F.when(t, r) for t, r in reasons]))})


def promotion_blockers(rows: DataFrame, *, live: int = 240, days: int = 10, references: int = 200, named: float = 0.5, drift: float = 0.35, disagreement: float = 0.2) -> DataFrame:
    """What still stands between a host and promotion."""
    c = F.col
    tests = [
        (c("live_windows") < live, "live windows"), (c("distinct_days") < days, "distinct days"), (~c("saw_weekend"), "no weekend"), (c("reference_samples") < references, "reference samples"), (c("named_flow_ratio") < named, "named-flow ratio"),
        (F.abs("score_drift") > drift, "score drift"), (c("teacher_disagreement") > disagreement, "disagreement"), (c("incident_open"), "incident open"), (~c("visibility_ok"), "visibility"),
    ]
    return rows.withColumn("blockers", F.array_compact(F.array(*[F.when(t, r) for t, r in tests])))


def coverage_report(hosts: DataFrame, tiers: DataFrame, *, per_host: float = 1 / 30) -> DataFrame:
    """Per tier: hosts, their load, and the expected days until a host that shows is audited."""
    joined = hosts.join(F.broadcast(tiers), "tier")  # one row a tier
    load = F.least(F.lit(1.0), F.col("audit") + F.col("budget") + per_host)
    return joined.groupBy("tier").agg(F.count("*").alias("hosts"), F.sum(load).alias("load"), (1 / (F.max("audit") * F.max("p_detect"))).alias("expected_days"))


LIFECYCLE = ("COMMISSIONING", "SENTRY_PRIMARY", "ESCALATED", "INCIDENT_HOLD", "RECOMMISSIONING")


def next_state(state: str, command: str | None, ready: bool | None) -> str:
    """A host's state after a command (step with ready, escalate, open_incident, release_incident, mark_stale)."""
    held = state == "INCIDENT_HOLD"
    if command == "open_incident":
        return "INCIDENT_HOLD"
    if command == "release_incident" and held or command == "mark_stale" and not held:
        return "RECOMMISSIONING"
    if command == "escalate" and state == "SENTRY_PRIMARY":
        return "ESCALATED"
    if command == "step" and (state == "ESCALATED" or ready and state in ("COMMISSIONING", "RECOMMISSIONING")):
        return "SENTRY_PRIMARY"
    return state


def lifecycle(events: DataFrame) -> DataFrame:
    """Per host, its state after each command, which is all that is held of it."""

    def step(held: list, command: str | None, ready: bool | None) -> tuple:
        held[0] = next_state(held[0], command, ready)
        return (held[0],)

    rows = events.select("host", F.col("seq").cast("long").alias("seq"), "command", "ready")
    return ordered.folded(rows, ["host"], ["seq"], needs=["command", "ready"], start=lambda: [LIFECYCLE[0]], step=step, adds={"state": "string"}).select("host", "seq", "state")

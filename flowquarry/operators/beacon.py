"""Beaconing: merged check-ins of a pair, their periodicity, and how rare the destination is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net, ordered, stats
from . import sessions

#: Ports of protocols that are periodic by nature.
PERIODIC_PORTS = (53, 123, 1900, 5353, 5355, 137, 138, 67, 68, 546, 547)
WEIGHTS = {"t": 0.30, "f": 0.20, "s": 0.20, "r": 0.15, "c": 0.15}


def checkins(flows: DataFrame, *, window_seconds: int, gap: float = 5.0) -> DataFrame:
    """Per (src, dst, window): merged check-ins as arrays of times and bytes, at most one a gap.

    Starts under gap seconds after their group's first start are one check-in, their bytes summed.
    """
    f = flows.withColumn("window_start", F.floor(F.col("ts") / window_seconds) * window_seconds)
    return sessions.checkin_series(f, ["src", "dst", "window_start"], gap=gap)


def beacon_scores(flows: DataFrame, *, window_seconds: int = 21_600, gap: float = 5.0, least_checkins: int = 20, least_span: float = 1800.0, drop_ports: tuple[int, ...] = PERIODIC_PORTS) -> DataFrame:
    """t, f, s, r, c and their weighted sum per (src, dst, window) with enough check-ins over a long enough span.

    t and s are 1 less the median deviation ratio of gaps and of sizes, f an eighth of the spectrum's prominence, r one
    over the destination's sources, c the share of captured hours with a check-in. Hours are counted before any flow
    is dropped, sources after. A closed window is scored once.
    """
    start = F.floor(F.col("ts") / window_seconds) * window_seconds
    timed = flows.withColumn("window_start", start)
    hours = timed.groupBy("window_start").agg(F.count_distinct(F.floor(F.col("ts") / 3600)).alias("captured_hours"))
    kept = timed.where(~F.col("dport").isin(*drop_ports) & ~net.is_skip_dst(F.col("dst")))
    rare = kept.groupBy("dst", "window_start").agg(F.count_distinct("src").alias("sources"))
    c = checkins(kept.drop("window_start"), window_seconds=window_seconds, gap=gap)
    c = c.where((F.size("times") >= least_checkins) & (F.element_at("times", -1) - F.get("times", F.lit(0)) >= least_span))
    c = c.withColumn("gaps", stats.differences(F.col("times")))
    c = c.join(rare, ["dst", "window_start"]).join(hours, "window_start")  # one row a destination, one a window
    seen = F.size(F.array_distinct(F.transform("times", lambda t: F.floor(t / 3600))))
    one = F.lit(1.0)
    c = c.withColumns({
        "t": 1 - F.least(one, stats.mad_ratio(F.col("gaps"))), "f": F.least(one, stats.fft_prominence("gaps") / 8), "s": 1 - F.least(one, stats.mad_ratio(F.col("sizes"))),
        "r": 1 / F.col("sources"), "c": seen / F.col("captured_hours"),
    })
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return c.withColumn("score", score).withColumn("checkins", F.size("times"))


def beacon_alerts(scores: DataFrame, *, least: float = 0.80) -> DataFrame:
    """The best window of each pair that scores enough, with its span, gap variation and first 24 gaps."""
    best = scores.where(F.col("score") >= least).withColumn("__rank", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("score"), "window_start"))).where("__rank = 1")
    return best.select(
        "src", "dst", "window_start", "score", "checkins", stats.iat_cv(F.col("gaps")).alias("cv"), (F.element_at("times", -1) - F.col("times")[0]).alias("span"),
        F.slice("gaps", 1, 24).alias("first_gaps"),
    )


def benign_periodic(rows: DataFrame) -> DataFrame:
    """Marks regular traffic with a known cause: time sync, keep-alive, name refresh, health checks."""
    c = F.col
    return rows.withColumn(
        "benign_periodic",
        (c("dport") == 123) | ((c("dport") == 53) & (c("mean_gap") >= 30)) | ((c("mean_bytes") < 100) & c("mean_gap").between(10, 120)) | (c("dport").isin(80, 443) & c("mean_gap").between(4, 31) & (c("mean_bytes") < 500)),
    )


def top_beacons(scores: DataFrame, *, n: int = 10) -> DataFrame:
    """The n pairs with the highest latest score."""
    latest = scores.groupBy("src", "dst").agg(F.max_by("score", "window_start").alias("score"))
    return latest.orderBy(F.desc("score"), "src", "dst").limit(n)


def exfil_ratio(flows: DataFrame, *, seconds: float = 900.0, least_bytes: int = 5_000_000, ratio: float = 10.0, direction: bool = True) -> DataFrame:
    """Flows after which an internal host has sent an external one much more than it got, in the seconds before.

    Windows go by end time; flows without a packet back are left out, and ratios are over at least one byte in.
    """
    f = flows.where(F.col("bwd_pkts") > 0)
    if direction:
        f = f.where(net.is_internal(F.col("src")) & net.is_external(F.col("dst")))
    w = stats.trailing("src", "dst", seconds=seconds, ts="last_seen")
    f = f.withColumns({"out_bytes": F.sum("fwd_bytes").over(w), "in_bytes": F.sum("bwd_bytes").over(w)})
    f = f.withColumn("ratio", F.col("out_bytes") / F.greatest(F.lit(1), F.col("in_bytes")))
    conf = 0.6 + 0.2 * stats.clamp01(F.log10(F.col("ratio") / ratio)) + 0.2 * stats.clamp01(F.log10(F.col("out_bytes") / least_bytes))
    return f.where((F.col("out_bytes") >= least_bytes) & (F.col("ratio") >= ratio)).withColumn("confidence", F.round(conf, 6))


def running_distinct(df: DataFrame, *, of: str, order: list[str], by: list[str] | None = None, name: str = "population") -> DataFrame:
    """How many different values of ``of`` have come up so far within ``by``: a running total of first occurrences."""
    by = by or []
    first = F.row_number().over(Window.partitionBy(*by, of).orderBy(*order)) == 1
    return ordered.running_total(df.withColumn("__first", first.cast("int")), F.col("__first"), order, by=by, name=name).drop("__first")


def tls_profile(flows: DataFrame, *, seconds: float = 21_600.0, least_sessions: int = 8) -> DataFrame:
    """Per flow of a (client, server, fingerprint) with enough sessions in the seconds before: r, t, s, p and h and
    their weighted score. Rarity counts clients of the fingerprint so far, 0 until five clients have been seen."""
    base = running_distinct(flows, of="src", order=["ts", "event_id"], by=["sensor"], name="population")
    base = running_distinct(base, of="src", order=["ts", "event_id"], by=["sensor", "ja4"], name="clients")
    # Medians are kept up to date as sessions come and go, so a busy client costs no more a session than a quiet one.
    base = ordered.trailing_state(base, ["src", "dst", "ja4"], seconds=seconds, n="__n", kinds={"__shapes": F.col("shape")}, medians={"__sizes": F.col("fwd_bytes")}, gaps="__gaps")
    n, one, zero = F.col("__n"), F.lit(1.0), F.lit(0.0)
    regular = lambda c: F.when(F.col(f"{c}.n") >= 3, 1 - F.when(F.col(f"{c}.median") > 0, F.least(one, F.col(f"{c}.mad") / F.col(f"{c}.median"))).otherwise(one)).otherwise(zero)
    f = base.where(n >= least_sessions).withColumns({
        "sessions": n,
        "r": F.when(F.col("population") < 5, zero).otherwise(1 - F.least(one, (F.col("clients") - 1) / 4)),
        "t": regular("__gaps"),
        "s": regular("__sizes"),
        "p": F.col("__shapes.most") / n,
        "h": F.least(one, F.col("flags") / 3),
    })
    return f.withColumn("score", 0.30 * F.col("r") + 0.20 * F.col("t") + 0.15 * F.col("s") + 0.15 * F.col("p") + 0.20 * F.col("h")).drop("__gaps", "__sizes", "__shapes", "__n")


def top_fingerprints(flows: DataFrame, *, n: int = 10) -> DataFrame:
    return flows.groupBy("ja4").agg(F.count("*").alias("sessions"), F.count_distinct("src").alias("clients")).orderBy(F.desc("sessions"), "ja4").limit(n)

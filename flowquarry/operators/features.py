"""Features of flows from their packets, in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _timed(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the gap to the packet before, of the flow and of the same direction."""
    order = ["ts", "event_id"]
    own = Window.partitionBy(*keys).orderBy(*order)
    side = Window.partitionBy(*keys, "forward").orderBy(*order)
    return packets.withColumns({"gap": F.col("ts") - F.lag("ts").over(own), "side_gap": F.col("ts") - F.lag("ts").over(side)})


def _stats(name: str, x, scale: float = 1.0) -> list:
    """Minimum, maximum, mean and population deviation."""
    return [
        (F.min(x) * scale).alias(f"{name}_min"), F.max(x).alias(f"{name}_max") if scale == 1.0 else (F.max(x) * scale).alias(f"{name}_max"),
        (F.avg(x) * scale).alias(f"{name}_mean"), (F.stddev_pop(x) * scale).alias(f"{name}_std"),
    ]


def cic_features(packets: DataFrame, keys: list[str], *, idle: float = 5.0) -> DataFrame:
    """Counts, bytes, sizes, gaps in microseconds, flags, rates, active and idle times of each flow, from its packets
    (forward, size, ts, event_id, flags as 0 or 1)."""
    p = _timed(packets, keys)
    fwd = lambda c: F.when(F.col("forward"), F.col(c))
    bwd = lambda c: F.when(~F.col("forward"), F.col(c))
    us = 1e6
    span = F.max("ts") - F.min("ts")
    flags = [F.max(f).alias(f"{f}_flag") for f in ("syn", "ack", "fin", "rst") if f in packets.columns]
    out = p.groupBy(*keys).agg(
        F.count(F.when(F.col("forward"), 1)).alias("tot_fwd_pkts"), F.count(F.when(~F.col("forward"), 1)).alias("tot_bwd_pkts"), F.coalesce(F.sum(fwd("size")), F.lit(0)).alias("fwd_bytes"), F.coalesce(F.sum(bwd("size")), F.lit(0)).alias("bwd_bytes"),
        (span * us).alias("duration_us"), F.when(span > 0, F.sum("size") / span).otherwise(0.0).alias("bytes_per_s"), F.when(span > 0, F.count("*") / span).otherwise(0.0).alias("pkts_per_s"),
        *_stats("pkt_len", F.col("size")), *_stats("fwd_len", fwd("size")), *_stats("bwd_len", bwd("size")), F.var_pop("size").alias("pkt_len_var"),
        *[s.alias(f"iat_{n}_us") for n, s in (("min", F.min("gap") * us), ("max", F.max("gap") * us), ("mean", F.avg("gap") * us), ("std", F.stddev_pop("gap") * us))],
        *[s.alias(f"{d}_iat_{n}_us") for d, c in (("fwd", fwd("side_gap")), ("bwd", bwd("side_gap"))) for n, s in (("sum", F.sum(c) * us), ("min", F.min(c) * us), ("max", F.max(c) * us), ("mean", F.avg(c) * us), ("std", F.stddev_pop(c) * us))],
        *flags,
    )
    island = F.sum(F.when(F.col("gap") > idle, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    spans = p.withColumn("__island", island).groupBy(*keys, "__island").agg(((F.max("ts") - F.min("ts")) * us).alias("a"), (F.max(F.when(F.col("gap") > idle, F.col("gap"))) * us).alias("i"))
    rest = spans.groupBy(*keys).agg(*_stats("active", F.col("a")), *_stats("idle", F.col("i")))
    return out.join(rest, keys)


def ett_features(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios, variations and logarithms for flows whose contents are not seen."""
    c = F.col
    f = cic_features(packets, keys)
    one = F.lit(1)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return f.withColumns({
        "byte_ratio": c("fwd_bytes") / F.greatest(one, c("bwd_bytes")), "pkt_ratio": c("tot_fwd_pkts") / F.greatest(one, c("tot_bwd_pkts")), "size_cv": ratio(c("pkt_len_std"), c("pkt_len_mean")), "iat_cv": ratio(c("iat_std_us"), c("iat_mean_us")),
        "log_bytes": F.log1p(c("fwd_bytes") + c("bwd_bytes")), "log_duration": F.log1p(c("duration_us")), "log_pkts": F.log1p(c("tot_fwd_pkts") + c("tot_bwd_pkts")), "fwd_share": ratio(c("fwd_bytes"), c("fwd_bytes") + c("bwd_bytes")),
    })

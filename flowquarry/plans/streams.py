"""Queries of the streaming operators: events come in three parts, in time order, each after a restart of the stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.corpus import shared_path
from ..streaming import jobs
from .detect import flow_table
from .registry import query
from .views import alerts, flows, packets

PARTS = 3
#: Buckets of keys whose state is kept together: 36 million events of 540,000 users are a few hundred users a bucket.
BUCKETS = 1024


def _run(
    df: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str = "ts", late: Callable[[DataFrame, float], DataFrame] | None = None, mode: str | None = None
) -> tuple[DataFrame, list[StreamingQuery]]:
    """What the stream that ``build`` makes puts out, and its runs.

    A part of the rows is put into files, the stream runs over what is new and stops, and goes on with the next part from
    its checkpoint. With a mode, batches are written each to a folder. ``late`` makes rows, from all rows and the time before which the first part ended, that come with
    the last part.
    """
    spark = df.sparkSession
    path, out, state = (shared_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    timed = df.withColumn("time", F.timestamp_micros(F.round(F.col(ts) * 1e6).cast("long")))
    cuts = sorted(set(timed.approxQuantile(ts, [i / PARTS for i in range(1, PARTS)], 0.01)))
    edges = [float("-inf"), *cuts, float("inf")]
    runs = []
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = timed.where((F.col(ts) >= low) & (F.col(ts) < high))
        if late is not None and k == len(edges) - 2 and k:
            part = part.unionByName(late(timed, edges[1]))
        part.write.mode("append").parquet(path)
        made = build(spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1000).parquet(path))
        if mode is None:
            runs.append(jobs.run_available(made, out, state))
        else:
            runs.append(jobs.write_batches(made, out, state, mode=mode))
            runs[-1].awaitTermination()
    if mode is None:
        return spark.read.schema(made.schema).parquet(out), runs
    return spark.read.schema(made.schema.add("batch", "long")).parquet(out), runs


#: Where the watermark stands at the end, in seconds.
MARK = "(SELECT (floor(max(CASE WHEN bwd_pkts > 0 THEN ts + 1 ELSE ts END) * 1000) - 10000) / 1000 FROM flows)"


@query(
    f"WITH RECURSIVE {flow_table(300, f'ts <= {MARK}')} SELECT * EXCLUDE (flow_no, ended), CASE WHEN ended <> 'end' THEN ended WHEN stub THEN 'probe' ELSE 'idle' END AS ended FROM flow "
    f"WHERE ended <> 'end' OR last_ts + CASE WHEN stub THEN 300 ELSE 7200 END < {MARK}"
)
def stm1_stream_flows(spark, sf_dir):
    """The flows that have ended by the end of the stream."""
    return _run(packets(spark, sf_dir), lambda s: jobs.stream_flows(s, idle=7200.0, active=86_400.0, probe=300.0, buckets=BUCKETS))[0].drop("flow_no")


@query(
    "WITH m AS (SELECT max(ts) - 120 AS w FROM flows) SELECT src, floor(ts / 86400)::BIGINT * 86400 AS window_start, count(*) AS n, count(*) FILTER (WHERE bwd_pkts = "
    "0) AS unanswered, count(DISTINCT dport) AS ports, count(DISTINCT dst) AS hosts FROM flows, m GROUP BY 1, 2 HAVING floor(any_value(ts) / 86400)::BIGINT "
    "* 86400 + 86400 <= any_value(w)"
)
def stm2_stream_scan_events(spark, sf_dir):
    s, _ = _run(flows(spark, sf_dir), lambda s: jobs.stream_scan_events(s, window="1 day"))
    return s.select("src", F.unix_timestamp("window.start").alias("window_start"), "n", "unanswered", "ports", "hosts")


@query(
    "WITH s AS (SELECT dst, ts, src, fwd_bytes, unnest([floor(ts / 1800)::BIGINT * 1800, floor(ts / 1800)::BIGINT * 1800 - 1800]) AS start FROM flows) SELECT dst, "
    "start, count(*) AS n, count(DISTINCT src) AS sources, sum(fwd_bytes)::BIGINT AS bytes FROM s GROUP BY ALL HAVING start + 3600 <= (SELECT max(ts) - 5 FROM "
    "flows)"
)
def stm3_stream_flood_windows(spark, sf_dir):
    s, _ = _run(flows(spark, sf_dir), lambda s: jobs.stream_flood_windows(s, window="1 hour", slide="30 minutes", exact=True))
    return s.select("dst", F.unix_timestamp("window.start").alias("start"), "n", "sources", "bytes")


@query(
    "SELECT user_id AS host, event_type AS cat, floor(ts / 3600)::BIGINT * 3600 AS start, count(*) AS n, sum(fwd_bytes)::BIGINT AS up, sum(bwd_bytes)::BIGINT AS down, "
    "count(DISTINCT dst) AS peers FROM flows GROUP BY 1, 2, 3 HAVING floor(any_value(ts) / 3600)::BIGINT * 3600 + 3600 <= (SELECT max(ts) - 420 FROM flows)"
)
def stm4_stream_behaviour_windows(spark, sf_dir):
    f = flows(spark, sf_dir).select(
        "ts", F.col("user_id").alias("host"), F.col("event_type").alias("cat"), F.col("fwd_bytes").alias("up"), F.col("bwd_bytes").alias("down"),
        F.col("dst").alias("peer"),
    )
    return _run(f, jobs.stream_behaviour_windows)[0].select("host", "cat", F.unix_timestamp("window.start").alias("start"), "n", "up", "down", "peers")


@query(
    "SELECT user_id AS host, event_type AS cat, floor(ts / 3600)::BIGINT * 3600 AS start, count(*) AS n, sum(fwd_bytes)::BIGINT AS up, sum(bwd_bytes)::BIGINT AS down, "
    "count(DISTINCT dst) AS peers FROM flows GROUP BY 1, 2, 3"
)
def stm4_provisional_windows(spark, sf_dir):
    """The same in update mode: the last row put out of every window, the open ones included."""
    f = flows(spark, sf_dir).select(
        "ts", F.col("user_id").alias("host"), F.col("event_type").alias("cat"), F.col("fwd_bytes").alias("up"), F.col("bwd_bytes").alias("down"),
        F.col("dst").alias("peer"),
    )
    found, _ = _run(f, jobs.stream_behaviour_windows, mode="update")
    return jobs.latest(found, ["window", "host", "cat"]).select("host", "cat", F.unix_timestamp("window.start").alias("start"), "n", "up", "down", "peers")


@query(
    "SELECT user_id AS host, floor(ts / 3600)::BIGINT * 3600 AS start, count(*) AS n FROM flows GROUP BY 1, 2 HAVING floor(any_value(ts) / 3600)::BIGINT * 3600 + 3600 "
    "<= (SELECT max(ts) - 21600 FROM flows)"
)
def stm5_late_rows(spark, sf_dir):
    """The rows of the first part but for its last day come a second time with the last part: too late, so they count for
    nothing."""
    f = flows(spark, sf_dir).select("ts", F.col("user_id").alias("host"))
    found, runs = _run(f, jobs.drop_and_count_late, late=lambda rows, end: rows.where(F.col("ts") < end - 86_400))
    if len(runs) > 1 and not jobs.late_rows(runs[-1]):
        raise ValueError("late rows were not counted")
    return found.select("host", F.unix_timestamp("window.start").alias("start"), "n")


from .report import COOL  # noqa: E402


@query(f"WITH RECURSIVE {COOL.format(held='(o.ts - x.last < 86400)')} SELECT id, out::BIGINT AS held FROM x WHERE ok")
def stm6_stream_cooldown(spark, sf_dir):
    a = alerts(spark, sf_dir).select("id", "ts", "src", "threat_class")
    return _run(a, lambda s: jobs.stream_cooldown(s, ["src", "threat_class"], seconds=86_400.0, buckets=BUCKETS))[0].select("id", "held")


@query()
def stm7_stream_calibrate(spark, sf_dir):
    f = flows(spark, sf_dir).select("ts", F.col("dst").alias("network"), F.col("src").alias("host"), F.floor(F.col("ts") / 3600).cast("long").alias("hour"), F.col("value").alias("error"))
    return _run(f, lambda s: jobs.stream_calibrate(s, trained=10.0))[0]


@query()
def stm8_stream_lifecycle(spark, sf_dir):
    from ..functions import net

    kinds = {"click": "step", "view": "escalate", "purchase": "open_incident", "signup": "release_incident", "error": "mark_stale"}
    e = flows(spark, sf_dir).select("ts", F.col("user_id").alias("host"), F.col("event_id").alias("seq"), net.lookup(kinds, F.col("event_type")).alias("command"), (F.col("k") % 2 == 0).alias("ready"))
    return _run(e, lambda s: jobs.stream_lifecycle(s, buckets=BUCKETS))[0]


@query(
    "WITH w AS (SELECT user_id, floor(ts / 3600)::BIGINT * 3600 AS start FROM flows GROUP BY ALL), e AS (SELECT start + 3600 <= (SELECT max(ts) - 86400 FROM "
    "flows) AS closed FROM w) SELECT CASE WHEN closed THEN 'put out' ELSE 'held' END AS what, count(*) AS n FROM e GROUP BY 1"
)
def stm9_state_limits(spark, sf_dir):
    """Hourly windows of each host that were put out, and those that state still holds: all that the delay has not passed."""
    f = flows(spark, sf_dir).select("ts", F.col("user_id").alias("host"))
    found, runs = _run(f, lambda s: jobs.with_state_limits(s, delay="1 day").groupBy(F.window("time", "1 hour"), "host").agg(F.count("*").alias("n")))
    held = spark.createDataFrame([("held", jobs.rows_held(runs[-1]))], "what string, n long").where("n > 0")
    return found.groupBy(F.lit("put out").alias("what")).agg(F.count("*").alias("n")).unionByName(held)


@query("SELECT id, threat_class FROM alerts")
def stm10_alert_sink(spark, sf_dir):
    """Every alert comes twice."""
    a = alerts(spark, sf_dir).select("id", "ts", "threat_class")
    return _run(a.unionByName(a), lambda s: jobs.once_each(s), mode="append")[0].select("id", "threat_class")


@query("SELECT threat_class, count(*) AS n FROM alerts GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM alerts")
def stm10_alert_metrics(spark, sf_dir):
    """What the sink's listener counts by class while the alerts, each twice, go through."""
    listener, kinds = jobs.AlertMetrics("alerts"), ["C2 Beacon", "DGA", "Data Exfiltration", "Port Scan", "DDoS"]
    a = alerts(spark, sf_dir).select("id", "ts", "threat_class")
    spark.streams.addListener(listener)
    try:
        runs = _run(a.unionByName(a), lambda s: jobs.with_metrics(jobs.once_each(s), "alerts", kinds), mode="append")[1]
        due = max((p["batchId"] for p in runs[-1].recentProgress), default=-1)
        for _ in range(600):  # events come after the batches that they are about
            if due <= max(listener.batches, default=-1):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(k, int(n)) for k, n in listener.totals().items() if n], "threat_class string, n long")

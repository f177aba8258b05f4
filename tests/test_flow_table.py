"""Flow assembly in batch and stream: probes, out-of-order packets, timers and an empty state at the end."""

import random

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import sessions
from flowquarry.streaming import jobs

PACKETS = "ts double, src string, dst string, sport int, dport int, proto int, flags int, payload_size int"


def flows_of(df, **limits):
    columns = ["key", "first_ts", "last_ts", "src", "dst", "sport", "dport", "proto", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "ended", "stub"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_an_unanswered_packet_is_out_after_the_probe_time(spark):
    rows = [(0.0, "a", "b", 1, 80, 6, 2, 0), (60.0, "a", "b", 1, 80, 6, 2, 0), (60.1, "b", "a", 80, 1, 6, 18, 0), (100.0, "a", "b", 1, 80, 6, 16, 5), (1.0, "a", "b", 2, 80, 6, 2, 0), (4.0, "b", "a", 80, 2, 6, 4, 0)]
    got = flows_of(sessions.assemble_flows(spark.createDataFrame(rows, PACKETS)))
    assert [(f[1], f[2], f[8], f[9], f[12], f[13]) for f in got] == [(0.0, 0.0, 1, 0, "probe", True), (60.0, 100.0, 2, 1, "end", False), (1.0, 4.0, 1, 1, "rst", False)]
    early = flows_of(sessions.assemble_flows(spark.createDataFrame(rows, PACKETS), probe=120.0))
    assert [(f[1], f[2], f[8] + f[9], f[12]) for f in early] == [(0.0, 100.0, 4, "end"), (1.0, 4.0, 2, "rst")]


@pytest.fixture(scope="module")
def traffic():
    rng, rows = random.Random(11), []
    for key in range(25):
        t = rng.uniform(0, 50)
        for _ in range(rng.choice([1, 1, 2, 30])):
            there = rng.random() < 0.6
            flags = rng.choices([16, 2, 18, 17, 4], [12, 3, 2, 1, 1])[0]
            ends = ("a", "b", 1000 + key, 80) if there else ("b", "a", 80, 1000 + key)
            rows.append((round(t, 3), *ends, 6, flags, rng.randrange(100)))
            t += rng.choice([0.2, 2.0, 4.9, 5.5, 9.0, 30.0])
    return rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_streamed_flows_equal_the_batch_and_state_is_empty_at_the_end(spark, tmp_path, traffic, shuffled):
    jobs.use_rocksdb(spark)
    limits = {"idle": 20.0, "active": 40.0, "linger": 6.0, "probe": 5.0}
    df = spark.createDataFrame(traffic, PACKETS).withColumn("time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
    # Packets come up to six seconds late, which the delay allows for.
    rng = random.Random(3)
    order = sorted(traffic, key=lambda p: p[0] + (rng.uniform(0, 6) if shuffled else 0))
    end = max(p[0] for p in traffic)
    parts = [order[i * len(order) // 4 : (i + 1) * len(order) // 4] for i in range(4)]
    # A last packet takes the watermark past all others; a key that has packets before and after it does not wait for its own last.
    parts[-1].append((end + 500.0, "a", "b", 1000, 80, 6, 2, 0))
    for part in parts:
        spark.createDataFrame(part, PACKETS).withColumn("time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_flows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), delay="10 seconds", **limits)
        q = jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = flows_of(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))
    want = flows_of(sessions.assemble_flows(df, **limits))
    closed = sorted((*f[:12], ("probe" if f[13] else "idle") if f[12] == "end" else f[12], f[13]) for f in want)
    assert got == closed and {"probe", "idle", "fin", "rst"} <= {f[12] for f in got}
    # Only the last packet is left, and its timer.
    assert jobs.rows_held(q) <= 4

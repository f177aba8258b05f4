"""State of keyed streams that stays bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.functions.sketch import Quantiles
from flowquarry.plans.streams import _run
from flowquarry.streaming import jobs


@pytest.mark.parametrize("order", ["mixed", "rising", "falling", "ties"])
def test_quantiles_are_within_the_stated_error(order):
    x = np.random.default_rng(5).lognormal(size=300_001)
    x = {"mixed": x, "rising": np.sort(x), "falling": np.sort(x)[::-1], "ties": np.floor(x)}[order]
    parts = []
    for own in np.array_split(x, 3):
        parts.append(Quantiles(1024))
        for few in np.array_split(own, 97):
            parts[-1].add(np.append(few, np.nan))
            parts[-1] = Quantiles(1024, parts[-1].state())  # as keyed state holds it
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p)
    assert whole.count() == len(x) and whole.rank_error() < 0.011 and sum(map(len, whole.buffers)) <= 1024 * len(whole.buffers)
    for share in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
        got = whole.at(share)
        low, high = (x < got).mean(), (x <= got).mean()
        assert low - whole.rank_error() <= share <= high + whole.rank_error()


def test_few_values_have_exact_quantiles():
    x = np.random.default_rng(6).normal(size=900)
    q = Quantiles(1024)
    q.add(x)
    assert [q.at(s) for s in (0, 0.37, 0.99, 1)] == pytest.approx(np.quantile(x, [0, 0.37, 0.99, 1]).tolist())
    assert np.isnan(Quantiles().at(0.5))


def test_calibration_by_sketch_is_near_the_exact_one(spark):
    rows = spark.range(0, 9000).select(
        (F.col("id") * 10.0).alias("ts"), F.lit("n").alias("network"), F.lit("h").alias("host"), F.floor(F.col("id") / 360).cast("long").alias("hour"), (F.rand(3) * 1000).alias("error"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    by = {e: _run(rows, lambda s, e=e: jobs.stream_calibrate(s, trained=1.0, size=256, exact=e))[0].collect() for e in (False, True)}
    (near,), (exact,) = by[False], by[True]
    assert exact.threshold == pytest.approx(np.quantile([r.error for r in rows.collect()], 0.99)) and exact.device_hours == near.device_hours == 25
    assert abs(near.threshold - exact.threshold) < 1000 * 7 / 256


def test_hosts_that_say_nothing_are_forgotten(spark):
    rows = [(1e6 + t, h, seq, c, True) for seq, (t, h, c) in enumerate([(0, 1, "step"), (10, 1, "escalate"), (20, 2, "step"), (5000, 3, "step"), (5010, 2, "escalate"), (9000, 3, "step")])]
    df = spark.createDataFrame(rows, "ts double, host long, seq long, command string, ready boolean")
    kept, runs = _run(df, jobs.stream_lifecycle)
    assert {r.seq: r.state for r in kept.collect()} == {0: "SENTRY_PRIMARY", 1: "ESCALATED", 2: "SENTRY_PRIMARY", 3: "SENTRY_PRIMARY", 4: "ESCALATED", 5: "SENTRY_PRIMARY"}
    assert jobs.rows_held(runs[-1]) == 3
    short, runs = _run(df, lambda s: jobs.stream_lifecycle(s, live=1000.0, delay="1 second"))
    states = {r.seq: r.state for r in short.collect()}
    assert states[1] == "ESCALATED" and states[4] == "COMMISSIONING"  # host 2 started anew
    assert jobs.rows_held(runs[-1]) == 1


def test_held_alerts_are_told_of_when_their_key_is_closed(spark):
    rows = [(1e6 + t, i, "a" if t < 100 else "b") for i, t in enumerate([0, 1, 2, 500, 900, 5000])]
    df = spark.createDataFrame(rows, "ts double, id long, src string")
    got, runs = _run(df, lambda s: jobs.stream_cooldown(s, ["src"], seconds=10.0, close_after=60.0))
    assert sorted((r.src, r.id is None, r.held) for r in got.collect()) == [("a", False, 0), ("a", True, 2), ("b", False, 0), ("b", False, 0), ("b", False, 0)]
    assert jobs.rows_held(runs[-1]) <= 1


def test_sources_of_a_flood_are_counted_exactly(spark):
    rows = spark.range(0, 9000).select((1e6 + F.col("id") / 10).alias("ts"), F.lit("d").alias("dst"), F.concat(F.lit("s"), F.col("id") % 4001).alias("src"), F.lit(17).alias("proto"), F.lit(2).cast("long").alias("fwd_bytes"))
    got = _run(rows, lambda s: jobs.stream_flood_windows(s, window="10 minutes", slide="5 minutes", exact=True))[0]
    want = rows.groupBy(F.window(F.timestamp_seconds("ts"), "10 minutes", "5 minutes")).agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.sum("fwd_bytes").alias("bytes"))
    want = {r.window.start: (r.n, r.sources, r.bytes, 1.0) for r in want.collect() if r.window.end.timestamp() <= 1e6 + 899.9 - 5}
    assert len(want) > 1 and {r.window.start: (r.n, r.sources, r.bytes, r.udp_share) for r in got.collect()} == want
    from flowquarry.plans import streams

    assert "exact=True" in __import__("inspect").getsource(streams.stm3_stream_flood_windows)


@pytest.fixture(scope="module")
def few_commands(spark):
    commands = ["step", "escalate", "open_incident", "release_incident", "mark_stale"]
    rows = [(1e6 + 37.0 * i, i % 11, i, commands[(i * 7 + i // 11) % 5], i % 2 == 0) for i in range(300)]
    return spark.createDataFrame(rows, "ts double, host long, seq long, command string, ready boolean")


@pytest.mark.parametrize("live", [None, 300.0])
def test_lifecycle_in_buckets(spark, few_commands, live):
    (kept, _), (many, runs) = (_run(few_commands, lambda s, b=b: jobs.stream_lifecycle(s, live=live, delay="1 second", buckets=b)) for b in (None, 3))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, kept.collect()))
    assert jobs.rows_held(runs[-1]) <= 3


@pytest.mark.parametrize("close_after", [None, 900.0])
def test_cooldown_in_buckets(spark, few_commands, close_after):
    a = few_commands.select("ts", F.col("seq").alias("id"), "host", "command")
    (kept, _), (many, runs) = (_run(a, lambda s, b=b: jobs.stream_cooldown(s, ["host"], seconds=600.0, close_after=close_after, buckets=b)) for b in (None, 3))
    got = sorted(map(str, many.collect()))
    assert got == sorted(map(str, kept.collect())) and len(got) > 20
    assert jobs.rows_held(runs[-1]) <= 3


def test_flows_in_buckets(spark):
    rows = [(1e6 + 3.0 * i + (0.5 if i % 7 == 0 else 0.0), f"h{i % 13}", "d", 1000 + i % 3, 80, 6, 2 if i % 9 == 0 else 17 if i % 31 == 0 else 16, i) for i in range(400)]
    df = spark.createDataFrame(rows, "ts double, src string, dst string, sport int, dport int, proto int, flags int, payload_size long")
    from flowquarry.operators.sessions import assemble_flows

    many = _run(df, lambda s: jobs.stream_flows(s, idle=60.0, active=200.0, probe=30.0, buckets=3))[0]
    mark = max(r[0] for r in rows) - 10
    batch = [r for r in assemble_flows(df.where(F.col("ts") <= mark), idle=60.0, active=200.0, probe=30.0).drop("flow_no").collect() if r.ended != "end"]
    got = {(r.key, r.first_ts): r for r in many.drop("flow_no").collect()}
    assert len(batch) > 20 and all(got[r.key, r.first_ts] == r for r in batch)

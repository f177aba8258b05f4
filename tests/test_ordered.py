"""Folds, trailing windows and running totals against plain loops, also with nearly all rows on one key."""

import math
import random
import statistics
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import ordered
from flowquarry.operators import alerts, scan, sessions


def hot_rows(n, seed=2):
    rng = random.Random(seed)
    return [(
        i, "hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", round(rng.uniform(0, n / 50), 1), rng.choice("abcdefgh") if rng.random() < 0.9 else None,
        rng.randrange(100),
    ) for i in range(n)]


def trailing(rows, seconds):
    out = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: r[2])
        lo = hi = 0
        for r in own:
            while hi < len(own) and own[hi][2] <= r[2]:
                hi += 1
            while own[lo][2] < r[2] - seconds:
                lo += 1
            inside = own[lo:hi]
            counts = Counter(x[3] for x in inside if x[3] is not None)
            n = sum(counts.values())
            bits = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
            out[r[0]] = (len(inside), inside[0][2], sum(x[4] for x in inside), len(counts), max(counts.values(), default=0), bits)
    return out


@pytest.mark.parametrize("seconds", [0.5, 3.0, 1000.0])
def test_trailing_state(spark, seconds):
    rows = hot_rows(1500)
    df = spark.createDataFrame(rows, "id long, key string, ts double, kind string, size int").repartition(7)
    got = ordered.trailing_state(df, ["key"], seconds=seconds, first="first", sums={"total": F.col("size")}, kinds={"k": F.col("kind")}).collect()
    want = trailing(rows, seconds)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.first, r.total, r.k.kinds, r.k.most) == want[r.id][:5] and r.k.bits == pytest.approx(want[r.id][5], abs=1e-9)


def test_trailing_state_of_odd_rows(spark):
    rows = [(1, "a", None, "x"), (2, "a", None, "y"), (3, "a", 0.0, None), (4, "a", -5.0, "x"), (5, None, 1.0, "x"), (6, None, 1.0, "x")]
    df = spark.createDataFrame(rows, "id long, key string, ts double, kind string")
    got = {r.id: (r.n, r.k.kinds, r.k.most) for r in ordered.trailing_state(df, ["key"], seconds=2.0, kinds={"k": F.col("kind")}).collect()}
    assert got == {1: (2, 2, 1), 2: (2, 2, 1), 3: (1, 0, 0), 4: (1, 1, 1), 5: (2, 1, 2), 6: (2, 1, 2)}
    assert ordered.trailing_state(df.where("false"), ["key"], seconds=2.0).count() == 0


def test_a_hot_key_of_200000_rows(spark):
    n = 200_000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.col("id"), F.lit("hot").alias("src"), F.lit("d").alias("dst"), (F.col("id") * 0.1).alias("ts"), F.lit(1).alias("fwd_bytes"),
        (F.col("id") % 2).alias("alpha"), F.col("id").alias("window_start"),
    )
    state = ordered.trailing_state(rows, ["src"], seconds=10.0, kinds={"k": F.col("id") % 7})
    assert state.agg(F.max("n"), F.max("k.kinds"), F.count("*")).first() == (101, 7, n)
    assert sessions.merge_checkins(rows, ["src", "dst"], gap=5.0).agg(F.count("*"), F.sum("b")).first() == (n // 50, float(n))
    assert scan.sprt(rows).where("decision = 'pending'").count() == n
    assert alerts.cooldown(rows, ["src"], seconds=5.0).agg(F.count("*"), F.sum("held")).first()[0] == n // 50
    counted = sessions.count_sessions(rows, ["src"], n=100, horizon=1e9)
    assert counted.agg(F.count("*"), F.max("session")).first() == (n // 100, n // 100 - 1)
    assert ordered.running_total(rows, F.lit(1), ["ts", "id"], by=["src"], name="number").where("number <> id + 1").count() == 0


def test_running_total(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.5, 7.0]), rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, by string, at double, v int")
    for by in ([], ["by"]):
        got = {r.id: r.total for r in ordered.running_total(df, F.col("v"), ["at", "id"], by=by, name="total", buckets=5).collect()}
        sums, want = Counter(), {}
        for i, k, at, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            sums[k if by else 0] += v
            want[i] = sums[k if by else 0]
        assert got == want


def test_folds_of_odd_rows(spark):
    rows = [(1, "a", 5.0), (2, "a", 1.0), (3, None, 1.0), (4, None, 2.0), (5, "b", 0.0)]
    df = spark.createDataFrame(rows, "id long, src string, ts double")
    assert {(r.id, r.held) for r in alerts.cooldown(df, ["src"], seconds=3.0).collect()} == {(2, 0), (1, 0), (3, 0), (5, 0)}
    assert {(r.id, r.held) for r in alerts.cooldown(df, ["src"], seconds=4.0, inclusive=True).collect()} == {(2, 0), (3, 0), (5, 0)}
    assert alerts.cooldown(df.where("false"), ["src"], seconds=3.0).count() == 0
    merged = sessions.merge_checkins(df.withColumns({"event_id": F.col("id"), "fwd_bytes": F.lit(2)}), ["src"], gap=1.5)
    assert {(r.src, r.t, r.b) for r in merged.collect()} == {("a", 1.0, 2.0), ("a", 5.0, 2.0), (None, 1.0, 4.0), ("b", 0.0, 2.0)}


def test_quantiles(spark):
    import numpy as np

    rng = random.Random(3)
    for n in (1, 2, 5, 400):
        x = [rng.choice([1.5, 2.0, rng.random()]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
        (r,) = ordered.quantiles(df, "x", {"a": 0.0, "b": 0.5, "c": 0.99}).collect()
        assert [r.a, r.b, r.c] == pytest.approx(np.quantile(x, [0, 0.5, 0.99]).tolist(), abs=1e-12)
    assert ordered.quantiles(df.where("false"), "x", {"b": 0.5}).first().b is None


def test_medians_of_a_changing_window():
    rng = random.Random(8)
    for most in (4, 512):
        ordered._Sorted.MOST, held, window = most, ordered._Sorted(), []
        for i in range(3000):
            if window and rng.random() < (0.4 if i < 1800 else 0.6):
                held.change(window.pop(rng.randrange(len(window))), -1)
            else:
                window.append(rng.choice([rng.uniform(-5, 5), float(rng.randrange(-3, 4))]))
                held.change(window[-1], 1)
            state = held.state()
            if not window:
                assert state == {"n": 0, "median": None, "mad": None}
                continue
            middle = statistics.median(window)
            assert state["n"] == len(window) and state["median"] == middle
            assert state["mad"] == pytest.approx(statistics.median([abs(x - middle) for x in window]), abs=1e-12)
            assert all(held.blocks) and max(map(len, held.blocks)) <= most and held.highest == [b[-1] for b in held.blocks]


@pytest.mark.parametrize("seconds", [2.0, 40.0, 1000.0])
def test_medians_and_gaps_of_trailing_windows(spark, seconds):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.8 else None, round(rng.uniform(0, 60), 1) if rng.random() < 0.98 else 7.0, rng.choice([None, 1.5, 2.5, rng.random()])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, key string, ts double, size double").repartition(5)
    for r in ordered.trailing_state(df, ["key"], seconds=seconds, medians={"m": F.col("size")}, gaps="g").collect():
        inside = sorted((x for x in rows if x[1] == r.key and r.ts - seconds <= x[2] <= r.ts), key=lambda x: x[2])
        sizes, gaps = [x[3] for x in inside if x[3] is not None], [b[2] - a[2] for a, b in zip(inside, inside[1:])]
        for state, own in ((r.m, sizes), (r.g, gaps)):
            assert state.n == len(own)
            if own:
                middle = statistics.median(own)
                assert state.median == pytest.approx(middle, abs=1e-9) and state.mad == pytest.approx(statistics.median([abs(x - middle) for x in own]), abs=1e-9)


def test_a_busy_client_costs_no_more_a_session():
    def seconds(n):
        held, window = ordered._Sorted(), []
        began = time.process_time()
        for i in range(n):
            window.append(float(i * 7919 % 10_007))
            held.change(window[-1], 1)
            held.state()
        return time.process_time() - began

    few, many = min(seconds(5_000) for _ in range(3)), min(seconds(20_000) for _ in range(2))
    assert many < 4 * few * 2.5


@pytest.mark.parametrize(("n", "length"), [(1, 7), (5, 9), (20, 20), (50, 64), (3000, 4000)])
def test_counts_over_the_last_rows(spark, n, length):
    rng = random.Random(n)
    rows = [(i, "hot" if rng.random() < 0.9 else rng.choice(["k", None]), float(rng.randrange(300)), rng.choice(["a", "b", "c", None]), rng.randrange(4), rng.choice([True, False, None])) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, key string, ts double, x string, y int, ok boolean").repartition(6)
    got = ordered.last_counts(df, ["key"], ["ts", "id"], n=n, same={"cx": ["x"], "cxy": ["x", "y"]}, of={"good": F.col("ok")}, slice_rows=length)
    assert got.columns == [*df.columns, "cx", "cxy", "good"]
    want = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for at, r in enumerate(own):
            last = own[max(0, at - n + 1) : at + 1]
            want[r[0]] = (sum(o[3] == r[3] for o in last if r[3] is not None), sum(o[3:5] == r[3:5] for o in last if r[3] is not None), sum(o[5] is True for o in last))
    assert {r.id: (r.cx, r.cxy, r.good) for r in got.collect()} == want
    assert ordered.last_counts(df.where("false"), ["key"], ["ts", "id"], n=n, same={"cx": ["x"]}).count() == 0


def test_one_sensor_is_many_tasks(spark):
    df = spark.range(0, 40_000).selectExpr("id", "'one' as sensor", "cast(id as double) as ts", "id % 7 as x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be put together again
    try:
        got = ordered.last_counts(df, ["sensor"], ["ts", "id"], n=100, same={"c": ["x"]}).withColumn("task", F.spark_partition_id())
        assert got.select("task").distinct().count() > 1
        assert tuple(got.where("id >= 99").agg(F.min("c"), F.max("c")).first()) == (15, 15)  # its own and every seventh before it
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

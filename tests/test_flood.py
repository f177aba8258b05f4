"""A flooded destination: its rows stream through a task and are not gathered."""

import contextlib
import io
import math
import random
import time
import weakref
from collections import Counter

import pandas as pd
import pytest

from flowquarry.functions import ordered
from flowquarry.operators import flood
from flowquarry.streaming import jobs


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_baselines_and_evaluations_of_a_flooded_destination(spark):
    rows = [(i, "hot" if i % 3 else f"d{i % 7}", i * 0.01, 1 + i * 37 % 101, 1.0 + i * 53 % 89, "SYN flood" if i % 5 == 0 else None) for i in range(30_000)]
    w = spark.createDataFrame(rows, "event_id long, dst string, ts double, n long, rate double, family string").repartition(8)
    base, judged = flood.ewma_baseline(w, alpha=0.05, factor=1.5), flood.evaluations(w, seconds=1.0, growth=50)
    assert "collect_list" not in plan(base) + plan(judged)
    average, last, want, due = {}, {}, {}, set()
    for i, d, ts, n, rate, family in rows:
        b = average.get(d)
        want[i] = (b, b is None or rate >= 1.5 * b)
        if family is None:
            average[d] = rate if b is None else 0.95 * b + 0.05 * rate
        t, m = last.get(d, (-1e18, 0))
        if ts - t >= 1.0 or n >= 2 * m and n - m >= 50:
            last[d] = (ts, n)
            due.add(i)
    assert {r.event_id: (r.baseline, r.over) for r in base.select("event_id", "baseline", "over").collect()} == want
    assert {r.event_id for r in judged.collect()} == due


def test_calibration_takes_frames_one_at_a_time():
    class Stream:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, run, *_):
            return run

    class State:
        exists = False

        def update(self, value):
            self.value = value

    alive, most = [], 0

    def frames():
        nonlocal most
        for k in range(12):
            frame = pd.DataFrame({"ts": range(100), "host": [f"h{x % 4}" for x in range(100)], "hour": k, "error": [float(k * 100 + x) for x in range(100)]})
            alive.append(weakref.ref(frame))
            most = max(most, sum(r() is not None for r in alive))
            yield frame

    state = State()
    (out,) = jobs.stream_calibrate(Stream(), trained=1.0)(("net",), frames(), state)
    assert out.values.tolist() == [["net", pd.Series(range(1200)).quantile(0.99), 48]] and state.value == ([], [], True)
    assert most <= 2


def test_heaviest_members_against_counters():
    """Rows come and go at random; the commonest values, those with one count in order, as from a counter made anew."""
    rng = random.Random(5)
    for top in (1, 3, 5):
        kinds, window = ordered._Kinds(top), []
        for i in range(4000):
            if window and rng.random() < (0.35 if i < 2500 else 0.7):
                kinds.change(window.pop(rng.randrange(len(window)) if rng.random() < 0.5 else 0), -1)
            else:
                window.append(f"v{min(int(rng.expovariate(0.3)), 40):02d}")
                kinds.change(window[-1], 1)
            counts = Counter(window)
            state = kinds.state()
            assert [(x["value"], x["n"]) for x in state["top"]] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]
            assert state["kinds"] == len(counts) and state["most"] == max(counts.values(), default=0)
            held = sum(len(b.heap) for b in _buckets(kinds))
            assert held <= sum(2 * len(b.values) + 17 for b in _buckets(kinds))


def _buckets(kinds):
    bucket = kinds.lowest
    while bucket:
        yield bucket
        bucket = bucket.higher


def test_many_sources_cost_no_more_a_row():
    def seconds(n):
        kinds = ordered._Kinds(5)
        began = time.process_time()
        for i in range(n):
            kinds.change(f"10.{i % n >> 8}.{i & 255}.1", 1)
            kinds.state()
        return time.process_time() - began

    few, many = min(seconds(10_000) for _ in range(3)), min(seconds(40_000) for _ in range(2))
    assert many < 4 * few * 2.5


def reflection(n, sport, start=0.0, first=0):
    return [(first + i, f"198.51.{i % 60}.7", "10.0.0.9", sport, 40_000 + i % 50, 17, start + i * 0.05, 1, 0, 3000, 0, 0, 0) for i in range(n)]


FLOWS = "event_id long, src string, dst string, sport int, dport int, proto int, ts double, fwd_pkts int, bwd_pkts int, fwd_bytes long, bwd_bytes long, syn int, ack int"


def test_reflections_name_their_service(spark):
    rows = reflection(60, 123) + reflection(60, 389, 100.0, 1000) + reflection(60, 5000, 200.0, 2000)
    w = flood.flood_family(flood.flood_window(flood.flow_record(spark.createDataFrame(rows, FLOWS))))
    found = {r.event_id: r for r in w.collect()}
    for first, family in ((0, "UDP reflection/amplification (NTP)"), (1000, "UDP reflection/amplification (CLDAP)"), (2000, "UDP flood")):
        assert {found[first + i].family for i in range(19)} == {None} and {found[first + i].family for i in range(19, 60)} == {family}
    last = found[59]
    assert last.top_sport == 123 and last.amplifier_share == 1.0 and last.amplifier_service == "NTP"
    assert [tuple(x) for x in last.top_sources] == sorted([(f"198.51.{i}.7", 1) for i in range(60)])[:5]
    assert not found[59].spoofed and found[2059].family == "UDP flood"


def test_mixed_ports_below_the_share_are_plain_floods(spark):
    rows = [(*r[:3], (123, 389, 53, 6000)[i % 4], *r[4:]) for i, r in enumerate(reflection(80, 0))]
    w = flood.flood_family(flood.flood_window(flood.flow_record(spark.createDataFrame(rows, FLOWS))))
    last = max(w.collect(), key=lambda r: r.event_id)
    assert (last.family, last.top_sport, last.amplifier_share, last.amplifier_service) == ("UDP flood", 53, 0.25, "DNS")


def test_one_client_is_no_distributed_flood(spark):
    rows = [(i, "192.168.1.30", "203.0.113.53", 40_000 + i, 53, 17, i / 250.0, 2, 0, 80, 0, 0, 0) for i in range(250)]
    w = flood.flood_family(flood.flood_window(flood.flow_record(spark.createDataFrame(rows, FLOWS))))
    last = max(w.collect(), key=lambda r: r.event_id)
    assert (last.family, last.sources, last.spoofed) == ("UDP flood", 1, False) and last.rate >= 100
    assert flood.flood_alerts(flood.ewma_baseline(w)).count() == 0


def test_slices_without_lists(spark):
    rows = reflection(500, 123) + [(9000 + i, "1.2.3.4", "10.0.0.9", 1, 2, 6, i * 0.01, 1, 0, 10, 0, 1, 0) for i in range(300)]
    slices = flood.flood_slices(flood.flow_record(spark.createDataFrame(rows, FLOWS)))
    assert "collect_list" not in plan(slices)
    for r in slices.collect():
        low = r.start.timestamp()
        counts = Counter(x[1] for x in rows if low <= x[6] < low + 10)
        n = sum(counts.values())
        assert r.n == n and r.sources == len(counts)
        assert r.entropy_bits == pytest.approx(-sum(c / n * math.log2(c / n) for c in counts.values()), abs=1e-9)

"""Small tables with results known by hand."""

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import net, stats, text
from flowquarry.operators import audit, beacon, flood, scan, sessions


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_addresses(spark):
    ips = ["10.0.0.1", "8.8.8.8", "224.0.0.251", "fe80::1", "fd00::1", "2001:db8::1", "::1", "::", "01.2.3.4", "x", None]
    rows = [(i,) for i in ips]
    assert values(spark, net.is_internal(F.col("ip")), rows, "ip string") == [True, False, False, False, True, False, False, False, False, False, False]
    assert values(spark, net.is_external(F.col("ip")), rows, "ip string") == [False, True, False, False, False, True, False, False, False, False, False]
    assert values(spark, net.is_group_dst(F.col("ip")), rows, "ip string") == [False, False, True, False, False, False, False, True, False, False, False]


def test_community_id_published_vector_and_both_directions(spark):
    rows = [("128.232.110.120", "66.35.250.204", 34855, 80, 6), ("66.35.250.204", "128.232.110.120", 80, 34855, 6)]
    c = net.community_id(*[F.col(x) for x in ("s", "d", "sp", "dp", "p")])
    assert values(spark, c, rows, "s string, d string, sp int, dp int, p int") == ["1:LQU9qZlK+B5F3KDmev6m5PMibrg="] * 2


def test_base_domain(spark):
    names = [("a.b.Example.com.",), ("x.example.co.in",), ("localhost",), ("",), ("co.in",)]
    assert values(spark, text.base_domain(F.col("n")), names, "n string") == ["example.com", "example.co.in", "localhost", "", "co.in"]


def test_anchor_is_the_first_start_of_a_group(spark):
    rows = [(i, "a", t, float(i + 1)) for i, t in enumerate([0.0, 4.0, 8.0, 9.0, 20.0])]
    df = spark.createDataFrame(rows, "event_id long, src string, ts double, fwd_bytes double")
    assert sorted((x.t, x.b) for x in sessions.merge_checkins(df, ["src"], gap=5.0).collect()) == [(0.0, 3.0), (8.0, 7.0), (20.0, 5.0)]
    (series,) = sessions.checkin_series(df, ["src"], gap=5.0).collect()
    assert (series.times, series.sizes) == ([0.0, 8.0, 20.0], [3.0, 7.0, 5.0])


def test_statistics(spark):
    one = lambda c, x: values(spark, c(F.col("x")), [(x,)], "x array<double>")[0]
    assert one(stats.mad_ratio, [60.0] * 30) == 0 and one(stats.mad_ratio, []) == 1 and one(stats.mad_ratio, [0.0, 0.0]) == 1
    assert one(stats.shannon_bits, [1.0, 1.0, 1.0, 1.0]) == 2
    assert one(stats.median, [3.0, 1.0, 2.0, 10.0]) == 2.5


def flow_rows(spark, rows):
    cols = (
        "event_id long, ts double, src string, dst string, sport int, dport int, proto int, fwd_pkts int, bwd_pkts int, fwd_bytes long, bwd_bytes long, syn int, ack "
        "int, rst int, fin int, last_seen double"
    )
    return spark.createDataFrame(rows, cols)


def test_regular_checkins_score_high_and_random_ones_low(spark):
    import random

    rng = random.Random(1)
    rows = [(i, 60.0 * i, "10.0.0.1", "203.0.113.5", 1000 + i, 443, 6, 3, 3, 500, 900, 1, 1, 0, 0, 60.0 * i) for i in range(40)]
    t = 0.0
    for i in range(40):
        t += rng.expovariate(1 / 60)
        rows.append((100 + i, t, "10.0.0.2", "203.0.113.6", 2000 + i, 443, 6, 3, 3, rng.randrange(100, 90_000), 900, 1, 1, 0, 0, t))
    got = {r.src: r for r in beacon.beacon_scores(flow_rows(spark, rows), window_seconds=21_600, least_span=600.0).collect()}
    assert got["10.0.0.1"].t == pytest.approx(1) and got["10.0.0.1"].s == pytest.approx(1)
    assert got["10.0.0.1"].score > got["10.0.0.2"].score


def test_flood_of_many_sources_is_named_and_a_lookup_burst_is_not(spark):
    syn = [(i, i * 0.005, f"198.51.{i // 250}.{i % 250}", "10.0.0.9", 1024 + i, 80, 6, 1, 0, 60, 0, 1, 0, 0, 0, i * 0.005) for i in range(400)]
    dns = [(1000 + i, i * 0.01, "10.0.0.3", "10.0.0.53", 1024 + i, 53, 17, 1, 1, 60, 90, 0, 0, 0, 0, i * 0.01) for i in range(205)]
    w = flood.flood_family(flood.flood_window(flood.flow_record(flow_rows(spark, syn + dns))))
    fired = flood.flood_alerts(w.withColumn("over", F.lit(True))).collect()
    assert {(r.dst, r.family) for r in fired} == {("10.0.0.9", "SYN flood")} and any(r.spoofed for r in fired)


def test_succession_resets_on_a_clean_window(spark):
    rows = [("a", 0, 1), ("a", 60, 2), ("a", 120, 1), ("a", 240, 0), ("a", 300, 3)]
    got = scan.succession(spark.createDataFrame(rows, "src string, window_start long, alpha int")).orderBy("window_start").collect()
    assert [r.succession for r in got] == [1, 2, 3, 0, 1]


def test_flow_assembly(spark):
    p = lambda ts, a, b, sp, dp, flags, size=10: (ts, a, b, sp, dp, 6, flags, size)
    rows = [
        p(0.0, "a", "b", 1, 80, 2), p(0.1, "b", "a", 80, 1, 18), p(0.2, "a", "b", 1, 80, 1), p(5.0, "b", "a", 80, 1, 16), p(6.0, "a", "b", 1, 80, 2), p(200.0, "a", "b", 1, 80, 16), p(50.0, "c", "b", 9, 80, 2),
    ]
    df = spark.createDataFrame(rows, "ts double, src string, dst string, sport int, dport int, proto int, flags int, payload_size int")
    got = sorted((r.key, r.flow_no, r.fwd_pkts, r.bwd_pkts, r.ended, r.stub) for r in sessions.assemble_flows(df).collect())
    assert [x[1:] for x in got] == [(0, 2, 1, "fin", False), (1, 1, 0, "probe", True), (2, 1, 0, "end", True), (0, 1, 0, "end", True)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 13])
def test_merkle_roots_split_at_powers_of_two(n):
    import hashlib

    leaves = [hashlib.sha256(b"\0" + bytes([i])).digest() for i in range(n)]

    def root(x):
        if len(x) == 1:
            return x[0]
        k = 1 << (len(x) - 1).bit_length() - 1
        return hashlib.sha256(b"\x01" + root(x[:k]) + root(x[k:])).digest()

    head = audit.TreeHead()
    for leaf in leaves:
        head.add(leaf)
    assert head.root() == root(leaves)

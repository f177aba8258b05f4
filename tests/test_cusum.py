"""Cumulative sums where rows share their place in the order, as replayed events do."""

from flowquarry.operators import behaviour


def test_value_is_that_of_the_row_that_passes(spark):
    rows = [("a", 1, 10.0)] * 3 + [("a", 2, 90.0)] * 6 + [("a", 3, 95.0)] * 6 + [("b", 1, 260.0)] * 4 + [("c", 7, x) for x in (300.0, 20.0, 160.0)] + [("d", 1, 60.0)] * 9
    want, sums = {}, {}
    for host, seq, x in sorted(rows):
        sums[host] = max(0.0, sums.get(host, 0.0) + (x - 50) / 50 - 0.5)
        if sums[host] > 3 and host not in want:
            want[host] = (seq, round(sums[host], 6))
    assert set(want) == {"a", "b", "c"}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "host string, seq long, score double").repartition(parts)
        got = {r.host: (r.alarm_at, round(r.value, 6)) for r in behaviour.cusum(df, mu0=50.0, sigma=50.0, h=3.0).collect()}
        assert got == want

"""The corpus of behaviour windows."""

from flowquarry.sources import corpus


def test_each_of_many_hosts_keeps_a_name_of_its_own(spark):
    rows = spark.createDataFrame([(f"h{i:04d}", i, "web", False) for i in range(1, 1102)], "host string, lhour long, cat string, flagged boolean")
    got = {r.lhour: r.host for r in corpus.export_pseudonymised(rows).collect()}
    assert got == {i: f"site-{i:02d}" for i in range(1, 1102)}

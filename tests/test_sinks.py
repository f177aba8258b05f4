"""Streaming sinks that a batch may reach twice, their metrics, and state of bounded size."""

import pytest
from pyspark.sql import functions as F

from flowquarry.streaming import jobs

ALERT = "id long, ts double, threat_class string"


def with_time(df):
    return df.withColumn("time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))


def test_a_batch_that_runs_again_leaves_one_copy(spark, tmp_path):
    rows = [(i, 100.0 + i, "DGA" if i % 3 else "DDoS") for i in range(60)]
    with_time(spark.createDataFrame(rows + rows, ALERT)).write.parquet(str(tmp_path / "in"))
    schema = with_time(spark.createDataFrame([], ALERT)).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.write_alert_stream(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    for c in commits:  # as if the driver was lost after writing and before each commit
        c.unlink()
        (c.parent / f".{c.name}.crc").unlink(missing_ok=True)
    jobs.write_alert_stream(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))


def sweep(spark, n):
    df = spark.range(0, n).selectExpr("cast(120 + id / 2000.0 as double) as ts", "'10.0.0.1' as src", "concat('10.1.', id % 7, '.', id % 11) as dst", "cast(id % 65535 as int) as dport", "0 as bwd_pkts", "1L as fwd_bytes", "6 as proto")
    return with_time(df)


@pytest.mark.parametrize("kind", ["scan", "flood"])
def test_sketches_bound_state_and_are_close(spark, tmp_path, kind):
    make = {"scan": jobs.stream_scan_events, "flood": lambda s, exact=False: jobs.stream_flood_windows(s.withColumn("src", F.concat("src", "dport")).withColumn("dst", F.lit("d")), window="60 seconds", slide="60 seconds", exact=exact)}[kind]
    sweep(spark, 65_535).unionByName(sweep(spark, 1).withColumn("ts", F.lit(9000.0)).withColumn("time", F.timestamp_seconds(F.lit(9000)))).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema, held, found = sweep(spark, 1).schema, {}, {}
    for exact in (False, True):
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), exact=exact)
        q = jobs.run_available(stream, str(tmp_path / f"out{exact}"), str(tmp_path / f"state{exact}"))
        held[exact] = max(op["memoryUsedBytes"] for p in q.recentProgress for op in p["stateOperators"])
        found[exact] = {r.window.start: r for r in spark.read.schema(stream.schema).parquet(str(tmp_path / f"out{exact}")).collect()}
    assert found[True].keys() == found[False].keys() and len(found[True]) == 1
    for at, exact in found[True].items():
        for c in ("ports", "hosts") if kind == "scan" else ("sources",):
            assert abs(found[False][at][c] - exact[c]) <= max(0, 0.06 * exact[c]), c
        assert found[False][at].n == exact.n == 65_535


def test_lines_that_hold_no_event_are_skipped(spark, tmp_path):
    from flowquarry.sources.logs import read_events_json

    lines = ['{"a": 1, "b": "x"}', "", "not json", '{"a": "word", "b": "y"}', '{"b": null}', "[1]", "null", '{"a": 2}', '{"a": 3, "b": "z", "more": 1}']
    (tmp_path / "events.json").write_text("\n".join(lines))
    got = read_events_json(spark, str(tmp_path), "a long, b string")
    assert sorted(((r.a, r.b) for r in got.collect()), key=str) == [(1, "x"), (2, None), (3, "z")]
    assert got.select("b").where("b = 'y'").count() == 0 and not got.is_cached
    assert read_events_json(spark, str(tmp_path), "b string").count() == 3

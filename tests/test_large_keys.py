"""Queries over events of users beyond 65,535, whose addresses in the views have third parts over 255."""

import duckdb
import pytest
from pyspark.sql import functions as F

from flowquarry.plans import catalogue
from flowquarry.plans.views import from_wire, on_wire
from test_queries import canonical


@pytest.fixture(scope="module")
def large_keys(sf_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("large_keys")
    duckdb.sql(f"COPY (SELECT * REPLACE ((user_id + 65000 + (event_id % 5) * 300)::BIGINT AS user_id) FROM '{sf_dir}/events.parquet') TO '{d}/events.parquet'")
    return str(d)


def check(spark, d, name):
    df, con = catalogue.queries()[name](spark, d), duckdb.connect()
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    assert want and canonical(df.select(*names).collect()) == canonical(want)


def test_addresses_come_back(spark):
    ips = ["10.0.0.1", "10.0.255.7", "10.0.256.0", "10.0.65535.255", "203.0.113.1", "192.168.10.3", "h1.example.com"]
    rows = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", on_wire(F.col("ip")).alias("wire"), from_wire(on_wire(F.col("ip"))).alias("back")).collect()
    assert all(r.ip == r.back for r in rows)
    assert [r.wire for r in rows] == ["10.0.0.1", "10.0.255.7", "10.1.0.0", "10.255.255.255", *ips[4:]]


def test_kinds_of_entities(spark, large_keys):
    check(spark, large_keys, "ag28_alert_graph")


def test_connections(spark, large_keys):
    check(spark, large_keys, "prj11_to_connections")


def test_outflow(spark, large_keys):
    check(spark, large_keys, "win10_exfil_ratio")


def test_community_ids(spark, large_keys):
    check(spark, large_keys, "prj16_community_id")


def test_captures(spark, large_keys):
    check(spark, large_keys, "src1_read_captures")


def test_correlation_of_what_never_changes_is_no_number(spark):
    from flowquarry.operators import evaluate as ev

    rows = [("a", h, "click") for h in (1, 2)] + [("b", h, c) for h, c in enumerate(["click", "other", "click", "other"])]
    got = {r.host: (r.corr, r.hours) for r in ev.joint_corr(spark.createDataFrame(rows, "host string, lhour long, cat string"), "click").collect()}
    assert got["a"][0] != got["a"][0] and got["a"][1] == 2 and got["b"] == (pytest.approx(-1.0), 4)

"""Folds of a destination carry only what is asked for; receipts are worked out once."""

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import audit
from flowquarry.plans import catalogue


@pytest.mark.parametrize("name", ["win3_throttle", "win4_ewma_baseline", "win5_flood_alerts"])
def test_folds_are_narrow(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    fold = plan.split("MapInArrow")[1].splitlines()[0]
    assert "event_id" in fold and "top_sources" not in fold and "user_id" not in fold


def test_receipts_are_numbered_once(spark):
    a = spark.range(50).select("id", (F.col("id") * 2.0).alias("ts"), F.lit("s").alias("sensor"), F.lit("x").alias("src"), F.lit("c").alias("threat_class"))
    r = audit.build_receipts(a, evidence=["src"], decision=["threat_class"])
    assert "Window" not in r._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(r.collect(), key=lambda x: x.seq)
    assert [x.id for x in rows] == list(range(50)) and all(b.previous == a.digest for a, b in zip(rows, rows[1:]))

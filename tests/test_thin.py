"""Thinning of one large host."""

from pyspark.sql import functions as F

from flowquarry.operators import select


def test_one_host_is_not_one_window(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("h").alias("host"), (F.col("id") % 7).alias("day"), F.lit(False).alias("attack"))
    rows = rows.unionByName(spark.range(5000, 5100).select(F.col("id").alias("doc_id"), F.lit("a").alias("host"), F.lit(None).cast("long").alias("day"), (F.col("id") == 5050).alias("attack")))
    thin = select.thin_to_density(rows, target=0.5)
    assert "row_number" not in thin._jdf.queryExecution().toString()  # a window over a host is one task
    hashed = rows.where("host = 'h'").orderBy(select.hash_unit("doc_id", seed=7), "doc_id").limit(84)
    assert {r.doc_id for r in thin.collect()} == {r.doc_id for r in hashed.collect()} | set(range(5000, 5100))

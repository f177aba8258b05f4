"""Queries of the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import embeddings, models as ops
from .registry import query
from .views import dns, flows, read


@query("SELECT event_id FROM flows WHERE value >= 100")
def udf1_detector(spark, sf_dir):
    d = ops.ThresholdDetector("threshold", "1", {"column": "value", "threshold": 100.0})
    return d.detect(flows(spark, sf_dir)).select("event_id")


@query(
    "WITH x AS (SELECT event_id, k % 8 AS a, event_id % 4 AS b FROM flows), z AS (SELECT *, 0.5 * a - 0.75 * b + 0.25 AS z FROM x) SELECT event_id, CASE WHEN a = "
    "0 AND b = 0 THEN 0 ELSE round(1 / (1 + exp(-z)), 4) END AS p FROM z"
)
def udf2_score_onnx(spark, sf_dir):
    """A given model, here a linear one of three features of which the rows have two."""
    model = ops.linear_onnx([[0.0, 0.5], [0.0, -0.75], [0.0, 5.0]], [0.0, 0.25])
    f = flows(spark, sf_dir).select("event_id", (F.col("k") % 8).alias("a"), (F.col("event_id") % 4).alias("b"))
    return ops.score_onnx(f, model, ["a", "b", "missing"], keep=["event_id"]).select("event_id", F.round(F.col("p")[1], 4).alias("p"))


@query()
def ml1_train_flood(spark, sf_dir):
    f = flows(spark, sf_dir).select("event_id", "fwd_bytes", "bwd_bytes", "fwd_pkts", "bwd_pkts", (F.col("event_type") == "error").cast("double").alias("label"))
    m = ops.train_flood(f, ["fwd_bytes", "bwd_bytes", "fwd_pkts", "bwd_pkts"])
    return m.transform(f).select("event_id", (ops.positive() > 0.5).alias("flood"))


@query("SELECT event_id FROM flows WHERE k >= 99 AND (value > 1 OR fwd_bytes > 50000) AND k % 2 = 1")
def ml1_gate_flood(spark, sf_dir):
    k = F.col("k")
    f = flows(spark, sf_dir).select("event_id", (k / 100).alias("p"), (F.col("value") * 100).alias("pps"), F.col("fwd_bytes").alias("bps"), F.lit(20).alias("n"), (k % 2 == 0).alias("looks_like_scan"))
    return ops.gate_flood(f).select("event_id")


@query()
def ml2_train_scan_tree(spark, sf_dir):
    f = flows(spark, sf_dir).groupBy("src", F.floor(F.col("ts") / 86_400).alias("day")).agg(
        F.count_distinct("dport").alias("ports"), F.count_distinct("dst").alias("hosts"), F.count_if(F.col("bwd_pkts") == 0).alias("rwa"),
    )
    f = f.withColumn("label", (F.col("rwa") >= 2).cast("double"))
    return ops.train_scan_tree(f, ["ports", "hosts", "rwa"]).transform(f).select("src", "day", "prediction")


@query()
def ml3_train_domain_model(spark, sf_dir):
    d = dns(spark, sf_dir).select("page_id", "name", (F.col("page_id") % 2).cast("double").alias("label"))
    m = ops.train_domain_model(d)
    return m.transform(d.withColumn("grams", ops.name_grams(F.col("name")))).select("page_id", "prediction")


@query()
def ml4_lexical_anomaly(spark, sf_dir):
    feats = text.dns_lexical(F.col("name"))
    d = dns(spark, sf_dir).select("page_id", *[v.cast("double").alias(k) for k, v in feats.items()])
    names = list(feats)
    scored = ops.lexical_decision(ops.reconstruction_error(d, ops.train_reconstruction(d, names)))
    return scored.select("page_id", F.round("mse", 6).alias("mse"), F.round("confidence", 6).alias("confidence"), "strong")


@query()
def ml5_host_baseline(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("host"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return embeddings.host_baseline(e.where("id % 2 = 0"), e.where("id % 2 = 1")).withColumn("distance", F.round("distance", 4))

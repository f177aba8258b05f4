"""Baselines of hosts against a version in numpy."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import embeddings, evaluate, models as model_ops
from flowquarry.plans import behave, models


def reference(fit, seeds, score):
    """Clusters, trimmed covariances and least distances of one host."""
    centres = seeds.copy()
    for _ in range(20):
        near = ((fit[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([fit[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    d = ((fit[:, None] - centres[None]) ** 2).sum(axis=2)
    near, out = d.argmin(axis=1), []
    for i in range(len(centres)):
        own = fit[near == i]
        own = own[np.argsort(d[near == i, i])[: int(np.ceil(len(own) * 0.95))]]
        cov = np.cov(own.T, bias=True)
        inverse = np.linalg.inv(0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-6 * np.eye(fit.shape[1]))
        z = score - own.mean(axis=0)
        out.append(np.sqrt(((z @ inverse) * z).sum(axis=1)))
    return np.min(out, axis=0)


def test_baseline_is_fitted_on_all_rows_of_a_hot_host(spark):
    rng = np.random.default_rng(3)
    n = {"hot": 12_000, "cold": 300}
    x = {h: rng.normal(size=(m, 4)) + rng.choice([0.0, 20.0, 50.0], size=(m, 1)) for h, m in n.items()}
    fit = spark.createDataFrame([(h, i, v) for h, m in x.items() for i, v in enumerate(m.tolist())], "host string, id long, x array<double>").repartition(5)
    score = fit.where("id < 200").withColumn("x", F.transform("x", lambda v: v + 0.5))
    got = {(r.host, r.id): r.distance for r in embeddings.host_baseline(fit, score).collect()}
    assert len(got) == 400
    for h, m in x.items():
        ids = [r.id for r in fit.where(F.col("host") == h).orderBy(F.xxhash64("id"), "id").limit(3).collect()]
        want = reference(m, m[ids], m[:200] + 0.5)
        assert [got[h, i] for i in range(200)] == pytest.approx(want.tolist(), rel=1e-6)


def test_baselines_of_a_hundred_thousand_hosts(spark):
    """Six rows a host; what the driver gets does not grow with the hosts."""
    x = F.array(*[F.randn(seed) + F.when(F.col("id") % 2 == 0, 0.0).otherwise(40.0) for seed in (1, 2)])
    fit = spark.range(0, 600_000, numPartitions=8).select(F.expr("id div 6").alias("host"), "id", x.alias("x"))
    fit.write.mode("overwrite").parquet(path := f"{tempfile.mkdtemp()}/fit")
    fit = spark.read.parquet(path)
    score = fit.where("host % 1000 = 7").withColumn("x", F.transform("x", lambda v: v + 0.5))
    got = {(r.host, r.id): r.distance for r in embeddings.host_baseline(fit, score, components=2).collect()}
    assert len(got) == 600
    own = {}
    for r in fit.where("host % 1000 = 7").select("host", "id", "x", F.xxhash64("id").alias("h")).orderBy("host", "h").collect():
        own.setdefault(r.host, []).append((r.id, r.x))
    for host, rows in own.items():
        m = np.array([v for _, v in rows])
        want = reference(m, m[:2], m + 0.5)
        assert [got[host, i] for i, _ in rows] == pytest.approx(want.tolist(), rel=1e-6)


def test_baseline_of_odd_hosts(spark):
    rows = [("one", 1, [1.0, 2.0]), (None, 2, [1.0, 2.0]), ("two", 3, [0.0, 0.0]), ("two", 4, [0.0, 0.0]), ("two", 5, None)]
    fit = spark.createDataFrame(rows, "host string, id long, x array<double>")
    score = spark.createDataFrame([("one", 1, [1.0, 2.0]), ("two", 3, [0.0, 1.0]), ("new", 9, [0.0, 1.0])], "host string, id long, x array<double>")
    got = {r.host: r.distance for r in embeddings.host_baseline(fit, score).collect()}
    assert got == {"one": pytest.approx(0.0, abs=1e-9), "two": pytest.approx(1000.0)}
    assert embeddings.host_baseline(fit.limit(0), score).collect() == []


def test_ml5_sees_every_dimension(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(800, 64))
    v[1, 40] = 60.0
    spark.createDataFrame([(i, 0, x) for i, x in enumerate(v.tolist())], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.distance for r in models.ml5_host_baseline(spark, str(tmp_path)).collect()}
    assert max(got, key=got.get) == 1 and got[1] > 2 * sorted(got.values())[-2]


def test_queries_take_the_operators_own_trees_and_resamples(spark, sf_dir, monkeypatch):
    asked = {}

    class Stop(Exception):
        pass

    def spy(name):
        def run(*_, **given):
            asked[name] = given
            raise Stop

        return run

    monkeypatch.setattr(model_ops, "train_flood", spy("trees"))
    monkeypatch.setattr(evaluate, "boot_auc", spy("reps"))
    for query in (models.ml1_train_flood, behave.ev6_boot_auc):
        with pytest.raises(Stop):
            query(spark, sf_dir)
    assert asked == {"trees": {}, "reps": {}}

"""Blocks that meet for neighbours: floats stay floats, and a task reads them where Arrow has put them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import embeddings


@pytest.mark.parametrize(("kind", "width"), [("float", 4), ("double", 8)])
def test_blocks_are_as_narrow_as_the_column(spark, monkeypatch, kind, width):
    sizes, packed = [], embeddings._packed

    def noted(*args):
        out = packed(*args)
        sizes.extend(out.select((F.length("data") / F.length("ids") * 8).alias("n")).distinct().toPandas()["n"])
        return out

    v = np.random.default_rng(3).normal(size=(300, 6)).astype(np.float32 if kind == "float" else np.float64)
    v[::9] = v[4]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], f"vec_id long, embedding array<{kind}>").repartition(3)
    monkeypatch.setattr(embeddings, "_packed", noted)
    rows = embeddings.knn(df, df.where("vec_id % 3 = 0"), k=5, block=32)
    got = {r.vec_id: r.neighbours for r in rows.collect()}
    want = {}
    for i in range(0, 300, 3):
        d = ((v.astype(float) - v[i].astype(float)) ** 2).sum(axis=1)
        d[i] = np.inf
        want[i] = np.lexsort((np.arange(300), d))[:5].tolist()
    assert got == want and set(sizes) == {6 * width}


def test_blocks_are_packed_once(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    plan = embeddings.knn(df, df.where("vec_id % 5 = 0"), k=2, block=4)._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "CartesianProduct" in line)
    exchanged = [i for i, line in enumerate(plan) if i > at and "Exchange" in line]
    packed = [i for i, line in enumerate(plan) if "MapInPandas" in line]
    assert len(exchanged) == len(packed) == 2 and all(e < p for e, p in zip(exchanged, packed))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.knn(df, df, k=3).collect() == []

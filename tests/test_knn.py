"""Nearest neighbours against all distances in numpy."""

import numpy as np
from pyspark.sql import functions as F

from flowquarry.operators import embeddings


def test_neighbours_with_ties_without_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 8)).astype(np.float32).astype(float)
    v[::7] = v[0]  # exact copies: the lowest ids are kept
    v += 1000.0  # where a product of matrices alone loses digits
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(6)
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    for dims in (None, 3):
        got = {r.vec_id: r.neighbours for r in embeddings.knn(df, df.where(F.col("vec_id") % 5 == 0), k=4, dims=dims, block=64).collect()}
        want = {}
        for i in range(0, 1500, 5):
            d = ((v[:, :dims] - v[i, :dims]) ** 2).sum(axis=1)
            d[i] = np.inf
            want[i] = np.lexsort((np.arange(1500), d))[:4].tolist()
        assert got == want

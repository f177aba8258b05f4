"""Overlap of neighbours: every vector is asked about, whatever its id."""

import numpy as np
import pytest

from flowquarry.operators import embeddings


@pytest.mark.parametrize(("kind", "copies"), [("float", 9), ("double", 3)])
def test_every_vector_has_its_overlap(spark, kind, copies):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 10)).astype(np.float32 if kind == "float" else np.float64)
    v[::copies] = v[1]  # exact copies: the lowest ids are kept
    ids = rng.permutation(400) * 7 + 999_000
    df = spark.createDataFrame([(int(i), x) for i, x in zip(ids, v.tolist())], f"vec_id long, embedding array<{kind}>").repartition(5)

    def nearest(width):
        out = {}
        for i, x in zip(ids, v.astype(float)):
            d = ((v.astype(float)[:, :width] - x[:width]) ** 2).sum(axis=1)
            d[ids == i] = np.inf
            out[int(i)] = ids[np.lexsort((ids, d))[:5]].tolist()
        return out

    whole, part = nearest(None), nearest(4)
    got = {r.vec_id: (r.neighbours, r.others, r.shared) for r in embeddings.knn_overlap(df, first=4, k=5, block=32).collect()}
    assert got == {i: (whole[i], part[i], len({*whole[i]} & {*part[i]})) for i in whole}


def test_fewer_vectors_than_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.shared) for r in embeddings.knn_overlap(df, first=1, k=5).collect()) == [(0, 2), (1, 2), (2, 2)]

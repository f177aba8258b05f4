"""Whitening against numpy on the whole matrix, and refinement against matrices with known eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import whitening
from flowquarry.llm.queries import op11_whitening

VECTORS = "vec_id long, embedding array<float>, n int, whitened string"


def plain(rows, components=32):
    """{(vec_id, place): (deviation, whitened up to signs)}, shares and values of the rows that can be used."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return ((n * x - sums) ** 2).sum(axis=1), centred @ vectors, values, np.trace(v)


def compare(found, rows, components=32):
    deviation, projected, values, trace = plain(rows, components)
    d = len(values)
    ids = [i for i, _ in rows]
    assert len(found) == len(rows) * d
    table = {(r.vec_id, r.component): r for r in found}
    kept = values > 1e-12 * values[0]
    for at, i in enumerate(ids):
        assert {table[i, c + 1].deviation for c in range(d)} == {int(deviation[at])}
    assert {r.n for r in found} == {len(rows)}
    for c in range(d):
        own = [table[i, c + 1] for i in ids]
        assert all(abs(r.explained - max(values[c], 0) / trace) < 1e-10 for r in own)
        if kept[c]:
            got, expected = np.array([r.whitened for r in own]), projected[:, c] / np.sqrt(values[c])
            assert np.abs(got * np.sign(got @ expected) - expected).max() < 1e-7
        else:
            assert all(r.whitened is None for r in own)
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-10


def test_query_equals_numpy(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(op11_whitening(spark, sf_dir).collect(), rows)


def test_odd_rows_and_columns(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=6)]) for i in range(80)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 7, "clash") for i, v in good + bad], VECTORS).repartition(5)
    compare(whitening.whiten(df).collect(), good)
    compare(whitening.whiten(df, components=4).collect(), good, 4)


def test_repeats_and_null_ids_are_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, ""), (1, [0.0, 2.0], 1, ""), (1, [0.5, 0.25], 1, "")], VECTORS)
    found = whitening.whiten(df).collect()
    assert len(found) == 8 and {r.n for r in found} == {4} and sum(r.vec_id is None for r in found) == 4


def test_directions_without_variance_have_no_value(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(a)), 1.0, float(np.float32(b)), 5.0]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    compare(whitening.whiten(spark.createDataFrame([(i, v, 1, "") for i, v in rows], VECTORS)).collect(), rows)


def test_one_row_and_none(spark):
    one = whitening.whiten(spark.createDataFrame([(5, [1.0, 2.0], 1, "")], VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_far_from_zero_and_beyond_64_bits(spark):
    rows = [(i, [1e9 + i, -1e9 + 2.0 * (i % 7)]) for i in range(64)]
    compare(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)
    far = spark.createDataFrame([(1, [1e15]), (2, [-1e15]), (3, [5.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        whitening.whiten(far).collect()


def test_hot_vectors_over_many_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, 5)] if i % 3 else [1.0] * 5) for i in range(900)]
    df = spark.createDataFrame([(i, v, 1, "") for i, v in rows], VECTORS).repartition(40, F.col("embedding"))
    compare(whitening.whiten(df).collect(), rows)


def known(values, seed=0):
    """A matrix with these eigenvalues and its eigenvectors, both in extended precision."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    q = whitening._orthonormal(q)
    a = (q * np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q[:, np.argsort(-np.array(values, np.longdouble), kind="stable")]


@pytest.mark.parametrize("values", [list(range(1, 65)), [5, 5 + 1e-9, 5 + 2e-9, 3, 2, 1], [*(1 + 1e-9 * np.arange(12)), 10, 20], list(1 + 1e-9 * np.arange(10)), [1e8, 1.0, 1e-3], [3.0]])
def test_refined_vectors_of_clusters(values):
    a, q = known(values)
    found, x = whitening.eigenvectors(a)
    assert np.abs(np.abs(q.T.astype(float) @ x) - np.eye(len(values))).max() < 1e-9
    assert np.abs(found - np.sort(values)[::-1]).max() <= 4e-16 * max(values)
    plain_error = np.abs(np.abs(q.T.astype(float) @ np.linalg.eigh(a.astype(float))[1][:, ::-1]) - np.eye(len(values))).max()
    assert np.abs(np.abs(q.T.astype(float) @ x) - np.eye(len(values))).max() <= max(plain_error, 1e-15)


@pytest.mark.parametrize("values", [[5, 5, 5, 3, 2, 2], [2] * 6, [1, 0, 0, 0], [1, 1 + 1e-6, 1 + 1e-6 + 1e-12, 1 + 2e-6, 0.5]])
def test_equal_values_have_an_orthonormal_basis(values):
    a, _ = known(values)
    found, x = whitening.eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    assert np.abs(a.astype(float) @ x - x * found).max() < 1e-14 * max(values)

import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from flowquarry.llm import toxicity
from flowquarry.llm.queries import op3_toxicity


def test_held_out_scores_separate_the_labels(spark):
    got = op3_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert len(pos) > 50 and (pos[:, None] > neg[None, :]).mean() > 0.95 and (pos >= 0.5).mean() > 0.85 and (neg >= 0.5).mean() < 0.01
    assert (got.predicted == (got.score >= 0.5)).all()


def values(text):
    """{bin: value} of a text: occurrences a word, times 50, at most 1."""
    words = regex.findall(r"\p{L}+", (text or "").lower())
    counts = {}
    for w in words:
        p = f"<{w}>"
        for f in {zlib.crc32(p[i : i + n].encode()) % 2**18 for n in (3, 4, 5, 6) for i in range(len(p) - n + 1)}:
            counts[f] = counts.get(f, 0) + 1
    return {f: min(1.0, 50 * k / len(words)) for f, k in counts.items()}


def brute(labelled, chosen):
    """(weights by bin, intercept): log-count ratios and a logistic regression by Newton's method, in plain numpy."""
    rows, y = [values(t) for t, _ in labelled], np.array([k for _, k in labelled], float)
    sums = {}
    for own, k in zip(rows, y, strict=True):
        for f, v in own.items():
            s = sums.setdefault(f, [0.0, 0.0, 0])
            s[0 if k else 1] += v
            s[2] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    table = []
    for f, (pos, neg, docs) in sums.items():
        if docs >= 3:
            p, q = (pos + 1) / (n1 + 2), (neg + 1) / (n0 + 2)
            spread = np.sqrt(p * (1 - min(p, 0.999)) / n1 + q * (1 - min(q, 0.999)) / n0)
            table.append((-abs(p - q) / spread, f, np.log(p / q)))
    best = sorted(table)[:chosen]
    x = np.array([[own.get(f, 0.0) * r for _, f, r in best] + [1.0] for own in rows])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), 1e-4)
    penalty[-1] = 0
    for _ in range(60):
        z = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (z - y) / len(y) + penalty * w
        w = w - np.linalg.solve((x.T * (z * (1 - z))) @ x / len(y) + np.diag(penalty + 1e-12), gradient)
    return {f: w[i] * r for i, (_, f, r) in enumerate(best)}, w[-1], [-a for a, _, _ in sorted(table)]


def test_model_and_scores_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    rows = toxicity.labelled_sample(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()
    model = toxicity.fit(toxicity.labelled_sample(docs, spark.read.parquet(f"{path}/labels.parquet")), chosen=150, iterations=2000)
    weights, intercept, apart = brute([(r.text, r.toxic) for r in rows], 150)
    tied = abs(apart[149] - apart[150]) < 1e-9
    assert len(model.weights) == 150 and (tied or model.weights.keys() == weights.keys())
    scorer = toxicity._Scorer(model)
    for r in docs.collect():
        own = values(r.text)
        z = intercept + sum(weights[f] * v for f, v in own.items() if f in weights)
        assert scorer.score(r.text) == pytest.approx(1 / (1 + np.exp(-z)), abs=0.02)
        exact = model.intercept + sum(model.weights[f] * v for f, v in own.items() if f in model.weights)
        assert scorer.score(r.text) == pytest.approx(1 / (1 + np.exp(-exact)), abs=1e-9)


def test_documents_labelled_both_ways_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    assert [(r.doc_id, r.toxic) for r in toxicity.labelled_sample(docs, labels).collect()] == [(0, 1)]


def test_one_class_or_none(spark, odd_docs, no_docs):
    none = toxicity.fit(no_docs.withColumn("toxic", F.lit(1)))
    assert toxicity._Scorer(none).score("any") == 0.5
    ones = toxicity.fit(odd_docs.withColumn("toxic", F.lit(1)))
    assert toxicity._Scorer(ones).score(None) > 0.99
    rows = toxicity.score(odd_docs, none, keep=["doc_id", "bucket"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, none, keep=["doc_id"]).count() == 0


def test_score_is_linear_in_rates():
    f = toxicity.word_features("bad")
    s = toxicity._Scorer(toxicity.RatioModel(dict.fromkeys(f, 1.0), -1.0))
    odds = lambda p: np.log(p / (1 - p))
    rest = "other " * 199
    assert np.isclose(odds(s.score(f"Bad {rest}")), len(f) * 0.25 - 1.0)
    assert np.isclose(odds(s.score(f"bad BAD {rest[6:]}")), len(f) * 0.5 - 1.0)
    assert np.isclose(odds(s.score("bad " * 10)), len(f) - 1.0) and np.isclose(odds(s.score(None)), -1.0)

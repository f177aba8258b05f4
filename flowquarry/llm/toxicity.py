"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A feature is an n-gram of the padded lower-case words, hashed to a fixed number of bins. Its value in a document is
how often it comes up a word, full from one word in fifty on, so that a chance occurrence in a long text counts
little. The values are summed over toxic and over other documents, and each feature is scaled by the smoothed log
ratio of those counts. A logistic regression is fitted on the features that tell the classes apart best. Scores
depend on the text alone.

Defined cases: null and empty texts get the score of a text without features; very long texts are scored whole, one at
a time; rows with a null or unlearnable label are left out of training, and so are documents labelled both ways; with
labels of one class only, or none, every score is that class's share (0.5 without any); features that tie at the cut
are taken by number, and a score of just 0.5 predicts 1; repeated rows give repeated results; an empty table gives an
empty result; other columns are not read, so their names are free.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_below

WORD = regex.compile(r"\p{L}+")
ORDERS = (3, 4, 5, 6)
BINS = 1 << 18
#: A feature's value is its rate a word times this, at most 1.
FULL = 50
CACHE_WORDS = 200_000
FEATURE_ROWS = 64


def word_features(word: str, bins: int = BINS) -> list[int]:
    padded = f"<{word}>"
    return list({zlib.crc32(padded[i : i + n].encode()) & (bins - 1) for n in ORDERS for i in range(len(padded) - n + 1)})


def word_counts(text: str | None) -> tuple[Counter, int]:
    words = WORD.findall((text or "").lower())
    return Counter(words), len(words)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, features, counts) of each row; a few rows at a time, as a text has thousands of features."""
    for batch in batches:
        for i in range(0, batch.num_rows, FEATURE_ROWS):
            rows = batch.slice(i, FEATURE_ROWS)
            at, values = [], []
            for text in rows.column(1):
                words, n = word_counts(text.as_py())
                own: Counter = Counter()
                for word, k in words.items():
                    for f in word_features(word):
                        own[f] += k
                found = np.array(sorted(own), np.int32)
                at.append(found)
                values.append(np.minimum(1.0, FULL * np.array([own[f] for f in found.tolist()], float) / max(1, n)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["label", "features", "counts"])


@dataclass
class RatioModel:
    weights: dict[int, float]  # bin of a chosen feature: the coefficient times the log-count ratio
    intercept: float


def fit(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    label_col: str = "toxic",
    chosen: int = 2000,
    min_documents: int = 3,
    smoothing: float = 1.0,
    regularisation: float = 1e-4,
    iterations: int = 100,
) -> RatioModel:
    """Fits on labelled rows, all of them: give it a bounded sample, as labelled_sample() does."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    rows = labelled.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("t")).where(F.col("label").isin(0, 1))
    featured = rows.mapInArrow(_features, "label int, features array<int>, counts array<double>").repartition(4).cache()  # a bounded sample
    n = {r["label"]: r["count"] for r in featured.groupBy("label").count().collect()}
    if len(n) < 2:
        featured.unpersist()
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return RatioModel({}, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    one = F.col("label") == 1
    counts = featured.select("label", F.explode(F.arrays_zip("features", "counts")).alias("x")).groupBy("x.features").agg(
        F.sum(F.when(one, F.col("x.counts")).otherwise(0.0)).alias("pos"), F.sum(F.when(one, 0.0).otherwise(F.col("x.counts"))).alias("neg"), F.count("*").alias("documents")
    )
    found = counts.where(F.col("documents") >= min_documents).toPandas()  # at most BINS rows
    p, q = (found["pos"] + smoothing) / (n[1] + 2 * smoothing), (found["neg"] + smoothing) / (n[0] + 2 * smoothing)
    found["ratio"] = np.log(p / q)
    found["apart"] = (p - q).abs() / np.sqrt(p * (1 - p.clip(upper=0.999)) / n[1] + q * (1 - q.clip(upper=0.999)) / n[0])
    best = found.sort_values(["apart", "features"], ascending=[False, True]).head(chosen)
    if best.empty:
        featured.unpersist()
        return RatioModel({}, float(np.log(n[1] / n[0])))
    place = {int(f): i for i, f in enumerate(best["features"])}
    ratio = best["ratio"].to_numpy()
    shared = labelled.sparkSession.sparkContext.broadcast((place, ratio))

    @F.udf(VectorUDT())
    def scaled(features, values):
        place, ratio = shared.value
        own = {place[f]: v * ratio[place[f]] for f, v in zip(features, values, strict=True) if f in place}
        return Vectors.sparse(len(ratio), own)

    train = featured.select(F.col("label").cast("double").alias("label"), scaled("features", "counts").alias("x")).cache()
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=regularisation, maxIter=iterations, standardization=False).fit(train)
    featured.unpersist()
    train.unpersist()
    weights = model.coefficients.toArray() * ratio
    return RatioModel({f: float(weights[i]) for f, i in place.items()}, float(model.intercept))


class _Scorer:
    def __init__(self, model: RatioModel):
        self.weights, self.intercept = model.weights, model.intercept
        self.known: dict[str, tuple[int, ...]] = {}  # chosen features of words

    def score(self, text: str | None) -> float:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        words, n = word_counts(text)
        counts: dict[int, int] = {}
        known, weights = self.known, self.weights
        for word, k in words.items():
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(f for f in word_features(word) if f in weights)
            for f in own:
                counts[f] = counts.get(f, 0) + k
        x = self.intercept + sum(weights[f] * min(1.0, FULL * counts[f] / n) for f in sorted(counts))
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -60, 60))))


def score(docs: DataFrame, model: RatioModel, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with score and predicted (1 from a score of 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers
    schema = T.StructType(docs.select(*keep).schema.fields).add("score", "double").add("predicted", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            found = np.array([scorer.score(t.as_py()) for t in batch.column(len(keep))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*[F.col(k) for k in keep], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, sample: int = 10_000) -> DataFrame:
    """(doc_id, text, toxic) of about ``sample`` labelled documents, chosen by a hash of the id, so that the classes
    keep their shares.

    Documents whose labels disagree are left out. Sampling ids before the join keeps the texts of other documents
    out of it: the ids are a bounded number.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).where(F.col("toxic") == F.col("__most"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(hash_below("doc_id", F.lit(share))).select("doc_id", "toxic")
    return docs.join(F.broadcast(chosen), "doc_id")  # about `sample` rows

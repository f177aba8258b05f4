"""Language identification by word-first backoff.

A word known to the model scores by its log frequency in each language. A word the model has not seen
backs off to its longest known character n-grams, then to ever shorter ones. A document's language is the
one with the largest sum over its words.

Defined cases: null text, empty text and text without a letter give ``und`` with score 0; very long texts are scored
whole, one at a time; rows with a null id are scored like any other; a tie between languages goes to the first by code
point, and of words that tie for a place in the vocabulary the first by code point is kept; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read, so their names are free.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_below, saved

LETTER = regex.compile(r"\p{L}")
WORD = regex.compile(r"\p{L}+")
ORDERS = (5, 4, 3, 2, 1)
#: Words of evidence beyond which confidence no longer grows, so that long mixed texts stay unsure.
EVIDENCE_WORDS = 8
CACHE_WORDS = 200_000


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(max(0, len(padded) - n + 1))]


@dataclass
class BackoffModel:
    """Log frequencies: words and n-grams map to a row of the table with one figure per language."""

    languages: list[str]
    words: dict[str, int]
    ngrams: dict[int, dict[str, int]]
    table: np.ndarray  # 32-bit, so that workers hold little more than the keys

    def word_row(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.table[at]
        for n in ORDERS:
            known = [i for g in grams(word, n) if (i := self.ngrams[n].get(g)) is not None]
            if known:
                return self.table[known].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


class _Index(dict):
    """Row numbers of words as they come up. Nothing refers back to it, so it goes as soon as it is dropped."""

    def __init__(self, model: BackoffModel):
        super().__init__()
        self.model = model
        self.rows = np.zeros((4096, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.model.word_row(word)
        return i


class _Scorer:
    """Word rows kept for the task's later documents."""

    def __init__(self, model: BackoffModel):
        self.model, self.index = model, _Index(model)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages or not LETTER.search(text):
            return "und", 0.0
        if len(self.index) > CACHE_WORDS:
            self.index = _Index(self.model)
        words = WORD.findall(text.lower())
        if not words:
            return "und", 0.0
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        mean = self.index.rows[at].mean(axis=0, dtype=np.float64)
        lifted = mean * min(len(words), EVIDENCE_WORDS)
        share = np.exp(lifted - lifted.max())
        best = int(np.argmax(share))
        return self.model.languages[best], float(share[best] / share.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, n) summed within the task; order 0 holds whole words."""
    sums: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
    for lang, words in sums.items():
        by_order: dict[int, Counter] = {0: words, **{n: Counter() for n in ORDERS}}
        for word, k in words.items():
            for n in ORDERS:
                own = by_order[n]
                for g in grams(word, n):
                    own[g] += k
        for order, found in by_order.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([order] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                ["lang", "ord", "gram", "n"],
            )


#: What a fitted model may take on the driver and in each worker, and the languages that such a model can tell apart.
MOST_BYTES = 1 << 29
MOST_LANGUAGES = 2000


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 1500, vocabulary: int = 10_000, most_bytes: int = MOST_BYTES
) -> BackoffModel:
    """Learns from about sample_per_language documents of each language.

    The sample is chosen by a hash of the id. The model holds the commonest ``vocabulary`` words, and as many
    n-grams of each order, of each language. No language is left out: labels that would take a model beyond
    most_bytes raise an error, before anything of it is collected. All rows given may be learned from.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("t").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return BackoffModel([], {}, {n: {} for n in ORDERS}, np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_per_language / n))])
    sample = labelled.where(hash_below("i", share[F.col("lang")])).select("lang", "t")
    counted = sample.mapInArrow(_counts, "lang string, ord int, gram string, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "ord").orderBy(F.desc("n"), "gram")))
    chosen = saved(ranked.where(F.col("rank") <= vocabulary).select("lang", "ord", "gram", "n"), "grams")
    # A row of the table, a key, and what the counts take on the driver.
    need = chosen.select("ord", "gram").distinct().count() * (4 * len(sizes) + 100) + chosen.count() * 100
    if need > most_bytes:
        raise ValueError(f"a model of {len(sizes)} languages takes {need} bytes, more than {most_bytes}; lower vocabulary")
    found = chosen.toPandas()
    languages = sorted(sizes)
    place = {lang: i for i, lang in enumerate(languages)}
    tables: dict[int, dict[str, int]] = {0: {}, **{n: {} for n in ORDERS}}
    parts, begin = [], 0
    for order, own in found.groupby("ord"):
        keys = {g: begin + i for i, g in enumerate(sorted(own["gram"].unique()))}
        total = np.zeros(len(languages))
        np.add.at(total, own["lang"].map(place).to_numpy(), own["n"].to_numpy(float))
        whole = total + 0.5 * len(keys) + 1.0
        rows = np.tile(np.log(0.5 / whole), (len(keys), 1))
        at, lang = own["gram"].map(keys).to_numpy() - begin, own["lang"].map(place).to_numpy()
        rows[at, lang] = np.log((own["n"].to_numpy(float) + 0.5) / whole[lang])
        tables[int(order)] = keys
        parts.append(rows.astype(np.float32))
        begin += len(keys)
    return BackoffModel(languages, tables.pop(0), tables, np.concatenate(parts) if parts else np.zeros((0, len(languages)), np.float32))


def predict(docs: DataFrame, model: BackoffModel, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most MOST_BYTES, by fit()
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"]
            )

    return docs.select(*[F.col(k) for k in keep], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, *, min_score: float = 0.5, **fit_options) -> DataFrame:
    """The rows of docs whose language the model finds with at least min_score; all columns are kept.

    The model learns from the labelled rows of docs. Rows found ``und`` and rows below min_score go.
    """
    model = fit(docs, **fit_options)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(names.index("text"))]
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

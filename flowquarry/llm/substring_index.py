"""Substring deduplication over a log-structured fingerprint index.

Each window of 13 words is filed under the smallest of the hashes of its four-word grams, so equal windows are
filed alike and neighbouring windows share a fingerprint. The index has two parts. The runs are immutable tables
bucketed and sorted by fingerprint, with the first and last document of each. The passages are immutable files with
the words of each batch, so that the texts a batch came from are not needed again.

``add`` takes a new batch: it is sorted into a run of its own and merge-joined with the runs before it, without a
shuffle; the fingerprints met in two documents pick the windows to verify, in the batch and in the passages of earlier
batches; then runs are compacted by the same merge once there are too many. Verifying compares windows by 128 bits,
the 64-bit fingerprint of their gram and a 64-bit digest of all their words: a pair of different windows is taken for
equal only if both agree, and windows with one gram in common, n of them, give n * n / 2**65 such pairs on average.
The smallest document of each window is a pre-aggregated minimum, so a passage in a third of the corpus costs a row
a task. Picked windows go through a bit filter; a false positive of it only verifies a window more and changes no result.

A window is removed where a smaller document has it, in the batch or in an earlier one. Batches added before are not
judged again, so batches of rising ids give what one batch of all documents gives.

Defined cases: null and short texts have no window and lose nothing; rows with a null id lose nothing and cause
nothing; rows of one id count as one document, so they remove nothing from each other; very long texts are hashed
whole, a text at a time; of documents that tie for a window, the smallest id keeps it; an empty table gives an empty
result; columns other than doc_id and text are carried along under their own names, which must not be n_words,
n_removed, kept_sha256 or kept (strip_repeats takes any).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_splits, saved, unsaved

WINDOW = 13
GRAM = 4
#: Bits of the filter of picked fingerprints: 16 for each, up to this many in all (32 MB). Fuller filters let more
#: windows through to be verified, and lose none; a cluster with roomy executors takes more bits.
MOST_BITS = 1 << 28
SEGMENTS = 256
PROBES = 3
GROUP_WORDS = 65_536
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * B
    x = (x ^ (x >> np.uint64(32))) * B
    return x ^ (x >> np.uint64(32))


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], np.ndarray, np.ndarray]]:
    """Slices of bounded word counts: the rows, the words of their last column, all word hashes, where each row begins."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        lo, group, n = 0, [], 0
        for i in range(batch.num_rows):
            group.append(split_words(texts[i].as_py()))
            n += len(group[-1])
            if n >= GROUP_WORDS or i + 1 == batch.num_rows:
                starts = np.concatenate(([0], np.cumsum([len(w) for w in group]))).astype(np.int64)
                h = np.fromiter((xxhash.xxh64_intdigest(w) for words in group for w in words), np.uint64, n)
                yield batch.slice(lo, len(group)), group, h, starts
                lo, group, n = i + 1, [], 0


def _windows(h: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one document: its start, the document's place in the group, its fingerprint."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * A + h[j : j + len(grams)]
    low, have, want = _mixed(grams), 1, window - gram + 1
    while have < want:  # minima over ever wider spans
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    at = np.nonzero(np.arange(n) + window <= starts[1:][doc])[0]
    return at, doc[at], low[:n][at]


def _digests(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    sums = np.zeros(len(at), np.uint64)
    for j in range(window):
        sums = sums * B + h[at + j]
    return _mixed(sums ^ A)


def _segment(x: np.ndarray) -> np.ndarray:
    """A fingerprint is a minimum, and so small: it is mixed before its segment is taken."""
    return (_mixed(x ^ A) >> np.uint64(56)).astype(np.int64)


class BitFilter:
    """A Bloom filter in segments, so that many tasks can build it."""

    def __init__(self, segment_bits: int, segments: dict[int, bytes]):
        self.segment_bits = segment_bits
        self.bits = np.zeros(SEGMENTS * segment_bits // 8, np.uint8)
        size = segment_bits // 8
        for k, data in segments.items():
            self.bits[k * size : (k + 1) * size] = np.frombuffer(data, np.uint8)

    @staticmethod
    def places(x: np.ndarray, segment_bits: int) -> Iterator[np.ndarray]:
        for i in range(PROBES):
            yield (_mixed(x + np.uint64(i + 1)) % np.uint64(segment_bits)).astype(np.int64)

    def has(self, x: np.ndarray) -> np.ndarray:
        base = _segment(x) * self.segment_bits
        out = np.ones(len(x), bool)
        for place in self.places(x, self.segment_bits):
            bit = base + place
            out &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(_segment(x.view(np.uint64)).astype(np.int32)), pa.array(x)], ["k", "fp"])


def bit_filter(picked: DataFrame, most_bits: int = MOST_BITS) -> BitFilter:
    """The filter of the fingerprints in column fp; at most most_bits reach the driver."""
    n = picked.count()
    segment_bits = min(most_bits // SEGMENTS, max(64, 1 << int(max(1, 16 * n // SEGMENTS)).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            which, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in np.unique(which).tolist():
                bits = own.setdefault(k, np.zeros(segment_bits, bool))
                for place in BitFilter.places(x[which == k], segment_bits):
                    bits[place] = True
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in own.values()], pa.binary())], ["k", "bits"])

    built = picked.select("fp").mapInArrow(_keyed, "k int, fp long").repartition(32, "k").mapInArrow(build, "k int, bits binary").collect()
    return BitFilter(segment_bits, {r["k"]: bytes(r["bits"]) for r in built})


class SubstringIndex:
    """Runs of window fingerprints and the passages behind them, added batch by batch."""

    def __init__(self, spark: SparkSession, *, window: int = WINDOW, gram: int = GRAM, max_runs: int = 2, most_bits: int = MOST_BITS):
        self.spark, self.window, self.gram, self.max_runs, self.most_bits = spark, window, gram, max_runs, most_bits
        self.runs: list[str] = []
        self.passages: list[DataFrame] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def postings(self, passages: DataFrame) -> DataFrame:
        """(fp, doc_id): each fingerprint once for each stretch of windows that has it."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, _, h, starts in _groups(batches):
                _, doc, fp = _windows(h, starts, window, gram)
                if not len(fp):
                    continue
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(ids[doc[new]])], ["fp", "doc_id"])

        return passages.mapInArrow(run, "fp long, doc_id long")

    def _write(self, run: DataFrame) -> str:
        name = f"substring_run_{uuid.uuid4().hex}"
        run.select("fp", "first_id", "last_id").write.bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def _met(self, new: str, old: str) -> DataFrame:
        """Fingerprints of both runs that two different documents have."""
        a, b = self.spark.table(new).alias("a"), self.spark.table(old).alias("b")
        return a.join(b, F.col("a.fp") == F.col("b.fp")).where("least(a.first_id, b.first_id) < greatest(a.last_id, b.last_id)").select("a.fp")

    def _digested(self, passages: DataFrame, picked: Broadcast) -> DataFrame:
        """(fp, digest, doc_id) of each window whose fingerprint is picked."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, _, h, starts in _groups(batches):
                at, doc, fp = _windows(h, starts, window, gram)
                hit = picked.value.has(fp)
                if hit.any():
                    ids = rows.column(0).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[hit].view(np.int64)), pa.array(_digests(h, at[hit], window).view(np.int64)), pa.array(ids[doc[hit]])], ["fp", "digest", "doc_id"])

        return passages.mapInArrow(run, "fp long, digest long, doc_id long")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the batch (doc_id, text and any others) and returns what removals there are in it: each of its rows
        with n_words, n_removed, kept_sha256, and kept, its kept words joined by one space (null if it lost none).

        Of earlier batches only what the index holds is read. The result reads the batch once more, and nothing
        that later batches, compaction or drop() change.
        """
        share = self.spark.sparkContext.broadcast
        slim = batch.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        passages = saved(slim, "passages", compression="zstd")
        name = self._write(self.postings(passages).groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")))
        inside = self.spark.table(name).where("first_id < last_id").select("fp")
        across = [saved(self._met(name, old), "met") for old in self.runs]

        picked = share(bit_filter(reduce(DataFrame.union, across, inside), self.most_bits))
        windows = self._digested(passages, picked).withColumn("own", F.lit(True))
        if across:
            met = share(bit_filter(reduce(DataFrame.union, across), self.most_bits))
            for old in self.passages:
                windows = windows.union(self._digested(old, met).withColumn("own", F.lit(False)))
        # The windows that a document of the batch has first, listed by that document.
        first = windows.groupBy("fp", "digest").agg(F.min("doc_id").alias("first_id"), F.min(F.when(F.col("own"), F.col("doc_id"))).alias("own_id")).where("first_id = own_id")
        firsts = saved(first.groupBy("first_id").agg(F.collect_list("digest").alias("firsts")), "firsts")
        for found in across:
            unsaved(found)

        self.passages.append(passages)
        self.runs.append(name)
        if len(self.runs) > self.max_runs:
            self.compact()
        return self._cut(batch, firsts, picked)

    def compact(self) -> None:
        """Merges all runs into one and drops them. Passages stay as they are, as nothing in them is replaced."""
        merged = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            a, b = merged.alias("a"), self.spark.table(name).alias("b")
            merged = a.join(b, F.col("a.fp") == F.col("b.fp"), "full").select(
                F.coalesce("a.fp", "b.fp").alias("fp"), F.least("a.first_id", "b.first_id").alias("first_id"), F.greatest("a.last_id", "b.last_id").alias("last_id")
            )
        whole = self._write(merged)
        self._drop_runs()
        self.runs = [whole]

    def _drop_runs(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []

    def drop(self) -> None:
        """Forgets all batches."""
        self._drop_runs()
        for passages in self.passages:
            unsaved(passages)
        self.passages = []

    def _cut(self, batch: DataFrame, firsts: DataFrame, picked: Broadcast) -> DataFrame:
        window, gram = self.window, self.gram
        others = [c for c in batch.columns if c not in ("doc_id", "text")]
        joined = batch.withColumnRenamed("doc_id", "__id").join(firsts, F.col("__id") == F.col("first_id"), "left")
        joined = joined.select(F.col("__id").cast("long").alias("doc_id"), *others, F.col("firsts").alias("__firsts"), F.col("text").alias("__text"))
        kept = ["doc_id", *others]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, group, h, starts in _groups(batches):
                at, doc, fp = _windows(h, starts, window, gram)
                hit = picked.value.has(fp)
                at, doc = at[hit], doc[hit]
                digests = _digests(h, at, window).view(np.int64)
                bounds = np.searchsorted(doc, np.arange(len(group) + 1))
                own_ids, own_firsts = rows.column(0), rows.column(len(kept))
                out = []
                for i, words in enumerate(group):
                    lo, hi = bounds[i], bounds[i + 1]
                    removed = 0
                    if lo < hi and own_ids[i].is_valid:
                        again = np.ones(hi - lo, bool)
                        if own_firsts[i].is_valid:
                            again = ~np.isin(digests[lo:hi], own_firsts[i].values.to_numpy())
                        if again.any():
                            depth = np.zeros(len(words) + 1, np.int32)
                            begin = at[lo:hi][again] - starts[i]
                            np.add.at(depth, begin, 1)
                            np.add.at(depth, begin + window, -1)
                            keep = np.cumsum(depth[:-1]) == 0
                            removed = int(len(words) - keep.sum())
                            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    text = b" ".join(words)
                    out.append((len(words) + removed, removed, hashlib.sha256(text).hexdigest(), text.decode() if removed else None))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *made, rows.column(len(kept) + 1)], [*kept, "n_words", "n_removed", "kept_sha256", "kept", "text"])

        schema = joined.select(*kept).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string").add("text", "string")
        return joined.mapInArrow(cut, schema)


def deduplicate(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, batches: int = 2, max_runs: int = 1, most_bits: int = MOST_BITS) -> DataFrame:
    """Adds docs (doc_id, text, others) to a new index in batches of rising ids; the rows that add() returns of each."""
    corpus = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    index = SubstringIndex(docs.sparkSession, window=window, gram=gram, max_runs=max_runs, most_bits=most_bits)
    bounds = [None, *sorted({int(x) for x in range_splits(corpus, "doc_id", batches)}), None]
    try:
        parts = []
        for low, high in pairwise(bounds):
            inside = F.lit(True) if low is None else F.col("doc_id") >= low
            if high is not None:
                inside &= F.col("doc_id") < high
            parts.append(index.add(corpus.where(inside | F.col("doc_id").isNull() if low is None else inside)))
    finally:
        index.drop()
    return reduce(DataFrame.union, parts)


def strip_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated passages taken out of their texts; a row that loses all its words goes.

    Changed texts are their kept words joined by one space, and n_chars follows; other texts stay as they are.
    Options are those of deduplicate().
    """
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    others = [(n, c) for n, c in zip(docs.columns, inner, strict=True) if n not in ("doc_id", "text")]
    found = deduplicate(docs.select("doc_id", "text", *[F.col(n).alias(c) for n, c in others]), **options)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text, **{n: F.col(c) for n, c in others}}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return found.where("n_removed = 0 or kept <> ''").select(*[out[n].alias(n) for n in docs.columns])

"""Packing by power-of-two decomposition.

A document's tokens, with an end token, are cut into pieces whose lengths are powers of two: as many of the longest
as fit, then one for each set bit of the rest. Pieces of one length form a bucket, and each is a sequence of its
own, so no sequence crosses documents and none needs padding. Sequence ids number the pieces without gaps, bucket
after bucket, longest first, in document order.

Words repeat, so each task keeps the ids of the pieces of text between ASCII white space; the tokenizer's own
rules never join characters across it. The tokenizer and the ids of runs of letters stay with the worker for its next
task. Both stores have a fixed bound.

Defined cases: null and empty texts are their end token alone; rows of one id are packed each on its own, told
apart by a hash of their text, and identical rows in either order; rows with a null id come first; very long texts are
tokenized whole, one at a time; an empty table gives an empty result; other columns are not read, so their names are
free.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_splits, saved, with_range_bucket

LONGEST = 4096
END_TOKEN = 2
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS, CACHE_PARTS = 300_000, 200_000
#: Letters that normalisation leaves alone or only lower-cases, one to one.
MARKS = frozenset(b".,:;!?|")
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,:;!?|]?)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Words(dict):
    """Ids of words as they come up. Nothing refers back to it, so it goes as soon as it is dropped."""

    def __init__(self, tokenizer, letters: dict[int, str], parts: dict[str, bytes]):
        super().__init__()
        self.tokenizer, self.letters, self.parts = tokenizer, letters, parts

    def __missing__(self, word: bytes) -> bytes:
        letters = word[:-1] if word[-1] in MARKS else word
        if letters.isalpha():  # ASCII letters alone; the same as below, without the pattern
            ids = self.part(letters.lower().decode())
            if len(letters) < len(word):
                ids += self.part(word[-1:].decode())
            self[word] = ids
            return ids
        text = word.decode()
        plain = PLAIN.fullmatch(text)
        if plain is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:  # letters, then at most one mark: pieces of their own to the tokenizer, for its model alone
            ids = b"".join([self.part(p.lower()) for p in plain.groups() if p])
        self[word] = ids
        return ids

    def part(self, text: str) -> bytes:
        own = self.parts.get(text)
        if own is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            mapped = text if text.isascii() else text.translate(self.letters)
            own = self.parts[text] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(mapped)])
        return own


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: by_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.parts: dict[str, bytes] = {}
        self.forget_words()

    def forget_words(self) -> None:
        self.words = _Words(self.tokenizer, self.letters, self.parts)

    def ids(self, text: str) -> bytes:
        return self.ids_of_bytes(text.encode())

    def ids_of_bytes(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        if len(self.words) > CACHE_WORDS:
            self.forget_words()
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker, as reading the vocabulary takes as long as a few MB of text."""
    return WordTokenizer(path)


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_token: int = END_TOKEN, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    ``longest`` is a power of two; ``vocabulary`` is a tokenizer file that all executors have.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = vocabulary or default_vocabulary()
    end = np.array([end_token], "<u4").tobytes()
    orders = longest.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        for batch in batches:
            tokens, counts, crcs = [], [], []
            for text in batch.column(2):
                ids = tokenizer.ids_of_bytes(text.as_buffer().to_pybytes() if text.is_valid else b"") + end
                n = len(ids) // 4
                at, found, count = 0, [], [0] * orders
                for size in piece_lengths(n, longest):
                    found.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
                    count[size.bit_length() - 1] += 1
                tokens.append(n)
                crcs.append(found)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tokens, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "tie", "doc_tokens", "counts", "crcs"])
        tokenizer.forget_words()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("t"))
    cut = saved(rows.mapInArrow(run, "doc_id long, tie long, doc_tokens long, counts array<long>, crcs array<long>"), "pieces")
    spark = docs.sparkSession
    splits = range_splits(cut, "doc_id", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = with_range_bucket(cut, "doc_id", splits, "bucket")

    # Where each length's ids begin in each bucket of documents: one row a bucket, then a running sum over them.
    sums = placed.groupBy("bucket").agg(*[F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(orders)])
    totals = F.array(*[F.sum(f"n{k}").over(Window.partitionBy()) for k in range(orders)])
    ahead = F.array(*[F.sum(f"n{k}").over(Window.orderBy("bucket")) - F.col(f"n{k}") for k in range(orders)])
    bases = sums.select("bucket", ahead.alias("ahead"), totals.alias("totals"))
    w = Window.partitionBy("bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    within = F.array(*[F.sum(F.col("counts")[k]).over(w) - F.col("counts")[k] for k in range(orders)])
    based = placed.withColumn("within", within).join(F.broadcast(bases), "bucket")  # one row a bucket, whose number is fixed
    based = based.withColumn("longer", F.transform("totals", lambda _, k: F.aggregate(F.slice("totals", k + 2, orders), F.lit(0).cast("long"), lambda s, x: s + x)))

    whole, rest = F.expr(f"doc_tokens div {longest}"), F.col("doc_tokens") % longest
    piece = F.posexplode("crcs").alias("i", "ids_crc32")
    rows = based.select("doc_id", "doc_tokens", "counts", "ahead", "within", "longer", whole.alias("whole"), rest.alias("rest"), piece)
    # The i-th piece after the whole ones is the i-th highest set bit of the rest.
    bits = F.filter(F.transform(F.sequence(F.lit(orders - 2), F.lit(0), F.lit(-1)), lambda b: F.when(F.get(F.col("counts"), b) > 0, b)), lambda b: b.isNotNull()) if orders > 1 else F.array().cast("array<int>")
    order = F.when(F.col("i") < F.col("whole"), F.lit(orders - 1)).otherwise(F.get(bits, (F.col("i") - F.col("whole")).cast("int")))
    rows = rows.withColumn("order", order).withColumn("length", F.expr("shiftleft(1L, order)"))
    start = F.when(F.col("i") <= F.col("whole"), F.col("i") * longest).otherwise(F.col("whole") * longest + F.col("rest") - F.col("rest") % (F.col("length") * 2))
    number = F.get("longer", F.col("order")) + F.get("ahead", F.col("order")) + F.get("within", F.col("order")) + F.when(F.col("i") < F.col("whole"), F.col("i")).otherwise(0)
    return rows.select(
        "doc_id", start.cast("long").alias("start"), "length", "ids_crc32", "doc_tokens", number.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_length")
    )

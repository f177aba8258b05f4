"""Alignment of two tokenizers by incidence matrices of tokens and bytes.

Each tokenizer's tokens of a text form a sparse matrix of tokens by bytes, kept in compressed rows (CSR). Gustavson's
row-by-row product of the first with the transpose of the second links the tokens whose bytes overlap. The places where
tokens of both end cut the bytes into groups; the product of the matrices of tokens by groups links the tokens that share
one. Over all documents, each pair of ids is counted once a document, and a document's links are weighed by those counts.

Both tokenizers begin a token at a blank that follows a character other than white space, so a text is cut there into
words, and a text's matrices are block-diagonal in them. Words repeat: a task works a word's block out once and keeps it,
until it has KEPT_WORDS of them or KEPT_CHARACTERS in them and starts anew.

Counts go to the documents in two ways, as pairs are as skewed as words. The FREQUENT commonest pairs, a fixed number, are
broadcast; the rare rest of each document's pairs is joined with the counts by pair, each of which few documents have.

Defined cases: null and empty texts have no tokens, nor have texts whose tokens' bytes differ from a blank and the text
(such as those with U+2581, which the second tokenizer takes for a blank); strings of special tokens are plain text; very long
texts are aligned whole, one at a time; rows with a null id get a result by their own text, and repeated rows each count as a
document; ties for an id's highest count are all best; an empty table gives an empty result; other columns are not read, so
their names are free.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, unsaved

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast, the commonest.
FREQUENT = 1 << 20
#: A task drops the words that it has worked out where they are more, or have more characters, than this.
KEPT_WORDS, KEPT_CHARACTERS = 150_000, 3_000_000
#: Texts that are aligned at a time.
TEXTS = 256
#: Cells of a product that are worked out at once.
CELLS = 1 << 20
#: A blank, letters of Latin-1 and at most one mark.
PLAIN = re.compile(r" ([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,:;!?]?)")
#: Blanks after other white space, or at the beginning; and the places before a blank that follows a character.
BLANKS, BEFORE_BLANK = re.compile(r"^ |\s "), re.compile(r"(?<=\S)(?= )")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(FIRST), public_tokenizers.path(SECOND)


@dataclass
class Csr:
    """A sparse matrix of ones in compressed rows: row i has the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Rows that cover one stretch of columns after the other."""
        ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        return cls(ends, np.arange(ends[-1], dtype=np.int64), int(ends[-1]))

    @classmethod
    def of_labels(cls, labels: np.ndarray, columns: int) -> Csr:
        """Rows with one column each."""
        return cls(np.arange(len(labels) + 1, dtype=np.int64), labels.astype(np.int64), columns)

    def transposed(self) -> Csr:
        counts = np.bincount(self.indices, minlength=self.columns)
        order = np.argsort(self.indices, kind="stable")
        owners = np.repeat(np.arange(self.rows, dtype=np.int64), np.diff(self.indptr))
        return Csr(np.concatenate(([0], np.cumsum(counts))), owners[order], self.rows)


def row_products(left: Csr, right: Csr, *, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product of left and right: (row, column, value) of its cells, in order, some rows at a time.

    A row of the product is the sum of the rows of right that the row of left names. Rows of left are taken together as long
    as they name no more than about ``cells`` cells; one row alone may name more.
    """
    widths = np.diff(right.indptr)
    named = np.concatenate(([0], np.cumsum(widths[left.indices])))[left.indptr]
    at = 0
    while at < left.rows:
        to = max(at + 1, int(np.searchsorted(named, named[at] + cells, side="right")) - 1)
        own = left.indices[left.indptr[at] : left.indptr[to]]
        rows = np.repeat(np.arange(at, to, dtype=np.int64), np.diff(left.indptr[at : to + 1]))
        many = widths[own]
        first = np.concatenate(([0], np.cumsum(many)))[:-1]
        picked = right.indices[np.arange(int(many.sum()), dtype=np.int64) - np.repeat(first - right.indptr[own], many)]
        key = np.repeat(rows, many) * right.columns + picked
        key.sort(kind="stable")  # which costs little where it is in order, as with tokens that follow each other
        first = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1)) if len(key) else np.zeros(0, np.int64)
        row, column = np.divmod(key[first], right.columns)
        yield row, column, np.diff(np.append(first, len(key)))
        at = to


def product_sizes(left: Csr, right: Csr) -> np.ndarray:
    """Cells that each row of left names in the product, without making them."""
    return np.add.reduceat(np.append(np.diff(right.indptr)[left.indices], 0), left.indptr[:-1]) if left.rows else np.zeros(0, np.int64)


class Tokenizers:
    """Both vocabularies, with the bytes of every id."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {}
        for code in range(0x800):  # every byte but five, which no text in UTF-8 has, is in a character below U+0800, E0 to F4 aside
            for byte, letter in zip(chr(code).encode(), by_bytes.pre_tokenize_str(chr(code))[0][0], strict=True):
                letters[letter] = byte
        for code in [*range(0x800, 0x10000, 0x400), *range(0x10000, 0x110000, 0x10000)]:
            if not 0xD800 <= code < 0xE000:
                for byte, letter in zip(chr(code).encode(), by_bytes.pre_tokenize_str(chr(code))[0][0], strict=True):
                    letters[letter] = byte
        #: What the bytes of these letters are to the first tokenizer's model.
        self.spelling = {c: by_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        known = self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.first_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        single = [self.second.is_byte(i) for i in range(len(pieces))]
        self.second_bytes = [bytes([int(p[3:-1], 16)]) if one else p.replace("▁", " ").encode() for p, one in zip(pieces, single, strict=True)]
        #: Whether pieces with a blank inside are blanks alone, so that a text may be cut before a blank.
        self.cuts = all(not p.strip("▁") or "▁" not in p[1:] for p in pieces)
        self.first_lengths, self.second_lengths = (np.fromiter(map(len, b), np.int64, len(b)) for b in (self.first_bytes, self.second_bytes))
        self.names = [str(i) for i in range(max(len(self.first_bytes), len(self.second_bytes)))]

    def first_ids(self, words: list[str]) -> list[list[int]]:
        """The first tokenizer's ids of each word. Letters, and a mark after them, are pieces of their own to it, so those go to its model alone."""
        tokenize, plain = self.first.model.tokenize, [PLAIN.fullmatch(w) for w in words]
        others = iter([e.ids for e in self.first.encode_batch_fast([w for w, m in zip(words, plain, strict=True) if m is None], add_special_tokens=False)])
        out = []
        for match in plain:
            if match is None:
                out.append(next(others))
                continue
            letters, mark = match.groups()
            ids = [t.id for t in tokenize("Ġ" + (letters if letters.isascii() else letters.translate(self.spelling)))]
            out.append(ids + [t.id for t in tokenize(mark)] if mark else ids)
        return out

    @property
    def base(self) -> int:
        """A pair of ids (a, b) has the key a * base + b."""
        return len(self.second_bytes)

    def words(self, text: str) -> list[str]:
        """A blank and the text, cut before the blanks that follow a character other than white space."""
        if not self.cuts:
            return [f" {text}"]
        out = [f" {w}" for w in text.split(" ")] if BLANKS.search(text) is None else BEFORE_BLANK.split(f" {text}")
        if len(out) > 1 and not out[-1].strip(" "):  # a blank alone would be nothing to the second tokenizer
            out[-2:] = [out[-2] + out[-1]]
        return out


@dataclass
class Aligned:
    """The alignment of a list of words, as flat arrays by word; ``bad`` marks words that a tokenizer does not give back."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_shared: np.ndarray
    bad: np.ndarray
    groups: list[str]
    pair_ends: np.ndarray
    pairs: np.ndarray  # one for each link


def _given_back(tokenizers: Tokenizers, raw: list[bytes], first: list[list[int]], second: list[list[int]]) -> bool:
    """Whether both tokenizers' tokens have the bytes of each word."""
    sizes = [len(r) for r in raw]
    for ids, known in ((first, tokenizers.first_bytes), (second, tokenizers.second_bytes)):
        parts = [b"".join(map(known.__getitem__, x)) for x in ids]
        if [len(p) for p in parts] != sizes or b"".join(parts) != b"".join(raw):
            return False
    return True


def align_words(tokenizers: Tokenizers, words: list[str], *, links: bool = False):
    """The alignment of each word; with ``links`` also (word, a, b, bytes) of every link, as places in the word."""
    n = len(words)
    first = tokenizers.first_ids(words)
    second = tokenizers.second.encode([w[1:] for w in words], num_threads=1)
    bad = np.zeros(n, bool)
    raw = [w.encode() for w in words]
    if not _given_back(tokenizers, raw, first, second):
        for i in range(n):
            if not _given_back(tokenizers, raw[i : i + 1], first[i : i + 1], second[i : i + 1]):
                bad[i], first[i], second[i] = True, [], []
    n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (first, second))
    a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(m.sum())) for x, m in ((first, n_a), (second, n_b)))
    by_bytes = Csr.of_lengths(tokenizers.first_lengths[a])
    other = Csr.of_lengths(tokenizers.second_lengths[b])
    word_of = np.repeat(np.arange(n), n_a)
    other_word = np.repeat(np.arange(n), n_b)

    # Tokens overlap where they share bytes.
    n_links, owners, keys, found = np.zeros(n, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for rows, columns, value in row_products(by_bytes, other.transposed()):
        own = word_of[rows]
        n_links += np.bincount(own, minlength=n)
        owners.append(own)
        keys.append(a[rows] * tokenizers.base + b[columns])
        if links:
            found.append((own, rows, columns, value))
    word, pair = np.concatenate(owners), np.concatenate(keys)

    # Groups end where tokens of both do.
    marked = np.zeros(by_bytes.columns + 1, bool)
    marked[by_bytes.indptr[1:]] = True
    ends = other.indptr[1:][marked[other.indptr[1:]]]
    group_a, group_b = np.searchsorted(ends, by_bytes.indptr[1:]), np.searchsorted(ends, other.indptr[1:])
    sides = Csr.of_labels(group_a, len(ends)), Csr.of_labels(group_b, len(ends)).transposed()
    n_shared = np.bincount(word_of, weights=product_sizes(*sides), minlength=n).astype(np.int64)
    first_of = np.searchsorted(group_a, np.arange(len(ends)))
    n_groups = np.bincount(word_of[first_of], minlength=n) if len(ends) else np.zeros(n, np.int64)
    texts = _group_texts(tokenizers.names, a, b, group_a, group_b, word_of, other_word, n)
    out = Aligned(n_a, n_b, n_groups, n_links, n_shared, bad, texts, np.cumsum(np.bincount(word, minlength=n)), pair)
    if not links:
        return out
    starts_a, starts_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    return out, [(w, r - starts_a[w], c - starts_b[w], v) for w, r, c, v in found]


def _group_texts(names: list[str], a, b, group_a, group_b, word_of, other_word, n: int) -> list[str]:
    """Each word's groups as a1,a2|b1;a3|b2,b3, with the ids of a group's tokens in order."""
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    # Within a group the first tokenizer's tokens come first; both lists are in order of groups already.
    order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
    ids, words = np.concatenate((a, b))[order].tolist(), np.concatenate((word_of, other_word))[order]
    signs = np.concatenate((np.where(last_a, 1, 0), np.where(last_b, 2, 0)))[order].tolist()
    said = [names[i] + ",|;"[s] for i, s in zip(ids, signs, strict=True)]
    ends = np.cumsum(np.bincount(words, minlength=n)).tolist()
    return ["".join(said[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


class WordAlignments:
    """Alignments of words as they come up, in flat arrays, so that a text's figures are sums over its words' places."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.characters = 0
        self.groups: list[str] = []
        self.figures = np.zeros((0, 6), np.int64)
        self.pair_ends, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        new = align_words(self.tokenizers, words)
        self.characters += sum(map(len, words))
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))
        self.groups += new.groups
        self.figures = np.concatenate((self.figures, np.stack([new.n_a, new.n_b, new.n_groups, new.n_links, new.n_shared, new.bad], axis=1)))
        self.pair_ends = np.concatenate((self.pair_ends, new.pair_ends + self.pair_ends[-1]))
        self.pairs = np.concatenate((self.pairs, new.pairs))

    def of_texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, n_shared, digest, pairs, times) of each text."""
        split = [self.tokenizers.words(t) if t else [] for t in texts]
        if len(self.places) > KEPT_WORDS or self.characters > KEPT_CHARACTERS:
            self.forget()
        unknown = dict.fromkeys(w for ws in split for w in ws if w not in self.places)
        if unknown:
            self.learn(list(unknown))
        for words in split:
            yield self._of_words(words)

    def _of_words(self, words: list[str]) -> tuple:
        own = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        sums = self.figures[own].sum(axis=0)
        if not len(own) or sums[5]:
            return 0, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        digest, said, ends = hashlib.sha256(), [self.groups[i] for i in own.tolist()], self.pair_ends
        for i in range(0, len(said), 4096):
            part = "".join(said[i : i + 4096])
            digest.update((part if i + 4096 < len(said) else part[:-1]).encode())  # no sign after the last group
        kinds, many = np.unique(own, return_counts=True)
        lengths = ends[kinds + 1] - ends[kinds]
        flat = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - ends[kinds], lengths)
        key, back = np.unique(self.pairs[flat], return_inverse=True)
        total = np.bincount(back, weights=np.repeat(many, lengths), minlength=len(key)).astype(np.int64)
        return (*sums[:5].tolist(), digest.hexdigest(), key, total)


@lru_cache(maxsize=1)
def worker_tokenizers(first: str, second: str) -> Tokenizers:
    """One for all tasks of a worker, as reading the vocabularies takes as long as a few MB of text."""
    return Tokenizers(first, second)


FIGURES = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, the numbers of tokens, groups, links by bytes and links by group, the digest of the groups, and its
    distinct linked pairs of ids (as keys) with how often each is linked."""
    first, second = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = WordAlignments(worker_tokenizers(first, second))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = list(zip(*kept.of_texts(part.column(2).to_pylist()), strict=True))
                columns = [part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in found[:5]], pa.array(found[5], pa.string()), _lists(found[6]), _lists(found[7])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "pairs", "times"])

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"{FIGURES}, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, documents, best): in how many rows each pair is linked, and whether no pair of its first id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    counts = saved(counts.withColumn("first_id", F.floor(F.col("pair") / base).cast("long")), "counts")
    most = counts.groupBy("first_id").agg(F.max("documents").alias("most"))
    return counts.join(most, "first_id").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The commonest pairs, at most so many: those from the least eighth of a power of two on that keeps within."""
    step = F.floor(F.log2("documents") * 8).cast("long")
    seen, least = 0, None
    for at, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 8 * 64 rows
        seen += n
        if seen > most:
            break
        least = at
    return counts.where(step >= least) if least is not None else counts.where(F.lit(False))


def weigh(aligned: DataFrame, counts: DataFrame, *, frequent: int = FREQUENT) -> DataFrame:
    """Per row its figures with n_best and count_sum; ``aligned`` and ``counts`` are read more than once."""
    spark = aligned.sparkSession
    common = _frequent(counts, frequent).orderBy("pair").toArrow()
    keys, documents = (np.asarray(common.column(i).combine_chunks().to_numpy(), np.int64) for i in (0, 1))
    best = np.asarray(common.column(2).combine_chunks().to_numpy(zero_copy_only=False), bool)
    shared = spark.sparkContext.broadcast((keys, documents, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, documents, best = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                pairs, times = (part.column(part.schema.get_field_index(c)) for c in ("pairs", "times"))
                flat, often = (np.asarray(x.flatten(), np.int64) for x in (pairs, times))
                owner = np.repeat(np.arange(part.num_rows), np.asarray(pairs.value_lengths(), np.int64))
                place = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
                known = keys[place] == flat if len(keys) else np.zeros(len(flat), bool)
                sums = np.zeros((2, part.num_rows), np.int64)
                np.add.at(sums[0], owner[known], often[known] * best[place[known]])
                np.add.at(sums[1], owner[known], often[known] * documents[place[known]])
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[~known], minlength=part.num_rows)))).astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~known])) for x in (flat, often)]
                yield pa.RecordBatch.from_arrays([*part.columns[:8], pa.array(sums[0]), pa.array(sums[1]), *rest], [*part.schema.names[:8], "n_best", "count_sum", "pairs", "times"])

    figures = saved(aligned.mapInArrow(run, f"{FIGURES}, n_best long, count_sum long, pairs array<long>, times array<long>"), "weighed")
    rare = figures.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    added = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("documents")).alias("more"))
    out = figures.drop("pairs", "times").join(added, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def align_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256."""
    paths = paths or default_paths()
    aligned = saved(align(docs, id_col=id_col, text_col=text_col, paths=paths), "aligned")
    counts = saved(pair_counts(aligned, worker_tokenizers(*paths).base), "pairs")
    out = weigh(aligned, counts, frequent=frequent)
    unsaved(aligned)
    return out


def token_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, a_at, b_at, bytes): every link of every row, as places of the tokens in the text's two lists of tokens."""
    first, second = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = worker_tokenizers(first, second)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = tokenizers.words(text.as_py()) if text.as_py() else []
                done, links = align_words(tokenizers, words, links=True) if words else (None, [])
                if done is None or done.bad.any():
                    continue
                before_a, before_b = np.cumsum(done.n_a) - done.n_a, np.cumsum(done.n_b) - done.n_b
                for word, a, b, value in links:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(word), pa.int64()), pa.array(a + before_a[word]), pa.array(b + before_b[word]), pa.array(value, pa.int64())], ["doc_id", "a_at", "b_at", "bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, a_at long, b_at long, bytes long")

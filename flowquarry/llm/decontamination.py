"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Items are cut into windows of consecutive words, and windows and documents into word shingles. Every shingle of a window is
counted over all documents, and each window's shingles are ordered from the rarest. A window is contained whole where all
its shingles are, so the necessary prefix of that order is its rarest shingle alone: documents are joined with the windows on
it. The place of the shingle in the window then says where the window would start; starts that leave the document
(position) or that leave too few words behind (length) go, and the others are verified word for word.

The documents' words never shuffle: windows are dealt into blocks of bounded size, each broadcast against all documents, so a
passage that a third of the documents share is checked where they lie. Only verified places go through a shuffle, by
document. A window whose rarest shingle is in no document is dropped before the join.

Defined cases: null, empty and wordless texts have no words, and items without words have no window; an item of fewer
words than a window is one window; overlapping and repeated places all count, and a word hit twice is one hit word; shingles
that tie in rarity are taken by hash, then place; very long texts are searched whole; items with one id are one item with
the windows of all its rows; the words of items with a null id are hit, but no id is counted for them; rows with a null doc_id
get a result by their own text, and repeated rows repeated results; without documents the result is empty, without items
nothing is hit; other columns are not read, so their names are free.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WINDOW, SHINGLE = 10, 3
#: Words of a piece of a text.
PIECE_WORDS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII characters other than letters and digits, one by one: Java looks such a class up in one table.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: Bytes of one broadcast block; larger benchmarks take more blocks, each met by all documents.
BLOCK_BYTES = 32 << 20
ROW_BYTES = 120


def words(text: str) -> Column:
    """Runs of ASCII letters, in lower case, digits and characters beyond ASCII, whose case stays."""
    given = F.coalesce(text, F.lit(""))
    # On ASCII alone lower() is the same as translate() and faster.
    folded = F.when(F.octet_length(given) == F.length(given), F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    return F.array_remove(F.split(folded, BETWEEN), "")


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(row, doc_id, n, base, lead, words): each row's words in pieces of a bounded length.

    A piece owns PIECE_WORDS places from base on, and holds the words around that a window over them can have:
    ``lead`` of them before. n is the number of words of the whole text.
    """
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(text_col).alias("all"))
    cut = split.withColumn("n", F.size("all")).select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(PIECE_WORDS))).alias("base"))
    lead = F.least(F.col("base"), F.lit(width - 1))
    return cut.select("row", "doc_id", "n", "base", lead.alias("lead"), F.slice("all", F.col("base") - lead + 1, F.lit(PIECE_WORDS + width - 1) + lead).alias("words"))


def shingle_hash(first: Column, of: str, at: Column, width: int) -> Column:
    """A 64-bit hash of the words from a place on."""
    return F.xxhash64(first, *[F.get(of, at + i) for i in range(1, width)])


def _shingled(texts: DataFrame, width: int, *keep: str) -> DataFrame:
    """(at, hash) of every shingle, once, with the columns to keep: a row a word, hashed where it is exploded."""
    placed = texts.select("n", "base", "lead", "words", *keep, F.posexplode("words").alias("at", "word"))
    own = placed.where((F.col("at") >= F.col("lead")) & (F.col("at") < F.col("lead") + PIECE_WORDS) & (F.col("base") - F.col("lead") + F.col("at") + width <= F.col("n")))
    return own.withColumn("hash", shingle_hash(F.col("word"), "words", F.col("at"), width))


def windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item, window, window_key): each item's windows, once. The key is a digest of the words."""
    n = F.size("w")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.slice("w", i, width))
    own = items.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("w")).where(n > 0)
    each = own.select("item", F.explode(cut).alias("window")).distinct()
    return each.withColumn("window_key", F.sha2(F.array_join("window", " "), 256))


def _blocks(rows: DataFrame, key: str, size: Column, most: int) -> list[DataFrame]:
    """The rows dealt by a hash of the key into as many parts as keep each, on average, within half of most bytes."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = int(total // (most // 2)) + 1
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [rows]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def rarest_shingles(texts: DataFrame, kept: DataFrame, *, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(window_key, window, width, hash, place): the necessary prefix of each window that documents can have.

    ``texts`` are the documents' pieces, ``kept`` the distinct windows.
    """
    n = F.size("window")
    cut = []
    for own in range(1, shingle + 1):  # a window narrower than a shingle is one shingle of its own width
        fit = kept.where(n >= own) if own == shingle else kept.where(n == own)
        at = fit.select("window_key", "window", F.lit(own).alias("width"), F.explode(F.sequence(F.lit(0), n - own)).alias("place"))
        cut.append(at.withColumn("hash", shingle_hash(F.get("window", "place"), "window", F.col("place"), own)))
    placed = saved(_union(cut), "shingles")
    counted = []
    for (own,) in placed.select("width").distinct().collect():  # at most as many as a shingle has words
        wanted = placed.where(F.col("width") == own).select("hash").distinct()
        for block in _blocks(wanted, "hash", F.lit(ROW_BYTES), block_bytes):
            met = _shingled(texts, own).select("hash").join(F.broadcast(block), "hash")
            counted.append(met.groupBy("hash").count().withColumn("width", F.lit(own)))
    if not counted:
        return placed
    counts = _union(counted)
    order = Window.partitionBy("window_key").orderBy("count", "hash", "place")
    # All shingles of a window must be met, so none of them may be missing, and one is enough to find it by.
    ranked = placed.join(counts, ["hash", "width"], "left").withColumn("rank", F.row_number().over(order)).withColumn("least", F.min(F.coalesce("count", F.lit(0))).over(Window.partitionBy("window_key")))
    return ranked.where((F.col("rank") == 1) & (F.col("least") > 0)).select("window_key", "window", "width", "hash", "place")


def places(texts: DataFrame, prefixes: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, start, length, window_key): every place of a window in a document, verified word for word."""
    found = []
    size = F.length(F.array_join("window", " ")) * 2 + ROW_BYTES
    for (own,) in prefixes.select("width").distinct().collect():
        for block in _blocks(prefixes.where(F.col("width") == own), "window_key", size, block_bytes):
            length, before = F.size("window"), F.col("base") - F.col("lead")
            start = before + F.col("at") - F.col("place")
            fits = (start >= 0) & (start + length <= F.col("n"))
            stands = F.when(fits, F.slice("words", start - before + 1, length) == F.col("window"))
            met = _shingled(texts, own, "row").join(F.broadcast(block.drop("width")), "hash").where(fits & stands)
            found.append(met.select("row", start.alias("start"), length.alias("length"), "window_key"))
    return _union(found) if found else texts.select("row", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window_key")).where(F.lit(False))


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    width: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (ids in order, as strings), contaminated."""
    texts = saved(pieces(docs, id_col=id_col, text_col=text_col, width=width), "words")
    cut = saved(windows(items, id_col=item_id_col, text_col=item_text_col, width=width), "windows")
    kept = cut.select("window_key", "window").distinct()
    prefixes = saved(rarest_shingles(texts, kept, shingle=shingle, block_bytes=block_bytes), "prefixes")
    met = saved(places(texts, prefixes, block_bytes=block_bytes), "places")

    # A place adds the words beyond the furthest end of the places that start before it.
    end, before = F.col("start") + F.col("length"), Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    added = met.withColumn("reach", F.max(end).over(before)).select("row", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("reach", F.lit(0)))).alias("added"))
    hit = added.groupBy("row").agg(F.sum("added").alias("n_hit"))
    hit_windows = met.select("row", "window_key").distinct()
    listed = [hit_windows.join(F.broadcast(block), "window_key") for block in _blocks(cut.select("window_key", "item").where(F.col("item").isNotNull()), "item", F.lit(2 * ROW_BYTES), block_bytes)]
    held = _union(listed).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = texts.where(F.col("base") == 0).select("row", "doc_id", F.col("n").cast("long").alias("n_words")).join(hit, "row", "left").join(held, "row", "left")
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_or_none).cast("long").alias("n_items"),
        items_or_none.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose words no item's window hits, with all their columns; rows share a result with equal texts."""
    found = decontaminate(docs.withColumn("__text_key", F.sha2(F.coalesce(text_col, F.lit("")), 256)), items, id_col="__text_key", text_col=text_col, **options)
    dirty = found.where("contaminated").select(F.col("doc_id").alias("__text_key")).distinct()
    return docs.withColumn("__text_key", F.sha2(F.coalesce(text_col, F.lit("")), 256)).join(dirty, "__text_key", "left_anti").drop("__text_key")


"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint of its word shingles. The distinct fingerprints are dealt into tiles by the
population counts of their 16-bit blocks. Two fingerprints within the radius differ by at most that much in the
summed block counts, so tile pairs further apart are skipped and the others are compared whole with numpy
exclusive-or and bit counts. Links found in a task leave it as a spanning star, never as all pairs; connected
components are found by repeated star contraction.

Defined cases: null and wordless texts have fingerprint zero and link like any other; texts under the shingle
width give one shingle of all their words; very long texts are hashed whole, one at a time; a bit set in just half of
the shingles is 0; rows with a null id get a component but never name one; repeated rows give repeated results; an
empty table gives an empty result; other columns are not read, so their names are free.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, unsaved

SEED = 42
BLOCKS, BLOCK_BITS = 4, 16
ROWS, COLUMNS = 512, 1024
#: Rows of one tile that a task holds at once; larger tiles, by count, are cut into chunks, compared chunk by chunk.
CHUNK_ROWS = 65_536


def text_fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n < width:
        hashes = np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _block_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, BLOCKS)).astype(np.int64)


def _shifts(radius: int) -> np.ndarray:
    """Differences of block counts, other than none, that two fingerprints within the radius can have."""
    span = range(-radius, radius + 1)
    return np.array([d for d in itertools.product(span, repeat=BLOCKS) if 0 < sum(map(abs, d)) <= radius], np.int64).reshape(-1, BLOCKS)


BASE = np.array([(BLOCK_BITS + 1) ** i for i in range(BLOCKS)], np.int64)
TILES = (BLOCK_BITS + 1) ** BLOCKS


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a tile, summed within the task."""
    sums = np.zeros(TILES, np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sums += np.bincount(_block_counts(fps.view(np.uint64)) @ BASE, minlength=TILES)
    own = np.nonzero(sums)[0]
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[own])], ["tile", "n"])


def _deal(radius: int, shared: Broadcast):
    """Sends each fingerprint to its own tile (role 0), and as a guest (role 1) to every lower tile or chunk in reach.
    ``shared`` has the number of chunks of each tile."""
    shifts = _shifts(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = shared.value
        most = int(chunks.max())
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fps):
                continue
            counts = _block_counts(fps.view(np.uint64))
            tile = counts @ BASE
            own = ((fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % chunks[tile]
            out = [(tile * most + own, np.zeros(len(fps), np.int8), fps)]
            for c in range(most - 1):
                low = own > c
                out.append((tile[low] * most + c, np.ones(int(low.sum()), np.int8), fps[low]))
            for shift in shifts:
                near = counts + shift
                ok = ((near >= 0) & (near <= BLOCK_BITS)).all(axis=1)
                ok[ok] = (near[ok] @ BASE < tile[ok]) & (chunks[near[ok] @ BASE] > 0)  # to lower tiles that have rows
                key, guests = near[ok] @ BASE, fps[ok]
                for c in range(most):
                    some = chunks[key] > c
                    out.append((key[some] * most + c, np.ones(int(some.sum()), np.int8), guests[some]))
            for key, role, fp in out:
                if len(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(fp)], ["cell", "role", "fp"])

    return run


class _Forest:
    """Union-find over the fingerprints of one cell; the root is the smallest."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = min(a, b), max(a, b)
            self.parent[high] = low
            self.parent.setdefault(low, low)


def _link(forest: _Forest, left: np.ndarray, right: np.ndarray, radius: int) -> None:
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= radius
    found = int(near.sum())
    if not found:
        return
    if found <= 4096:
        for i, j in zip(*np.nonzero(near), strict=True):
            forest.join(int(left[i]), int(right[j]))
        return
    while True:  # dense block: each column joins one row of another group, until all linked ones share a group
        roots_l = np.array([forest.root(x) for x in left.tolist()])
        roots_r = np.array([forest.root(x) for x in right.tolist()])
        apart = near & (roots_l[:, None] != roots_r[None, :])
        columns = np.nonzero(apart.any(axis=0))[0]
        if not len(columns):
            return
        for j, i in zip(columns.tolist(), apart[:, columns].argmax(axis=0).tolist(), strict=True):
            forest.join(int(left[i]), int(right[j]))


def _compare(radius: int):
    """Reads cells in order, their own fingerprints before their guests, and yields a star for each group of linked ones."""

    def stars(forest: _Forest) -> pa.RecordBatch | None:
        pairs = [(x, r) for x in list(forest.parent) if (r := forest.root(x)) != x]
        if not pairs:
            return None
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, forest, own = None, _Forest(), []
        for batch in batches:
            cells, roles, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.nonzero(np.diff(cells) | np.diff(roles))[0] + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    if (out := stars(forest)) is not None:
                        yield out
                    cell, forest, own = cells[lo], _Forest(), []
                part = np.ascontiguousarray(fps[lo:hi], np.int64)
                for i in range(0, len(part), COLUMNS):
                    columns = part[i : i + COLUMNS]
                    for rows in own:
                        _link(forest, rows, columns, radius)
                    if roles[lo] == 0:
                        _link(forest, columns, columns, radius)
                        own += [columns[k : k + ROWS] for k in range(0, len(columns), ROWS)]
        if (out := stars(forest)) is not None:
            yield out

    return run


def links(distinct: DataFrame, *, radius: int = 2) -> DataFrame:
    """(a, b): spanning links, per tile, among distinct fingerprints (column fp) that differ in at most radius bits."""
    spark = distinct.sparkSession
    chunks = np.zeros(TILES, np.int64)
    for r in distinct.select("fp").mapInArrow(_tiles, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).collect():  # at most TILES rows
        chunks[r["tile"]] = 1 + (r["n"] - 1) // CHUNK_ROWS
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp").mapInArrow(_deal(radius, spark.sparkContext.broadcast(chunks)), "cell long, role byte, fp long")
    return dealt.repartition(4 * parts, "cell").sortWithinPartitions("cell", "role", "fp").mapInArrow(_compare(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b), by star contraction."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"] or before == tuple(mark):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(mark)
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, saved(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        unsaved(last)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable over links, its own included."""
    marked = saved(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    rooted = components(links(distinct, radius=radius))
    placed = distinct.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = placed.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs whose id names their component; all columns are kept, as are rows with a null id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, radius=radius)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__dup")).distinct()
    return docs.join(others, F.col(id_col) == F.col("__dup"), "left_anti")

"""Neighbours in embeddings, and per-entity baselines."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordered


def _packed(vectors: DataFrame, size: int, dims: int | None, dtype: type) -> DataFrame:
    """(ids, data): vectors in rows of at most size, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), size):
                part = batch.iloc[i : i + size]
                data = np.array([e[:dims] for e in part["embedding"]], dtype)
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "ids binary, data binary")


def _merged(d: np.ndarray, o: np.ndarray, rows: np.ndarray, distances: np.ndarray, others: np.ndarray) -> None:
    """Puts found distances and ids into the nearest of each row, d and o, in place; equal distances by id."""
    k, hit = d.shape[1], np.unique(rows)
    r = np.concatenate([np.repeat(hit, k), rows])
    x, y = np.concatenate([d[hit].ravel(), distances]), np.concatenate([o[hit].ravel(), others])
    order = np.lexsort((y, x, r))
    best = order[np.searchsorted(r[order], hit)[:, None] + np.arange(k)]
    d[hit], o[hit] = x[best], y[best]


def _near(vectors: DataFrame, queries: DataFrame, *, k: int, spaces: list[int | None], block: int) -> DataFrame:
    """(vec_id, space, other, distance): of each query, the k nearest others in a part of the vectors, exactly, in each
    space, which is the first so many dimensions (None: all; the widest comes last).

    Blocks of ``block`` queries meet all vectors, packed in rows of ``block`` too, as floats where they are floats. A matrix
    product of doubles, which a wider space takes over from the one before, gives distances that are a little off; those
    within its error of the k-th are worked out again from the differences. A task reads blocks where Arrow has put them
    and keeps k for each query of the block that it is at.
    """
    dtype = np.float32 if vectors.schema["embedding"].dataType == queries.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else np.float64
    widest, most = spaces[-1], 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, q, held = None, None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            for space, (d, o) in enumerate(held):
                known = np.isfinite(d).ravel()
                found = np.repeat(ids, k)[known], np.full(known.sum(), space, np.int32), o.ravel()[known], d.ravel()[known]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["vec_id", "space", "other", "distance"])

        for batch in batches:
            for row in zip(*batch.select(["qids", "qdata", "ids", "data"]).columns, strict=True):
                name, data, own, theirs = (x.as_buffer() for x in row)
                if at is None or not name.equals(at):
                    yield from out()
                    at = pa.py_buffer(name.to_pybytes())
                    ids = np.frombuffer(at, np.int64)
                    q = np.frombuffer(data, dtype).astype(np.float64).reshape(len(ids), -1)
                    held = [(np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)) for _ in spaces]
                own = np.frombuffer(own, np.int64)
                v = np.frombuffer(theirs, dtype).astype(np.float64).reshape(len(own), -1)
                same = np.isin(ids, own).any() and ids[:, None] == own[None]
                qq, vv, near, done = 0.0, 0.0, 0.0, 0
                for width, (d, o) in zip(spaces, held, strict=True):
                    x, y = q[:, done:width], v[:, done:width]
                    more, done = (y * y).sum(axis=1), width
                    qq, vv = qq + (x * x).sum(axis=1), vv + more
                    # the square of the distance, less that of the query, which is the same along a row
                    near = near + np.c_[-2 * x, np.ones(len(x))] @ np.c_[y, more].T
                    if same is not False:
                        near[same] = np.inf
                    limit = d[:, -1] - qq
                    if len(own) >= k and np.isinf(limit).any():
                        limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
                    few = np.flatnonzero(near <= (limit + 1e-9 * (qq + vv.max()))[:, None])
                    for i in range(0, len(few), most):
                        rows, cols = np.divmod(few[i : i + most], len(own))
                        fit = np.isfinite(near[rows, cols])
                        rows, cols = rows[fit], cols[fit]
                        if len(rows):
                            _merged(d, o, rows, ((q[rows, :width] - v[cols, :width]) ** 2).sum(axis=1), own[cols])
            batch = row = name = data = own = theirs = None  # else they are held while the next batch is read
        yield from out()

    # dealt out, so that blocks are packed once, not by each task that needs them; vectors in four parts, so a query has four
    # times k rows to choose from; the hint keeps a block's pairs together
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _packed(queries, block, widest, dtype).toDF("qids", "qdata").repartition(parts).hint("shuffle_replicate_nl")
    return left.crossJoin(_packed(vectors, block, widest, dtype).repartition(4)).mapInArrow(run, "vec_id long, space int, other long, distance double")


def _nearest_of(k: int, space: int) -> Column:
    own = F.collect_list(F.when(F.col("space") == space, F.struct("distance", "other")))
    return F.transform(F.slice(F.sort_array(own), 1, k), lambda x: x["other"])


def knn(vectors: DataFrame, queries: DataFrame, *, k: int, dims: int | None = None, block: int = 512) -> DataFrame:
    """(vec_id, neighbours): the k nearest others of each query, exactly; equal distances by id."""
    near = _near(vectors, queries, k=k, spaces=[dims], block=block)
    return near.groupBy("vec_id").agg(_nearest_of(k, 0).alias("neighbours"))


def knn_overlap(vectors: DataFrame, *, first: int, k: int, block: int = 512) -> DataFrame:
    """How many of its k nearest each vector shares between the whole space and its first dimensions."""
    near = _near(vectors, vectors, k=k, spaces=[first, None], block=block)
    both = near.groupBy("vec_id").agg(_nearest_of(k, 1).alias("neighbours"), _nearest_of(k, 0).alias("others"))
    return both.withColumn("shared", F.size(F.array_intersect("neighbours", "others")))


def host_baseline(fit: DataFrame, score: DataFrame, *, components: int = 3, trim: float = 0.05, piece_rows: int = 20_000) -> DataFrame:
    """(host, id, distance): the least robust Mahalanobis distance of each row from its host's components.

    A host's components are clusters of all its fit rows (host, id, x array, all of one length), started at the rows whose
    ids hash lowest; their covariance is shrunk towards its diagonal, and a share of far rows is trimmed. Rows are laid out
    once, in buckets by host and piece of about ``piece_rows`` rows, and centres are a table that each step joins with
    them, where they lie; a step's one figure for the driver is how far the centres moved. Rows without a host or x are
    left out, and only hosts that are scored get a model.
    """
    from ..sources.corpus import shared_path

    spark = fit.sparkSession
    kind = fit.schema["host"].dataType.simpleString()
    schema = f"host {kind}, id {score.schema['id'].dataType.simpleString()}, distance double"

    def stored(df: DataFrame, tag: str) -> DataFrame:
        path = shared_path(spark, tag)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    known = fit.where("host is not null and x is not null").select("host", "id", F.col("x").cast("array<double>").alias("x"), F.xxhash64("id").alias("h"))
    per = stored(known.groupBy("host").agg(F.ceil(F.count("*") / piece_rows).alias("pieces"), F.first(F.size("x")).alias("dims")), "baseline-hosts")
    some = per.first()
    if some is None:
        return spark.createDataFrame([], schema)
    dims, name = some.dims, f"baseline_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = known.join(per, "host").select("host", F.pmod("h", "pieces").alias("piece"), "h", "id", "x").repartition(buckets, "host", "piece")
    placed.write.bucketBy(buckets, "host", "piece").sortBy("host", "piece").option("path", shared_path(spark, "baseline")).saveAsTable(name)
    try:
        rows = spark.table(name)
        first = rows.withColumn("i", F.row_number().over(Window.partitionBy("host").orderBy("h", "id"))).where(F.col("i") <= components)
        seeds = first.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
        # hosts of fewer rows than components get centres that nothing is near to
        far = F.array_repeat(F.array_repeat(F.lit(float("inf")), dims), components)
        centres = stored(seeds.join(per, "host").select("host", "pieces", F.slice(F.concat("c", far), 1, components).alias("c")), "baseline-centres")
        for _ in range(20):
            seen = Observation()
            sums = _beside(rows, centres).mapInArrow(_sums(components, dims), f"host {kind}, i int, n long, total array<double>")
            centres = stored(_moved(centres, sums, dims).observe(seen, F.max("moved").alias("moved")).drop("moved"), "baseline-centres")
            if seen.get["moved"] < 1e-12:
                break
        far_off = stored(_beside(rows, centres).mapInArrow(_near_rows(components, dims), f"host {kind}, i int, d double"), "baseline-distances")
        needed = far_off.groupBy("host", "i").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * (1 - trim))).alias("need"))
        ranked = ordered.running_total(far_off, F.lit(1), ["d"], by=["host", "i"], name="rank").join(needed, ["host", "i"]).where("rank = need")
        limits = ranked.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("limit"))
        bounded = centres.join(limits, "host").join(score.select("host").distinct(), "host", "left_semi")
        bounded = bounded.select("host", "pieces", "c", F.transform("c", lambda c, i: F.coalesce(F.element_at("limit", i), F.lit(-1.0))).alias("limits"))
        partial = _beside(rows, bounded).mapInPandas(_outer(components, dims), f"host {kind}, i int, centre array<double>, n long, total array<double>, outer array<double>")
        models = stored(partial.groupBy("host", "i").applyInPandas(_model, f"host {kind}, centre array<double>, inverse array<double>"), "baseline-models")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

    def distances(own: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(models):
            return own[["host", "id"]].iloc[:0].assign(distance=0.0)
        x = np.array(own["x"].tolist(), float)
        least = np.full(len(x), np.inf)
        for centre, inverse in models[["centre", "inverse"]].itertuples(index=False):
            d = x - centre
            least = np.minimum(least, ((d @ np.asarray(inverse).reshape(len(centre), -1)) * d).sum(axis=1))
        return pd.DataFrame({"host": own["host"], "id": own["id"], "distance": np.sqrt(np.maximum(least, 0.0))})

    # a host's rows go in pieces of about 20,000, each with the host's models
    pieces = score.groupBy("host").agg(F.ceil(F.count("*") / 20_000).alias("pieces"))
    left = score.join(pieces, "host").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces"))
    right = models.join(pieces, "host").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return left.select("host", "id", "x", "piece").groupBy("host", "piece").cogroup(right.select("host", "piece", "centre", "inverse").groupBy("host", "piece")).applyInPandas(distances, schema)


def _beside(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows with their host's centres, which go to each of the host's pieces."""
    pieces = centres.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return rows.join(pieces.drop("pieces"), ["host", "piece"])


def _moved(centres: DataFrame, sums: DataFrame, dims: int) -> DataFrame:
    """(host, pieces, c, moved): the centres at the means of the rows nearest to them, and the largest move, relative."""
    added = sums.groupBy("host", "i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(dims)]).alias("total"))
    shift = added.select("host", "i", F.transform("total", lambda t: t / F.col("n")).alias("shift"))
    moves = shift.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("i", "shift"))).alias("moves"))
    widest = lambda x: F.array_max(F.transform(x, lambda v: F.abs(v)))
    own = centres.join(moves, "host")
    own = own.withColumn("c", F.transform("c", lambda c, i: F.coalesce(F.zip_with(c, F.element_at("moves", i), lambda a, b: a + b), c)))
    reach = F.array_max(F.transform(F.filter(F.flatten("c"), lambda v: v < float("inf")), lambda v: F.abs(v)))
    return own.select("host", "pieces", "c", (F.array_max(F.transform(F.map_values("moves"), widest)) / F.when(reach > 0, reach).otherwise(1.0)).alias("moved"))


def _nearest(batch: pa.RecordBatch, components: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as differences from the centre that each is nearest to, which one that is, and the square of the distance."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    c = batch.column("c").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, components, dims)
    d = np.stack([((x - c[:, i]) ** 2).sum(axis=1) for i in range(components)], axis=1)
    near = d.argmin(axis=1)
    every = np.arange(len(x))
    return x - c[every, near], near, d[every, near]


def _sums(components: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(host, i, n, total): in each batch, the differences from centre i added up over the rows that are nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, near, _ = _nearest(batch, components, dims)
            key = batch.column("host").dictionary_encode().indices.to_numpy().astype(np.int64) * components + near
            order = np.argsort(key, kind="stable")
            _, start, n = np.unique(key[order], return_index=True, return_counts=True)
            total = np.add.reduceat(z[order], start)
            totals = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * dims, pa.int32()), pa.array(total.ravel()))
            head = order[start]
            columns = [batch.column("host").take(pa.array(head)), pa.array(near[head], pa.int32()), pa.array(n, pa.int64()), totals]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "i", "n", "total"])

    return run


def _near_rows(components: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(host, i, d): of each row, the centre that it is nearest to and the square of the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, near, d = _nearest(batch, components, dims)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(near, pa.int32()), pa.array(d)], names=["host", "i", "d"])

    return run


def _outer(components: int, dims: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(host, i, centre, n, total, outer): sums and outer products of the differences within a centre's limit. A task adds
    up a host's as long as its rows follow each other, as they do in a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, sums = None, {}

        def ready() -> pd.DataFrame:
            return pd.DataFrame([(host, i, c, n, t, o.ravel()) for i, (c, n, t, o) in sums.items()], columns=["host", "i", "centre", "n", "total", "outer"])

        for batch in batches:
            for k, g in batch.groupby("host", sort=False):
                if k != host:
                    if sums:
                        yield ready()
                    host, sums = k, {}
                c, limits = np.array([list(v) for v in g["c"].iloc[0]], float), g["limits"].iloc[0]
                x = np.array(g["x"].tolist(), float)
                d = np.stack([((x - v) ** 2).sum(axis=1) for v in c], axis=1)
                near, least = d.argmin(axis=1), d.min(axis=1)
                for i in np.unique(near):
                    z = x[(near == i) & (least <= limits[i])] - c[i]
                    _, n, t, o = sums.get(i, (None, 0, np.zeros(dims), np.zeros((dims, dims))))
                    sums[i] = (c[i], n + len(z), t + z.sum(axis=0), o + z.T @ z)
        if sums:
            yield ready()

    return run


def _model(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean and the inverse of the shrunk covariance, from one row of sums a task."""
    n = pdf["n"].sum()
    shift = np.sum(pdf["total"].tolist(), axis=0) / n
    cov = np.sum(pdf["outer"].tolist(), axis=0).reshape(len(shift), -1) / n - np.outer(shift, shift)
    shrunk = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(shift))
    return pd.DataFrame([(pdf["host"].iloc[0], pdf["centre"].iloc[0] + shift, np.linalg.inv(shrunk).ravel())], columns=["host", "centre", "inverse"])

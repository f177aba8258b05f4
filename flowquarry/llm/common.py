"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words for the contracts that say [^\x20\x09-\x0D]+; bytes.split() splits at just these.
SPACE_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, local sessions take a temporary folder; on a cluster it would not be shared, so this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _fallback_root(spark)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _fallback_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame, tag: str, *, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsaved(df: DataFrame) -> None:
    """Deletes the files of a frame that saved() returned, once nothing that is still to run reads them."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_crc(doc_id: str | Column) -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary"))


def hash_below(doc_id: str, share: Column) -> Column:
    """True for about this share of the ids, the same ones in every run."""
    unit = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)
    return unit < share


def code_points(text: str | Column) -> Column:
    """Length in code points, null for null."""
    return F.length(text).cast("long")


def range_splits(df: DataFrame, key: str, parts: int) -> list[float]:
    """At most parts - 1 increasing quantiles of a numeric key: bounded, and found in one pass over that column.

    The error allowed follows the number of parts, so that no part is much larger than another.
    """
    if parts < 2:
        return []
    cuts = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted(set(cuts))


def with_range_bucket(df: DataFrame, key: str, splits: list[float], name: str) -> DataFrame:
    """Adds the long column name: how many splits are at or below the key (null keys: -1)."""
    from pyspark.ml.feature import Bucketizer

    if not splits:
        return df.withColumn(name, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    raw = f"__{name}_key"
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol=raw, outputCol=name, handleInvalid="keep")
    keyed = df.withColumn(raw, F.col(key).cast("double"))
    return cut.transform(keyed).drop(raw).withColumn(name, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col(name)).cast("long"))

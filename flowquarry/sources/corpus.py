"""The corpus of behaviour windows and the alert sink."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["host", "lhour", "cat"]


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder in local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def upsert_windows(new: DataFrame, path: str, *, version: int) -> None:
    """Writes windows beside those at path: days that new ones touch are rewritten, the latest version of a key stays.

    The folder is partitioned by local day, and only the touched days are read, merged and overwritten.
    """
    spark = new.sparkSession
    rows = new.withColumn("day", F.floor(F.col("lhour") / 24).cast("long")).withColumn("version", F.lit(version).cast("long"))
    if exists(spark, path):
        days = rows.select("day").distinct()
        old = spark.read.parquet(path).join(days, "day", "left_semi")
        staged = shared_path(spark, "upsert")
        latest_wins(old.unionByName(rows, allowMissingColumns=True), KEY, "version").write.parquet(staged)  # what is overwritten must not be read meanwhile
        rows = spark.read.parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def read_windows(spark: SparkSession, path: str, *, low: int, high: int, include_flagged: bool = False, hosts: list | None = None) -> DataFrame:
    """Windows of local hours low to high (not included), by day partitions, without flagged ones unless asked for."""
    df = spark.read.parquet(path).where(F.col("day").between(low // 24, (high - 1) // 24) & (F.col("lhour") >= low) & (F.col("lhour") < high))
    if not include_flagged:
        df = df.where(~F.coalesce("flagged", F.lit(False)))
    return df.where(F.col("host").isin(hosts)) if hosts is not None else df


def mark_flagged(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    hit = pairs.select("host", "lhour").distinct().withColumn("__hit", F.lit(True))
    return windows.join(hit, ["host", "lhour"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)) | F.col("__hit").isNotNull()).drop("__hit")


def merge_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """Corpora along their hosts, whose names get the corpus's in front."""
    parts = [df.withColumn("host", F.concat(F.lit(f"{name}/"), F.col("host").cast("string"))) for name, df in corpora.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def export_pseudonymised(windows: DataFrame) -> DataFrame:
    """Windows that are not flagged, with hosts named site-01 and so on in their order."""
    kept = windows.where(~F.coalesce("flagged", F.lit(False)))
    names = kept.select("host").distinct().withColumn("__n", F.row_number().over(Window.orderBy("host")))  # a row a host
    n = F.col("__n").cast("string")
    return kept.join(names, "host").withColumn("host", F.concat(F.lit("site-"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))).drop("__n")  # lpad shortens what is longer


def write_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def recent_alerts(spark: SparkSession, path: str, schema, *, n: int) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(F.desc("ts"), "id").limit(n)

"""Selections: budgets, samples, splits, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered


def hash_unit(*cols: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the columns and a seed, the same in every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def select_hosts(profile: DataFrame, labelled: DataFrame, *, n: int) -> DataFrame:
    """The n busiest hosts, and all labelled ones that have traffic."""
    busiest = profile.orderBy(F.desc("flows"), "host").limit(n).select("host")
    return busiest.union(profile.join(labelled, "host", "left_semi").select("host")).distinct()


def budget_size(share: float, n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(share) * n, 0)).cast("int")


def escalate_hourly(scores: DataFrame, *, share: float = 0.05) -> DataFrame:
    """The highest scores of each hour, as many as the budget share of the hosts live in it, ties by host."""
    w = Window.partitionBy("day", "hour")
    ranked = scores.withColumns({"__i": F.row_number().over(w.orderBy(F.desc("score"), "host")), "__k": budget_size(share, F.count("*").over(w))})
    return ranked.where(F.col("__i") <= F.col("__k")).drop("__i", "__k")


def budget_scatter(scores: DataFrame, *, share: float = 0.05) -> DataFrame:
    """One row: host-days touched when the budget is spent on single hours, and when on whole host-days.

    The cut is the k-th highest score, found with a limit, so no rank is given to all rows in one task.
    """
    n = scores.count()
    k = max(1, round(share * n))
    top = scores.orderBy(F.desc("score"), "doc_id").limit(k)
    days = scores.groupBy("host", "day").agg(F.max("score").alias("score"))
    m = days.count()
    picked = days.orderBy(F.desc("score"), "host", "day").limit(max(1, round(share * m)))
    by_hour = top.agg(F.count("*").alias("hours"), F.count_distinct("host", "day").alias("host_days_by_hour"))
    return by_hour.crossJoin(picked.agg(F.count("*").alias("host_days_by_day"))).withColumn("scatter", F.col("host_days_by_hour") / F.col("host_days_by_day"))  # one row each


def audit_sample(rows: DataFrame, tiers: DataFrame, *, seed: int = 7) -> DataFrame:
    """Rows for blind audit at their tier's rate, whatever their score."""
    return rows.join(F.broadcast(tiers), "tier").where(hash_unit("host", "day", seed=seed) < F.col("audit"))  # one row a tier


def escalate_days(days: DataFrame, *, cut: float) -> DataFrame:
    """The reason a host-day is escalated: refuse, audit, commissioning, incident or router, in that order."""
    c = F.col
    reason = F.when(c("refused"), "refuse").when(c("audited"), "audit").when(c("state") == "COMMISSIONING", "commissioning").when(c("incident"), "incident").when(c("score") >= cut, "router")
    return days.withColumn("reason", reason)


def temporal_split(rows: DataFrame, *, share: float = 0.5) -> DataFrame:
    """train is True in the first share of the days that occur."""
    days = rows.select("day").distinct()
    ranked = days.withColumn("__i", F.row_number().over(Window.orderBy("day"))).withColumn("__n", F.count("*").over(Window.partitionBy()))  # one row a day
    return rows.join(F.broadcast(ranked.select("day", (F.col("__i") <= F.floor(F.col("__n") * share)).alias("train"))), "day")


def family_folds(rows: DataFrame, *, k: int = 5, most: int = 100, seed: int = 7) -> DataFrame:
    """Rows with fold, one for each family, and of each family the first ``most`` in hashed order."""
    w = Window.partitionBy("family").orderBy(hash_unit("id", seed=seed), "id")
    fold = F.floor(hash_unit("family", seed=seed) * k).cast("int")
    return rows.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= most).withColumn("fold", fold).drop("__i")


def stratified_split(rows: DataFrame, *, by: str, share: float = 0.8, seed: int = 7) -> DataFrame:
    """train is True for the first share of each class in hashed order."""
    w = Window.partitionBy(by)
    i = F.row_number().over(w.orderBy(hash_unit("id", seed=seed), "id"))
    return rows.withColumn("train", i <= F.floor(F.count("*").over(w) * share))


def rank_of(rows: DataFrame, *, scores: list[str], positive: str = "attack") -> DataFrame:
    """Per scorer and positive row: how many rows score higher, plus one. Counts are kept by distinct score."""
    long = rows.select("id", positive, F.inline(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).cast("double").alias("x")) for s in scores])))
    per = long.groupBy("scorer", "x").agg(F.count("*").alias("n"))
    above = per.withColumn("rank", F.coalesce(F.sum("n").over(Window.partitionBy("scorer").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    return long.where(positive).join(above, ["scorer", "x"]).select("scorer", "id", "rank")


def thin_to_density(rows: DataFrame, *, target: float, hours: int = 24, seed: int = 7) -> DataFrame:
    """Rows of hosts with an attack, and of other hosts as many rows, in hashed order, as the target density allows.

    Rows are numbered in two levels, so one host's rows are shared out among tasks.
    """
    days = rows.groupBy("host", "day").agg(F.max(F.col("attack").cast("int")).alias("__a"))
    hosts = days.groupBy("host").agg(F.max("__a").alias("__a"), F.ceil(F.lit(target) * hours * F.count("day")).alias("__k"))
    hosts = hosts.select(F.col("host").alias("__host"), F.coalesce(F.col("__a") == 1, F.lit(False)).alias("__a"), "__k")
    numbered = ordered.running_total(rows.withColumn("__h", hash_unit("doc_id", seed=seed)), F.lit(1), ["__h", "doc_id"], by=["host"], name="__i")
    kept = numbered.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).where(F.col("__a") | (F.col("__i") <= F.col("__k")))
    return kept.select(*rows.columns)


def permute_hours(rows: DataFrame, *, seed: int = 7) -> DataFrame:
    """Hours of each host-day dealt anew in a hashed order."""
    i = F.row_number().over(Window.partitionBy("host", "day").orderBy(hash_unit("host", "day", "hour", seed=seed), "hour")) - 1
    return rows.withColumn("hour", i)

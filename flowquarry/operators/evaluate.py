"""Evaluation of scores: AUC, budgets, thresholds, tests, drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered

from .select import hash_unit

#: 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069,
    2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def roc_auc(scores: DataFrame, keys: list[str] | None = None, *, weight: str | None = None) -> DataFrame:
    """AUC per key, with ties counted half, from counts at each distinct score; with n_pos and n_neg."""
    keys = keys or []
    w = F.col(weight) if weight else F.lit(1)
    per = scores.groupBy(*keys, "score").agg(F.sum(F.when(F.col("attack"), w).otherwise(0)).alias("p"), F.sum(F.when(~F.col("attack"), w).otherwise(0)).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*keys).orderBy("score")) - F.col("q")
    won = per.withColumn("__won", F.col("p") * (below + F.col("q") / 2.0))
    out = won.groupBy(*keys).agg(F.sum("__won").alias("won"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return out.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg")))).drop("won")


def within_host_auc(scores: DataFrame, *, least_pos: int = 1, least_neg: int = 5) -> DataFrame:
    """One row: mean and deviation of hosts' own AUCs, hosts and positives."""
    per = roc_auc(scores, ["host"]).where((F.col("n_pos") >= least_pos) & (F.col("n_neg") >= least_neg))
    return per.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.count("*").alias("hosts"), F.sum("n_pos").alias("positives"))


def paired_hosts(scores: DataFrame) -> DataFrame:
    """(host, a, b): a host's mean score on attacks and on other rows, for hosts with both; one pre-aggregated pass."""
    of = lambda test: F.round(F.avg(F.when(test, F.col("score"))), 6)
    return scores.groupBy("host").agg(of(F.col("attack")).alias("a"), of(~F.col("attack")).alias("b")).where("a is not null and b is not null")


def budget_curve(scores: DataFrame, budgets: list[float]) -> DataFrame:
    """Per budget: share of teacher flags and of attacks among its highest scores, ties by id.

    Ranks come from counts by score in two levels, so no task sorts all rows.
    """
    ranked = global_rank(scores)
    n = scores.agg(F.count("*").alias("n"), F.sum(F.col("attack").cast("int")).alias("attacks"), F.sum(F.col("teacher_flag").cast("int")).alias("flags"))
    grid = scores.sparkSession.createDataFrame([(b,) for b in budgets], "budget double")
    cuts = grid.crossJoin(n).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("budget") * F.col("n"), 0)).cast("long"))
    tests = ranked.crossJoin(F.broadcast(cuts)).where(F.col("rank") <= F.col("k"))  # a row a budget
    got = tests.groupBy("budget").agg(
        F.max("k").alias("k"), (F.sum(F.col("attack").cast("int")) / F.max("attacks")).alias("attack_recall"),
        (F.sum(F.col("teacher_flag").cast("int")) / F.max("flags")).alias("flag_recall"),
    )
    return got


def global_rank(scores: DataFrame) -> DataFrame:
    """rank by falling score, then id: a running count over ranges of scores, so no task sorts all rows."""
    return ordered.running_total(scores.withColumn("__down", -F.col("score")), F.lit(1), ["__down", "doc_id"], name="rank").drop("__down")


def threshold_sweep(scores: DataFrame, grid: list[float]) -> DataFrame:
    """Per threshold: alerts, confirmed, precision, recall, F1 and alerts for a thousand rows."""
    per = scores.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("attack").cast("int")).alias("p"))
    cuts = scores.sparkSession.createDataFrame([(g,) for g in grid], "threshold double")
    total = per.agg(F.sum("n").alias("rows"), F.sum("p").alias("positives"))
    hit = per.crossJoin(F.broadcast(cuts)).groupBy("threshold").agg(
        F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("alerts"),
        F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("p")).otherwise(0)).alias("confirmed"),
    )
    out = hit.crossJoin(F.broadcast(total))  # a row a threshold, and one row
    precision, recall = F.when(F.col("alerts") > 0, F.col("confirmed") / F.col("alerts")).otherwise(0.0), F.col("confirmed") / F.col("positives")
    out = out.withColumns({"precision": precision, "recall": recall})
    return out.withColumns({
        "f1": F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
        "per_thousand": 1000.0 * F.col("alerts") / F.col("rows"),
    }).drop("rows", "positives")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X >= k) for X binomial(n, p), summed by recurrence in logs."""
    logc = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda a, j: F.when(j <= i, a + F.log((n - i + j) / j)).otherwise(a))
    term = lambda i: F.exp(logc(i) + i * math.log(p) + (n - i) * math.log(1 - p))
    return F.when(k <= 0, 1.0).otherwise(F.aggregate(F.sequence(k, n), F.lit(0.0), lambda a, i: a + term(i)))


def sign_test(pairs: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """One row from one row a host: wins of each, exact two-sided p, mean and median difference."""
    d = F.col(a) - F.col(b)
    s = pairs.agg(F.sum((d > 0).cast("int")).cast("int").alias("wins"), F.sum((d < 0).cast("int")).cast("int").alias("losses"), F.avg(d).alias("mean_diff"), F.median(d).alias("median_diff"))
    n = F.col("wins") + F.col("losses")
    return s.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, F.greatest("wins", "losses"), 0.5))))


def boot_auc(scores: DataFrame, *, reps: int = 100, seed: int = 7) -> DataFrame:
    """One row: 2.5 % and 97.5 % quantiles of the AUC over Poisson resamples, drawn from hashes of the id."""
    u = hash_unit("doc_id", F.col("rep"), seed=seed)
    cdf, total, term = [], 0.0, math.exp(-1)
    for k in range(7):
        total += term
        cdf.append(total)
        term /= k + 1
    weight = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    drawn = scores.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", weight).where("w > 0")
    return roc_auc(drawn, ["rep"], weight="w").agg(F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.avg("auc").alias("mean"))


def ci_report(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, deviations and the half width of the 95 % interval of a value over runs."""
    g = runs.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std"))
    t = F.coalesce(F.get(F.array(*map(F.lit, T_975)), (F.col("n") - 2).cast("int")), F.lit(1.96))
    return g.withColumn("half_width", F.when(F.col("n") > 1, t * F.col("std") / F.sqrt(F.col("n"))))


def classification_report(rows: DataFrame, *, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Per class: support, precision, recall, F1, false positive rate; from the confusion counts."""
    m = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    t = m.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    p = m.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("called"))
    total = m.agg(F.sum("n").alias("rows"))  # one row
    out = t.join(p, "class", "full").na.fill(0).crossJoin(F.broadcast(total))
    c = F.col
    out = out.withColumns({
        "precision": F.when(c("called") > 0, c("hits") / c("called")).otherwise(0.0), "recall": F.when(c("support") > 0, c("hits") / c("support")).otherwise(0.0),
        "fpr": F.when(c("rows") > c("support"), (c("called") - c("hits")) / (c("rows") - c("support"))).otherwise(0.0),
    })
    return out.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0)).drop("rows", "called")


def drift_report(a: DataFrame, b: DataFrame, features: list[str], *, least: float = 0.1) -> DataFrame:
    """Per feature: means, deviations and the two-sample KS distance of a and b, from counts at each distinct value.

    Values are dealt by range; a part's running counts are its own, and only its two widest gaps and its totals go on, so
    no task takes all values of a feature. A side without values has no distance.
    """
    long = lambda df, side: df.select(F.lit(side).alias("side"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    both = long(a, 0).unionByName(long(b, 1)).where("x is not null")
    n0, n1 = F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)
    of = lambda side: F.when(F.col("side") == side, F.col("x"))
    m = both.groupBy("feature").agg(
        F.avg(of(0)).alias("mean_a"), F.avg(of(1)).alias("mean_b"), F.stddev_pop(of(0)).alias("std_a"), F.stddev_pop(of(1)).alias("std_b"), n0.alias("all0"), n1.alias("all1"),
    )
    share = lambda n, side: n / F.nullif(F.col(f"all{side}"), F.lit(0))
    per = both.groupBy("feature", "x").agg(n0.alias("n0"), n1.alias("n1")).repartitionByRange("feature", "x").withColumn("part", F.spark_partition_id())
    run = Window.partitionBy("feature", "part").orderBy("x")
    upto = per.select("feature", "part", "n0", "n1", F.sum("n0").over(run).alias("c0"), F.sum("n1").over(run).alias("c1")).join(F.broadcast(m), "feature")  # one row a feature
    own = share(F.col("c0"), 0) - share(F.col("c1"), 1)
    ends = [pick(f"c{i}", own).alias(f"{name}{i}") for name, pick in (("most", F.max_by), ("least", F.min_by)) for i in (0, 1)]
    parts = upto.groupBy(*m.columns, "part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *ends)
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    ahead = [F.coalesce(F.sum(f"n{i}").over(before), F.lit(0)).alias(f"ahead{i}") for i in (0, 1)]
    gap = lambda name: F.abs(share(F.col("ahead0") + F.col(f"{name}0"), 0) - share(F.col("ahead1") + F.col(f"{name}1"), 1))
    ks = parts.select("*", *ahead).groupBy(*m.columns).agg(F.max(F.greatest(gap("most"), gap("least"))).alias("ks"))
    return ks.drop("all0", "all1").withColumn("shifted", F.col("ks") > least)


def threshold_transfer(a: DataFrame, b: DataFrame, *, q: float = 0.99) -> DataFrame:
    """One row: a's quantile as a threshold, and the share of rows over it in a and in b."""
    cut = ordered.quantiles(a, "score", {"threshold": q})
    rate = lambda df, name: df.crossJoin(F.broadcast(cut)).agg(F.avg((F.col("score") > F.col("threshold")).cast("int")).alias(name))
    return cut.crossJoin(rate(a, "rate_a")).crossJoin(rate(b, "rate_b"))  # one row each


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of the average ranks of two columns; ranks come from counts by value."""
    out = rows
    for c in (x, y):
        per = rows.groupBy(c).agg(F.count("*").alias("__n"))
        per = ordered.running_total(per, F.col("__n"), [c], name="__upto")
        out = out.join(per.select(F.col(c), (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2.0).alias(f"__rank_{c}")), c)
    return out.agg(correlation(f"__rank_{x}", f"__rank_{y}").alias("spearman"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; no number where one of the two is the same in all rows, where corr() divides by zero."""
    return F.coalesce(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)), F.lit(math.nan))


def joint_corr(windows: DataFrame, category: str) -> DataFrame:
    """Per host, over all its hours from first to last: the correlation of a category's presence with other traffic."""
    per = windows.groupBy("host", "lhour").agg(F.max((F.col("cat") == category).cast("int")).alias("own"), F.max((F.col("cat") != category).cast("int")).alias("rest"))
    spine = per.groupBy("host").agg(F.min("lhour").alias("lo"), F.max("lhour").alias("hi")).select("host", F.explode(F.sequence("lo", "hi")).alias("lhour"))
    return spine.join(per, ["host", "lhour"], "left").fillna(0, ["own", "rest"]).groupBy("host").agg(correlation("own", "rest").alias("corr"), F.count("*").alias("hours"))


def heldout_report(scores: DataFrame, *, cut: float) -> DataFrame:
    """False alarms by hour of day and by host, and in all."""
    quiet = scores.where(~F.col("attack")).withColumn("alarm", (F.col("score") > cut).cast("int"))
    return quiet.groupingSets([["hour"], ["host"], []], "hour", "host").agg(F.count("*").alias("n"), F.sum("alarm").alias("alarms"), F.avg("alarm").alias("rate"))


def beacon_sensitivity(scores: DataFrame, thresholds: list[float], *, hours: float) -> DataFrame:
    """Per threshold: pairs that reach it, and how many in a day."""
    grid = scores.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    best = scores.groupBy("src", "dst").agg(F.max("score").alias("score"))
    hit = best.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("pairs"))  # a row a threshold
    return hit.withColumn("per_day", F.col("pairs") * 24.0 / hours)

"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: its target share, leaning early or late by a
slope. Its integral is the source's cumulative token demand; inverting that gives the time at which each token of
the source is needed. Documents line up in a hashed order, again from the front once the source is used up, and
each takes the position of its first word's time. The result is range-sorted by position. Cumulative sizes are
found in two levels (hash buckets within a source), so one source may hold any share of the rows.

Defined cases: null and wordless texts have size 0 and take nothing; null is a source of its own, after the others;
ties in the order go by id, then size; rows of one id are rows of their own; very long texts are counted and cut whole;
a corpus without words takes nothing; an empty table gives an empty result; other columns are carried through mix()
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2
#: Leaning of the schedules, repeating by the source's rank: weight(t) = 1 + slope * (2 t - 1).
SLOPES = (-0.5, 0.0, 0.5)
#: Hexadecimal digits of the hash that name a bucket of a source: 4,096 buckets a source.
DIGITS = 3


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_CLASS)), F.lit(0)).cast("long")


def _repeating(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size), one row a source.

    Targets are weight shares of ``share`` times all words, up to ``most`` times the source's size; what is over is
    shared again by weight among the others. Sources that reach their limit are those with the smallest limit per
    weight, so the level at which sharing stops is found from running sums in that order.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    given = ranked.withColumn("weight", _repeating(weights, F.col("rank"))).withColumn("limit", F.col("source_size") * float(most))
    given = given.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    whole = Window.partitionBy()
    level = (
        given.withColumn("wanted", F.sum("source_size").over(whole) * float(share))
        .withColumn("full", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("free"))
        # the first source, in that order, that the level leaves below its limit fixes the level
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole))
    )
    target = F.when(F.col("found").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("found.level")))
    return level.select("source", "rank", "source_size", target.alias("target"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """Per row: size, source_size, target, taken, and the positions of its first and second taking (null if none).

    ``keep`` names columns to carry along. A position is the number of words, over all sources, that training has
    used by the time the document is due, rounded down.
    """
    keep = keep or []
    inner = [f"__k{i}" for i in range(len(keep))]
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))  # never null, in the same order
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), word_count(text_col).alias("size"), *[F.col(k).alias(i) for k, i in zip(keep, inner, strict=True)])
    if not keep:
        rows = saved(rows, "sizes")  # small, and spares counting the words twice
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.conv(F.substring("h", 1, DIGITS), 16, 10).cast("int"))
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    total = Window.partitionBy()
    targets = targets.withColumn("slope", _repeating(slopes, F.col("rank"))).withColumn("all_words", F.sum("target").over(total)).withColumn("lean", F.sum(F.col("target") * F.col("slope")).over(total))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    buckets = by_bucket.withColumn("ahead", before).drop("bucket_size").join(targets.drop("rank"), "source")
    place = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("within", place).join(buckets, ["source", "bucket"])
    start = F.col("ahead") + F.col("within")
    quota = F.round("target").cast("long")
    took = [F.greatest(F.lit(0), F.least(F.col("size"), quota - start - F.col("source_size") * e)) for e in range(MOST_EPOCHS)]

    def position(epoch: int) -> Column:
        share = (start + F.col("source_size") * epoch) / F.col("target")  # of the source's demand, when this is due
        a, b = F.col("slope"), 1 - F.col("slope")  # the demand by time t is a t^2 + b t
        t = F.when(a == 0, share).otherwise((F.sqrt(b * b + 4 * a * share) - b) / (2 * a))
        used = F.col("all_words") * t + F.col("lean") * (t * t - t)
        return F.when(took[epoch] > 0, F.floor(used + 0.001))

    return placed.select(
        "doc_id", "size", "source_size", "target", (took[0] + took[1]).cast("long").alias("taken"), position(0).alias("position"), position(1).alias("position_again"),
        took[0].cast("long").alias("took"), took[1].cast("long").alias("took_again"), *[F.col(i).alias(k) for k, i in zip(keep, inner, strict=True)],
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """plan() range-sorted by first position; documents that are not taken come last."""
    return plan(docs, **options).repartitionByRange(F.asc_nulls_last("position"), F.asc("doc_id")).sortWithinPartitions(F.asc_nulls_last("position"), "doc_id")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus in training order: a row of docs for each taking, cut after the words taken; all columns stay.

    n_chars, if there, follows the text.
    """
    names = docs.columns
    found = plan(docs.withColumn("__row", F.struct(*names)), id_col=id_col, text_col=text_col, source_col=source_col, keep=["__row"])
    takes = F.array(F.struct(F.col("took").alias("n"), F.col("position").alias("at")), F.struct(F.col("took_again").alias("n"), F.col("position_again").alias("at")))
    rows = found.select("__row", "size", F.explode(takes).alias("take")).where("take.n > 0")
    text = F.col(f"__row.{text_col}")
    cut = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("take.n").cast("int")), " ")
    taken = F.when(F.col("take.n") < F.col("size"), cut).otherwise(text)
    out = {n: F.col(f"__row.{n}") for n in names} | {text_col: taken}
    if "n_chars" in names:
        out["n_chars"] = F.length(taken).cast(docs.schema["n_chars"].dataType)
    ready = rows.select(F.col("take.at").alias("__at"), *[c.alias(n) for n, c in out.items()])
    return ready.repartitionByRange("__at", id_col).sortWithinPartitions("__at", id_col).drop("__at")

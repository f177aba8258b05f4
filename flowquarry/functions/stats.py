"""Column functions on arrays of numbers, and ordered folds of an entity's history."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECTRUM = ["score", "frequency", "harmonic_ratio", "entropy", "prominence"]


def clamp01(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return let(mean(values), lambda m: F.sqrt(mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def median(values: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)

    return let(F.sort_array(values), of)


def mad_ratio(values: Column) -> Column:
    """Median absolute deviation over the median; 1 where the median is not positive."""
    return let(median(values), lambda m: F.when((F.size(values) == 0) | (m <= 0), 1.0).otherwise(median(F.transform(values, lambda x: F.abs(x - m))) / m))


def iat_cv(values: Column) -> Column:
    return let(mean(values), lambda m: F.when(m > 0, deviation(values) / m).otherwise(0.0))


def jitter(values: Column) -> Column:
    """Mean absolute deviation from the mean."""
    return let(mean(values), lambda m: F.coalesce(mean(F.transform(values, lambda x: F.abs(x - m))), F.lit(0.0)))


def shannon_bits(counts: Column) -> Column:
    def of(positive: Column) -> Column:
        return let(total(positive), lambda n: F.when(F.size(positive) == 0, 0.0).otherwise(total(F.transform(positive, lambda c: -(c / n) * F.log2(c / n)))))

    return let(F.transform(F.filter(counts, lambda c: c > 0), lambda c: c.cast("double")), of)


def frequencies(values: Column) -> Column:
    """Struct of an array of strings or numbers: how many kinds, the commonest one's count, and the entropy in bits.

    One pass over the sorted array, so it stays cheap for long windows.
    """
    text = F.sort_array(F.transform(values, lambda x: x.cast("string")))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("kinds"), F.lit(0).alias("most"), F.lit(0.0).alias("s"))
    weight = lambda run: F.when(run > 0, run * F.log2(run.cast("double"))).otherwise(0.0)

    def step(a: Column, x: Column) -> Column:
        same = a["last"].eqNullSafe(x) & (a["run"] > 0)
        return F.struct(
            x.alias("last"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), F.when(same, a["kinds"]).otherwise(a["kinds"] + 1).alias("kinds"),
            F.when(same, a["most"]).otherwise(F.greatest(a["most"], a["run"])).alias("most"), F.when(same, a["s"]).otherwise(a["s"] + weight(a["run"])).alias("s"),
        )

    def done(a: Column) -> Column:
        n = F.size(values)
        bits = F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n.cast("double")) - (a["s"] + weight(a["run"])) / n)).otherwise(0.0)
        return F.struct(a["kinds"].alias("kinds"), F.greatest(a["most"], a["run"]).alias("most"), bits.alias("bits"))

    return F.aggregate(text, zero, step, done)


def _ks(values: Column, cdf: Callable[[Column], Column]) -> Column:
    n = F.size(values)
    return F.array_max(F.transform(F.sort_array(values), lambda x, i: F.greatest((i + 1) / n - cdf(x), cdf(x) - i / n)))


def ks_uniform(values: Column) -> Column:
    """Distance of the values' distribution from the uniform one over their range."""
    ends = F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"))
    return let(ends, lambda e: F.when((F.size(values) == 0) | (e["hi"] <= e["lo"]), 1.0).otherwise(_ks(values, lambda x: (x - e["lo"]) / (e["hi"] - e["lo"]))))


def ks_exponential(values: Column) -> Column:
    """Distance of the values' distribution from the exponential one of their mean."""
    return let(mean(values), lambda m: F.when((F.size(values) == 0) | (m <= 0), 1.0).otherwise(_ks(values, lambda x: 1 - F.exp(-x / m))))


def differences(times: Column) -> Column:
    """Gaps between an array's successive values."""
    n = F.size(times)
    return F.when(n > 1, F.transform(F.slice(times, 2, F.greatest(n - 1, F.lit(1))), lambda x, i: x - F.get(times, i))).otherwise(F.array().cast("array<double>"))


def softmax(values: Column) -> Column:
    powers = let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(total(p), lambda n: F.transform(p, lambda x: x / n)))


def anomaly_confidence(mse: Column, threshold: float = 0.7) -> Column:
    return F.when(mse > threshold, 1 - F.exp(-(mse - threshold) / threshold)).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def fft_prominence(values: pd.Series) -> pd.Series:
    """How far the strongest line of the spectrum stands over its median, in its standard deviations."""

    def one(x) -> float:
        power = np.abs(np.fft.rfft(np.asarray(x, float)))[1:] if x is not None and len(x) > 1 else np.zeros(0)
        return float((power.max() - np.median(power)) / (power.std() + 1e-9)) if len(power) else 0.0

    return values.map(one)


@F.pandas_udf(T.DoubleType())
def fft_prominence_capped(values: pd.Series) -> pd.Series:
    """The strongest line over the mean one, by length, of the centred first 128 values; at most 1."""

    def one(x) -> float:
        x = np.asarray(x if x is not None else [], float)[:128]
        if len(x) < 4:
            return 0.0
        power = np.abs(np.fft.rfft(x - x.mean()))[1:]
        return float(min(1.0, power.max() / power.mean() / len(x))) if len(power) and power.mean() > 0 else 0.0

    return values.map(one)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SPECTRUM]))
def fft_features(values: pd.Series) -> pd.DataFrame:
    """Five features of the spectrum of the centred values."""

    def one(x) -> tuple:
        x = np.asarray(x if x is not None else [], float)
        if len(x) < 4:
            return 0.0, 0.0, 0.0, 1.0, 0.0
        power = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
        whole = power.sum()
        if whole <= 0:
            return 1.0, 0.0, 1.0, 0.0, 0.0
        at = int(power.argmax())
        share = power / whole
        harmonics = power[2 * at + 1 :: at + 1].sum() if at + 1 < len(power) else 0.0
        bits = -(share[share > 0] * np.log2(share[share > 0])).sum() / np.log2(max(2, len(share)))
        return float(share[at]), float((at + 1) / len(x)), float((power[at] + harmonics) / whole), float(bits), float(power[at] / (np.median(power) + 1e-9))

    return pd.DataFrame([one(x) for x in values], columns=SPECTRUM)


def acf_peak(times: Column, bin_seconds: float = 5.0, low: float = 10.0, high: float = 900.0) -> Column:
    """The largest autocorrelation of the binned times over lags from low to high seconds."""
    lags = F.sequence(F.lit(int(low // bin_seconds)), F.lit(int(high // bin_seconds)))
    bins = let(F.array_min(times), lambda lo: F.array_distinct(F.transform(times, lambda t: F.floor((t - lo) / bin_seconds).cast("int"))))
    best = let(bins, lambda own: F.array_max(F.transform(lags, lambda k: F.size(F.array_intersect(own, F.transform(own, lambda b: b + k))) / F.size(own))))
    return F.when(F.size(times) < 3, 0.0).otherwise(best)


def histories(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str = "history") -> DataFrame:
    """One row a key with its rows as an array of structs in order: bounded by an entity's history in the window."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias(name))


def trailing(*keys: str, seconds: float, ts: str = "ts") -> WindowSpec:
    """The rows of the same keys in the seconds up to each row, both edges included."""
    w = Window.partitionBy(*keys)
    if float(seconds).is_integer():
        return w.orderBy(ts).rangeBetween(-int(seconds), 0)
    return w.orderBy(F.col(ts) * 1000).rangeBetween(-int(seconds * 1000), 0)

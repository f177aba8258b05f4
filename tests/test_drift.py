"""Drift of features against numpy, with a feature's values in many parts."""

import re

import numpy as np
import pytest

from flowquarry.operators import evaluate as ev


def ks(a, b):
    x = np.union1d(a, b)
    return np.abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)).max()


def test_a_feature_is_many_parts(spark):
    rng = np.random.default_rng(11)
    sides = [{"u": rng.normal(0, 1, 900), "v": rng.integers(0, 6, 900).astype(float)}, {"u": rng.normal(0.3, 1, 700), "v": rng.integers(1, 9, 700).astype(float)}]
    a, b = (spark.createDataFrame(list(zip(s["u"].tolist(), s["v"].tolist())), "u double, v double") for s in sides)
    report = ev.drift_report(a, b, ["u", "v"])
    runs = re.findall(r"windowspecdefinition\((.*?) ASC", report._jdf.queryExecution().optimizedPlan().toString())
    over_values = [r for r in runs if re.search(r"\bx#", r)]
    assert over_values and all("part#" in r for r in over_values)  # no task runs over all values of a feature
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.feature: r for r in report.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {"u", "v"}
    for f, r in got.items():
        x, y = sides[0][f], sides[1][f]
        assert r.ks == pytest.approx(ks(x, y), abs=1e-12) and r.shifted == (ks(x, y) > 0.1)
        assert (r.mean_a, r.mean_b, r.std_a, r.std_b) == pytest.approx((x.mean(), y.mean(), x.std(), y.std()))


def test_a_side_without_values_has_no_distance(spark):
    a = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "u double, v double")
    b = spark.createDataFrame([(None, 3.0)], "u double, v double")
    got = {r.feature: (r.mean_a, r.mean_b, r.ks) for r in ev.drift_report(a, b, ["u", "v"]).collect()}
    assert got == {"u": (1.5, None, None), "v": (3.0, 3.0, 0.0)}

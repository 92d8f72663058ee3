"""Estimated lag weights: planted polynomials, nested fits against separate ones."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import linear, midas
from helpers import month

K = 20


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    days = [dt.date(2010, 1, 1) + dt.timedelta(days=i) for i in range(365 * 12)]
    x = rng.normal(size=len(days))
    return days, np.where(rng.random(len(days)) < 0.02, np.nan, x)


def planted(spark, data, weights, noise, cutoff=20, months=140, seed=1):
    """Daily values and a target made of the newest values up to the cut-off day of each month."""
    rng = np.random.default_rng(seed)
    days, x = data
    known = [(d, v) for d, v in zip(days, x) if not np.isnan(v)]
    target, at = [], 0
    for i in range(months):
        first = month(i, (2010, 2))
        last = first + dt.timedelta(days=cutoff - 1)
        while at < len(known) and known[at][0] <= last:
            at += 1
        recent = [v for _, v in known[max(0, at - len(weights)) : at]][::-1]
        target.append(("a", first, float(3 + np.dot(weights, recent) + rng.normal(0, noise))))
    daily = spark.createDataFrame([("a", d, None if np.isnan(v) else float(v)) for d, v in zip(days, x)], "k string, ds date, x double")
    return spark.createDataFrame(target, "k string, ds date, y double"), daily.repartition(3)


def test_recent_days_cross_month_ends(spark, data):
    target, daily = planted(spark, data, [1.0] * 3, 0.0)
    rows = {r["ds"]: r["x_recent"] for r in midas.recent_days(target, daily, ["k"], "x", 25, 20).collect()}
    known = [(d, v) for d, v in zip(*data) if not np.isnan(v)]
    for first, got in rows.items():
        want = [v for d, v in known if d <= first + dt.timedelta(days=19)][-25:][::-1]
        assert np.allclose(got, want) and len(got) == 25


@pytest.mark.parametrize("ends", [(), ("near",), ("far",), ("near", "far")])
def test_planted_weights_are_recovered(spark, data, ends):
    u = np.arange(1, K + 1) / K
    behind = (K + 1) / K
    weights = {(): 0.8 - 0.5 * u + 0.1 * u**2, ("near",): 0.9 * u - 0.6 * u**2, ("far",): 0.5 * (behind - u) + 0.3 * (behind**2 - u**2),
               ("near", "far"): 0.7 * u * (behind - u)}[ends]
    target, daily = planted(spark, data, weights, 0.0)
    row = midas.almon_fit(target, daily, ["k"], "y", "x", K, 2, ends, 20).first()
    assert row["status"] == "ok" and np.allclose(row["weights"], weights, atol=1e-6) and np.isclose(row["intercept"], 3)
    theta = np.array(row["theta"])
    if "near" in ends:
        assert theta[0] == 0
    if "far" in ends:
        assert abs(sum(t * behind**p for p, t in enumerate(theta))) < 1e-9
    noisy, daily = planted(spark, data, weights, 0.3)
    row = midas.almon_fit(noisy, daily, ["k"], "y", "x", K, 2, ends, 20).first()
    assert np.abs(np.array(row["weights"]) - weights).max() < 0.15


def test_nested_fits_equal_separate_ones(spark, data):
    target, daily = planted(spark, data, [0.9, 0.6, 0.4], 0.5)
    few = target.limit(5).withColumn("s", F.lit("few"))
    target, daily = target.withColumn("s", F.lit("a")).unionByName(few).drop("k"), daily.withColumn("s", F.lit("a")).drop("k")
    out = midas.umidas_orders(target, daily, ["s"], "y", "x", 10, 20).collect()
    assert {r["s"] for r in out} == {"a"} and [r["k"] for r in sorted(out, key=lambda r: r["k"])] == list(range(11))
    rows = midas.umidas_lags(midas.recent_days(target.filter("s = 'a'"), daily, ["s"], "x", 10, 20), "x", 10)
    for r in out:
        k = r["k"]
        if k == 0:
            continue
        one = linear.fit_linear(rows, ["s"], "y", [f"x_d{j}" for j in range(1, k + 1)], 0.0, 0.0).first()
        # The separate fit needs only its own k values; both have the same rows here.
        assert one["n"] == r["n"]
        assert np.allclose(r["coef"], one["coef"]) and np.isclose(r["sigma"], one["sigma"]) and np.isclose(r["intercept"], one["intercept"])
        assert np.isclose(r["bic"], r["n"] * np.log(one["sigma"] ** 2) + (k + 1) * np.log(r["n"]))
    best = [r["k"] for r in out if r["is_best"]]
    assert best == [min(out, key=lambda r: r["bic"])["k"]] and best == [3]


def test_wrong_ends(spark, data):
    target, daily = planted(spark, data, [1.0], 0.0)
    with pytest.raises(ValueError):
        midas.almon_fit(target, daily, ["k"], "y", "x", K, 2, ("left",))
    with pytest.raises(ValueError):
        midas.almon_fit(target, daily, ["k"], "y", "x", K, 1, ("near", "far"))

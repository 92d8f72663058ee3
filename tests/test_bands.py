"""Bands that widen: weights against loops, coverage on simulated series."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions.spec import FeatureSpec
from panelcast.operators import bands, forecast, linear, structural
from helpers import month, pandas_of, panel, series


def test_weights_equal_a_simulated_shock(spark):
    coefs = {1: 0.5, 3: -0.2, 12: 0.3}
    row = spark.range(1).select(bands.shock_weights([(k, F.lit(c)) for k, c in coefs.items()], 20).alias("w")).first()
    path = [1.0]
    for j in range(1, 20):
        path.append(sum(c * path[j - k] for k, c in coefs.items() if j >= k))
    assert np.allclose(row["w"], path)
    grown = spark.range(1, 21).select(bands.growing_deviation(F.lit(path), F.col("id").cast("int")).alias("d")).collect()
    assert np.allclose([r["d"] for r in grown], np.sqrt(np.cumsum(np.square(path))))


def test_trailing_means_are_lags():
    specs = [FeatureSpec("y_lag1", "target_lag", "y", 1), FeatureSpec("m", "season"), FeatureSpec("r3", "target_rolling", "y", 3)]
    assert [k for k, _ in bands.lag_coefficients(specs)] == [1, 2, 3]


def simulated(spark, coefs, number, length, horizon, seed):
    """Series of an autoregression and their next values."""
    rng = np.random.default_rng(seed)
    rows, ahead = [], {}
    for s in range(number):
        y = list(rng.normal(size=13))
        for _ in range(100 + length + horizon):
            y.append(1.0 + sum(c * y[-k] for k, c in coefs.items()) + rng.normal())
        y = y[-length - horizon :]
        rows += [(f"s{s}", month(i, (1990, 1)), float(v)) for i, v in enumerate(y[:length])]
        ahead[f"s{s}"] = y[length:]
    return panel(spark, rows), ahead


def coverage(out, ahead, level_of=None):
    hit = np.array([
        [lo <= v <= hi for lo, hi, v in zip(block["lower"], block["upper"], ahead[k])] for k, block in pandas_of(out).groupby("k")
    ])
    return hit.mean(), hit.mean(0)


def test_ar1_bands_cover(spark):
    df, ahead = simulated(spark, {1: 0.8}, 500, 240, 12, 1)
    model = linear.ar1_fit(df, ["k"], spread=True)
    paths = forecast.recursive_forecast_ar1(model, df, ["k"])
    whole, by_step = coverage(bands.ar1_band(paths, model, ["k"]), ahead)
    assert abs(whole - 0.95) < 0.03 and (np.abs(by_step - 0.95) < 0.045).all()
    flat, _ = coverage(paths.join(model, "k").withColumns({"lower": F.col("yhat") - 1.96 * F.col("sigma"), "upper": F.col("yhat") + 1.96 * F.col("sigma")}), ahead)
    assert flat < 0.88  # the band of one step does not do
    direct, _ = coverage(forecast.direct_forecast_ar1(df, ["k"], level=0.95), ahead)
    assert abs(direct - 0.95) < 0.03


def test_linear_bands_cover(spark):
    df, ahead = simulated(spark, {1: 0.5, 3: 0.3}, 500, 240, 12, 2)
    from panelcast.operators.windows import lags

    specs = [FeatureSpec(f"y_lag{k}", "target_lag", "y", k) for k in (1, 2, 3)]
    rows = lags(df, ["k"], "y", (1, 2, 3))
    model = linear.fit_linear(rows, ["k"], "y", [s.name for s in specs], 0.0, 0.0)
    paths = forecast.recursive_forecast_linear(model, rows, ["k"], specs)
    whole, by_step = coverage(bands.linear_band(paths, model, ["k"], specs), ahead)
    assert abs(whole - 0.95) < 0.03 and (np.abs(by_step - 0.95) < 0.045).all()


def test_slope_changes_in_closed_form(spark):
    rng = np.random.default_rng(4)
    rate, size, h = 0.2, 0.7, 12
    changes = (rng.random((200_000, h)) < rate) * rng.normal(0, size, (200_000, h))
    moved = (changes * np.arange(h, 0, -1)).sum(1)
    got = spark.range(1).select(bands.slope_change_variance(F.lit(rate), F.lit(size * size), F.lit(h)).alias("v")).first()["v"]
    assert np.isclose(got, rate * size**2 * (np.arange(1, h + 1) ** 2).sum()) and np.isclose(moved.var(), got, rtol=0.02)
    assert (np.abs(moved) <= 1.96 * np.sqrt(got)).mean() == pytest.approx(0.95, abs=0.03)


def test_piecewise_band_grows_with_bends(spark):
    t = np.arange(96)
    straight = series(spark, (100 + t + np.random.default_rng(1).normal(0, 1, 96)).tolist(), "a")
    bent = series(spark, (100 + 8 * np.abs((t % 24) - 12) + np.random.default_rng(1).normal(0, 1, 96)).tolist(), "b")
    model = structural.piecewise_fit(straight.unionByName(bent), ["k"], knot_penalty=0.01)
    wide = pandas_of(structural.piecewise_predict(model, ["k"], widen=True)).set_index(["k", "ds"])
    flat = pandas_of(structural.piecewise_predict(model, ["k"])).set_index(["k", "ds"])
    assert np.allclose(wide["yhat"], flat["yhat"])
    spread = (wide["upper"] - wide["lower"]).where(wide["is_future"])
    base = flat["upper"] - flat["lower"]
    assert np.allclose((wide["upper"] - wide["lower"])[~wide["is_future"]], base[~wide["is_future"]])
    for k in "ab":
        growth = spread[k].dropna().to_numpy() / base[k].iloc[0]
        assert (np.diff(growth) > 0).all() and growth[0] > 1
    last = spread.groupby("k").last() / base.groupby("k").last()
    assert last["b"] > 1.5 * last["a"]


def test_short_series_have_no_band(spark):
    df = series(spark, [1.0, 2.0])
    model = linear.ar1_fit(df, ["k"], spread=True)
    assert model.first()["sigma"] is None
    out = bands.ar1_band(forecast.recursive_forecast_ar1(model, df, ["k"]), model, ["k"])
    assert out.filter("lower is not null").count() == 0
    with pytest.raises(ValueError):
        bands.ar1_band(df.withColumnRenamed("y", "yhat"), model, ["k"], level=0.5)

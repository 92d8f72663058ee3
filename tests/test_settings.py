"""What users set: month dummies, scenario names, the baseline's penalty; ensembles small enough to know."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.config import BoostConfig, FeatureConfig, ForecastConfig, NowcastConfig
from panelcast.functions import dates
from panelcast.functions.spec import names
from panelcast.operators import boosted, forecast, linear, windows
from panelcast.plans import nowcast as nowcast_plan
from panelcast.plans.forecast import run_forecast
from helpers import month, noisy_panel, pandas_of, panel, series


def dummy_specs():
    specs = windows.ar_feature_specs("y", ["x1"], ks=(1, 2), windows=(3,), seasonal="categorical")
    return [s for s in specs if s.name not in ("quarter", "day_of_year", "month")]


def test_month_dummies_in_the_design(spark):
    df = noisy_panel(spark, keys=("a",))
    out = windows.ar_features(df, ["k"], "y", ["x1"], ks=(1, 2), windows=(3,), seasonal="categorical")
    assert [c for c in out.columns if c.startswith("month_")] == [f"month_{m}" for m in range(1, 13)]
    assert not {"month_sin", "quarter_cos"} & set(out.columns)
    got = pandas_of(out)
    assert all(r[f"month_{r['ds'].month}"] == 1 and sum(r[f"month_{m}"] for m in range(1, 13)) == 1 for _, r in got.iterrows())
    assert {s.name for s in dummy_specs()} <= set(out.columns)
    assert windows.ar_features(df, ["k"], "y", ["x1"], ks=(1,), windows=(3,), seasonal="cyclical").columns == windows.ar_features(
        df, ["k"], "y", ["x1"], ks=(1,), windows=(3,), seasonal=True
    ).columns
    with pytest.raises(ValueError):
        dates.season_form("weekly", "ds")


def features_of(specs, y, date, last):
    out = {}
    for s in specs:
        if s.kind == "target_lag":
            out[s.name] = y[-s.k]
        elif s.kind == "season":
            out[s.name] = float(date.month == int(s.name.split("_")[1]))
        else:
            out[s.name] = last[s.name]
    return out


def test_recursions_follow_the_dummies(spark):
    df, specs = noisy_panel(spark, keys=("a",)), dummy_specs()
    rows = windows.ar_features(df, ["k"], "y", ["x1"], ks=(1, 2), windows=(3,), seasonal="categorical").cache()
    model = linear.fit_linear(rows, ["k"], "y", names(specs), 0.05, 0.0)
    got = pandas_of(forecast.recursive_forecast_linear(model, rows, ["k"], specs, horizon=14))["yhat"].tolist()
    fit, hist = model.first(), pandas_of(rows)
    y, last = hist["y"].tolist(), hist.iloc[-1]
    for i in range(14):
        f = features_of(specs, y, month(72 + i), last)
        y.append(fit["intercept"] + sum(c * f[s.name] for c, s in zip(fit["coef"], specs)))
    assert np.allclose(got, y[-14:])
    trees = boosted.boosted_fit(rows, ["k"], "y", names(specs), BoostConfig(max_depth=3, n_estimators=4, learning_rate=0.4))
    got = pandas_of(boosted.recursive_forecast_boosted(trees, rows, specs, "y", 3))["yhat"].tolist()
    y = hist["y"].tolist()
    for i in range(3):
        f = features_of(specs, y, month(72 + i), last)
        step = spark.createDataFrame([("a", *map(float, f.values()))], "k string, " + ", ".join(f"{x} double" for x in f))
        y.append(trees.predict(step).first()["yhat"])
    assert np.allclose(got, y[-3:])


def test_own_scenarios_and_dummies_in_the_job(spark):
    config = ForecastConfig(
        scenarios={"crash": -3.0, "as is": 0.0}, features=FeatureConfig(lags=(1, 12), rolling=(3,), seasonal="categorical"),
        test_size=6,
    )
    result = run_forecast(
        noisy_panel(spark), ["k"], ["x1", "x2"], config=config, boost=BoostConfig(max_depth=2, n_estimators=2)
    )
    assert "month_7" in result.features.columns
    for r in result.summary.collect():
        assert r["final_crash"] == pytest.approx(0.94 * r["final_as is"]) and r["final_as is"] is not None
    assert not [c for c in result.summary.columns if c in ("final_base", "final_otimista")]


def test_the_baseline_penalty_is_used(spark):
    df = noisy_panel(spark)
    rows = windows.lags(df, ["k"], "y", (1, 2))
    specs = [s for s in windows.ar_feature_specs("y", ["x1"], ks=(1, 2), windows=(), seasonal=False)]
    out = {}
    for alpha in (0.001, 50.0):
        back = nowcast_plan.nowcast_backtest(
            rows, ["k"], specs, config=NowcastConfig(baseline_alpha=alpha, test_size=6), boost=BoostConfig(max_depth=1, n_estimators=1)
        )
        out[alpha] = pandas_of(back.predictions.filter("model = 'lags_ridge'"))["yhat"]
    train = windows.impute_edges(windows.holdout_split(rows, ["k"], 6), ["k"], names(specs))
    want = linear.bridge_predict(
        linear.ar_baseline_fit(train.filter("split = 'train'"), ["k"], "y", ["y_lag1", "y_lag2"], 50.0),
        train.filter("split = 'test'"), ["k"], ["y_lag1", "y_lag2"],
    )
    assert np.allclose(out[50.0], pandas_of(want)["yhat"]) and not np.allclose(out[0.001], out[50.0])


@pytest.fixture(scope="module")
def known_trees(spark):
    """One tree of depth two whose splits can be read off the data: first on x1, then, right of it, on x2."""
    rows = [("a", month(i), 10.0 + 8 * (i >= 20) + 2 * (i >= 20 and i % 2), float(i), float(i % 2), 1.0) for i in range(40)]
    df = panel(spark, rows, "k string, ds date, y double, x1 double, x2 double, x3 double")
    config = BoostConfig(max_depth=2, n_estimators=1, learning_rate=1.0, subsample=1.0, colsample=1.0)
    return boosted.boosted_fit(df, ["k"], "y", ["x1", "x2", "x3"], config), df


def test_counts_and_gains_of_a_known_ensemble(spark, known_trees):
    model, df = known_trees
    counts = {r["feature"]: r["importance"] for r in boosted.split_counts(model).collect()}
    assert counts == {"x1": 1, "x2": 1, "x3": 0}
    gain = {r["feature"]: r["importance"] for r in boosted.gain_importance(model).collect()}
    # Variance that each split takes away, times its rows: 40 * (81 / 4 ... ) by hand from the means 10, 19 and 18, 20.
    first, second = 20 * 20 / 40 * (19.0 - 10.0) ** 2, 10 * 10 / 20 * (20.0 - 18.0) ** 2
    assert gain["x3"] == 0 and np.isclose(gain["x1"], first / (first + second)) and np.isclose(gain["x2"], second / (first + second))


def test_predictions_of_a_known_ensemble(spark, known_trees):
    model, df = known_trees
    out = pandas_of(model.predict(df))
    assert np.allclose(out["yhat"], out["y"]) and np.allclose(out["sigma"], 0, atol=1e-9)
    new = panel(spark, [("a", month(0), 0.0, 3.0, 1.0, 5.0), ("a", month(1), 0.0, 99.0, 1.0, 5.0), ("a", month(2), 0.0, 99.0, 0.0, 5.0)],
                "k string, ds date, y double, x1 double, x2 double, x3 double")
    assert np.allclose(pandas_of(model.predict(new))["yhat"], [10, 20, 18])


def test_a_small_design_is_one_task(spark):
    assert boosted.ROWS_PER_TASK >= 1024
    df = series(spark, [float(i % 7) for i in range(60)]).repartition(6)
    rows = windows.lags(df, ["k"], "y", (1,))
    model = boosted.boosted_fit(rows, ["k"], "y", ["y_lag1"], BoostConfig(max_depth=2, n_estimators=2))
    assert isinstance(pandas_of(model.predict(rows)), pd.DataFrame)
    assert model.scales.filter(F.col("sigma").isNull()).count() == 0

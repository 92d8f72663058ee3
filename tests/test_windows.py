import math

import numpy as np
import pandas as pd
import pytest

from helpers import month, noisy_panel, pandas_of, panel, series
from panelcast.functions.spec import names
from panelcast.operators import windows
from panelcast.sources.calendars import gap_fill


def values(df, col):
    return [None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in pandas_of(df)[col]]


def test_lags_follow_the_calendar_after_gap_fill(spark):
    df = gap_fill(panel(spark, [("a", month(0), 1.0), ("a", month(2), 3.0), ("a", month(3), 4.0)]), ["k"])
    assert values(windows.lags(df, ["k"], "y", [1, 2]), "y_lag1") == [None, 1.0, None, 3.0]
    assert values(windows.lags(df, ["k"], "y", [2]), "y_lag2") == [None, None, 1.0, None]


def test_rolling_mean_skips_nulls_and_can_leave_out_the_current_row(spark):
    df = series(spark, [1.0, None, 5.0, 7.0])
    assert values(windows.rolling_mean(df, ["k"], ["y"], [3]), "y_rolling_mean_3m") == [1.0, 1.0, 3.0, 6.0]
    assert values(windows.rolling_mean(df, ["k"], ["y"], [2], shift=1), "y_rolling_mean_2m") == [None, 1.0, 1.0, 5.0]


def test_shock_names_and_sign(spark):
    out = windows.shock(series(spark, [5.0, 4.0, 7.0]), ["k"], "y", 1)
    assert values(out, "y_12m_change") == [None, -1.0, 3.0]
    assert values(out, "y_shock_magnitude") == [None, 1.0, 3.0]


def test_pct_change_zero_base_and_padding(spark):
    df = series(spark, [0.0, 2.0, None, 3.0])
    assert values(windows.pct_change(df, ["k"], ["y"]), "y_mom") == [None, None, 0.0, 0.5]
    assert values(windows.pct_change(df, ["k"], ["y"], fill="none"), "y_mom") == [None, None, None, None]
    with pytest.raises(ValueError):
        windows.pct_change(df, ["k"], ["y"], fill="other")


def test_impute_edges_stays_inside_the_split(spark):
    df = series(spark, [None, 2.0, None, None, 6.0, None])
    split = windows.holdout_split(df, ["k"], 3)
    assert values(windows.impute_edges(split, ["k"], ["y"]), "y") == [2.0, 2.0, 2.0, 6.0, 6.0, 6.0]
    forward = windows.impute_edges(split, ["k"], ["y"], bfill=False)
    assert values(forward, "y") == [0.0, 2.0, 2.0, 0.0, 6.0, 6.0]
    empty = windows.impute_edges(series(spark, [None, None]).withColumn("y", windows.F.col("y").cast("double")), ["k"], ["y"], split=None)
    assert values(empty, "y") == [0.0, 0.0]


def test_deflate_bases(spark):
    rows = [("a", month(i, (2019, 12)), v, p) for i, (v, p) in enumerate([(100.0, 50.0), (100.0, 100.0), (100.0, 200.0)])]
    df = panel(spark, rows, "k string, ds date, v double, p double")
    assert values(windows.deflate(df, ["k"], "v", "p"), "real") == [100.0, 50.0, 25.0]
    assert np.allclose(values(windows.deflate(df, ["k"], "v", "p", 2020), "real"), [300.0, 150.0, 75.0])
    with pytest.raises(ValueError):
        windows.deflate(df, ["k"], "v", "p", "last")


def test_chain_index_and_constant_scaling(spark):
    out = values(windows.chain_index(series(spark, [0.1, 0.1, -0.5]), ["k"], "y"), "index")
    assert np.allclose(out, [110.0, 121.0, 60.5])
    assert values(windows.minmax_scale(series(spark, [3.0, 3.0]), ["k"], "y"), "y_scaled") == [0.0, 0.0]


def test_newest_rows(spark):
    df = panel(spark, [("a", month(i), float(i)) for i in range(5)] + [("b", month(9), None)])
    latest = pandas_of(windows.latest_row(df, ["k"]))
    assert latest["ds"].tolist() == [month(4), month(9)] and math.isnan(latest["y"][1])
    assert pandas_of(windows.value_back(df, ["k"], "y", 3))["value"].tolist() == [2.0]
    assert windows.drop_warmup(df, ["k"], 3).count() == 2


def test_series_shorter_than_the_lag_vanishes(spark):
    df = series(spark, [1.0, 2.0])
    assert windows.lags(df, ["k"], "y", [12]).filter("y_lag12 is not null").count() == 0
    assert windows.drop_warmup(df, ["k"], 12).count() == 0


def test_panel_result_is_the_union_of_single_series(spark):
    df = noisy_panel(spark)
    both = pandas_of(windows.ar_features(df, ["k"], "y", ["x1", "x2"], ["x1"]))
    alone = [
        pandas_of(windows.ar_features(df.filter(f"k = '{k}'"), ["k"], "y", ["x1", "x2"], ["x1"])) for k in "ab"
    ]
    pd.testing.assert_frame_equal(both, pd.concat(alone, ignore_index=True))
    specs = windows.ar_feature_specs("y", ["x1", "x2"], ["x1"])
    assert set(names(specs)) == set(both.columns) - {"k", "ds", "y"}


def test_ar_features_match_pandas(spark):
    df = noisy_panel(spark, keys=("a",))
    got = pandas_of(windows.ar_features(df, ["k"], "y", ["x1", "x2"], ["x2"]))
    src = pandas_of(df)
    want = src[["y", "x1", "x2"]].copy()
    for k in (1, 3, 6, 12):
        want[f"y_lag{k}"] = src["y"].shift(k)
    for c in ("x1", "x2"):
        for n in (3, 6):
            want[f"{c}_rolling_mean_{n}m"] = src[c].rolling(n, min_periods=1).mean()
    want["x2_12m_change"] = src["x2"] - src["x2"].shift(12)
    want["x2_shock_magnitude"] = want["x2_12m_change"].abs()
    when = pd.to_datetime(src["ds"]).dt
    want["month_sin"], want["month_cos"] = np.sin(2 * np.pi * when.month / 12), np.cos(2 * np.pi * when.month / 12)
    want["day_of_year"] = when.dayofyear
    want = want.dropna().reset_index(drop=True)
    assert len(got) == 60
    for c in want:
        assert np.allclose(got[c], want[c]), c


def test_one_shuffle_and_one_sort_for_all_features(spark, tmp_path):
    path = str(tmp_path / "panel")
    noisy_panel(spark).write.parquet(path)
    out = windows.ar_features(spark.read.parquet(path), ["k"], "y", ["x1", "x2"], ["x1"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort [") == 1
    assert "BatchEvalPython" not in plan


def test_single_series_without_keys(spark):
    df = series(spark, [1.0, 2.0, 3.0]).drop("k")
    assert windows.lags(df, [], "y", [1]).orderBy("ds").toPandas()["y_lag1"].tolist()[1:] == [1.0, 2.0]

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from helpers import mixed_frequency, month, pandas_of, panel, series, to_spark
from panelcast.functions.spec import names, of_kind
from panelcast.operators import align, shape


def test_edges_of_the_monthly_rollup(spark):
    rows = [
        ("a", dt.date(2020, 1, 5), 10.0), ("a", dt.date(2020, 1, 31), 99.0),
        ("a", dt.date(2020, 2, 25), 1.0),
        ("a", dt.date(2020, 3, 2), 4.0), ("a", dt.date(2020, 3, 3), None), ("a", dt.date(2020, 3, 1), 2.0),
    ]
    out = pandas_of(align.daily_to_monthly(panel(spark, rows), ["k"], ["y"], 20))
    assert out["ds"].tolist() == [month(0), month(2)]
    assert math.isnan(out["y_std"][0]) and out["y_last"].tolist() == [10.0, 4.0]
    assert out["y_mean"].tolist() == [10.0, 3.0]
    late = pandas_of(align.daily_to_monthly(panel(spark, rows), ["k"], ["y"], 30))
    assert late["y_mean"][0] == 10.0
    assert pandas_of(align.daily_to_monthly(panel(spark, rows), ["k"], ["y"]))["y_last"][0] == 99.0


def test_a_week_belongs_to_the_month_of_its_sunday(spark):
    from panelcast.functions.dates import week_label
    df = spark.createDataFrame(
        [(dt.date(2024, 12, 30),), (dt.date(2025, 1, 5),), (dt.date(2025, 1, 6),)], "ds date"
    )
    got = [r[0] for r in df.select(week_label("ds")).collect()]
    assert got == [dt.date(2025, 1, 5), dt.date(2025, 1, 5), dt.date(2025, 1, 12)]


def test_alignment_needs_an_input_and_disjoint_columns(spark):
    with pytest.raises(ValueError):
        shape.join_frequencies(None, None, ["k"])
    with pytest.raises(ValueError):
        align.nowcast_features(series(spark, [1.0]), ["k"])
    with pytest.raises(ValueError):
        shape.assemble_wide([series(spark, [1.0]), series(spark, [1.0])], ["k"])


def test_indicator_only_months_stay_with_null_target(spark):
    target = series(spark, [1.0, 2.0])
    hf = panel(spark, [("a", month(1), 5.0), ("a", month(2), 6.0)], "k string, ds date, x double")
    out = pandas_of(shape.join_target(target, hf, ["k"]))
    assert out["ds"].tolist() == [month(0), month(1), month(2)]
    assert out["y"].isna().tolist() == [False, False, True]


def expected_design(target, daily, weekly, cutoff, lags):
    """The same design written with pandas."""
    parts = []
    for frame, stats in ((daily, ["mean", "std", "last"]), (weekly, ["mean", "last"])):
        cut = frame[frame["ds"].dt.day <= cutoff].set_index("ds")
        grouped = cut.groupby(cut.index.to_period("M")).agg(stats)
        grouped.columns = [f"{c}_{s}" for c, s in grouped.columns]
        parts.append(grouped)
    hf = pd.concat(parts, axis=1)
    for c in list(hf):
        if not c.endswith("_std"):
            hf[f"{c}_mom"] = hf[c].pct_change()
    hf.index = hf.index.to_timestamp()
    both = pd.concat([target.set_index("ds")[["y"]], hf], axis=1)
    for k in lags:
        both[f"y_lag{k}"] = both["y"].shift(k)
    return both.iloc[max(lags):]


@pytest.mark.parametrize("cutoff,lags", [(20, (1, 2)), (10, (1, 2, 12))])
def test_nowcast_design_matches_pandas(spark, cutoff, lags):
    target, daily, weekly = mixed_frequency()
    got = align.nowcast_features(
        to_spark(spark, target), ["k"], "y",
        (to_spark(spark, daily), ["load", "load_ind"]), (to_spark(spark, weekly), ["idx"]), cutoff, lags,
    )
    got = pandas_of(got)
    want = expected_design(target, daily, weekly, cutoff, lags)
    assert len(got) == len(want) == 60 - max(lags)
    assert set(got.columns) - {"k", "ds"} == set(want.columns)
    for c in want:
        assert np.allclose(got[c], want[c], equal_nan=True), c
    specs = align.nowcast_feature_specs(["load", "load_ind"], ["idx"], "y", lags)
    assert set(names(specs)) == set(want.columns) - {"y"}
    assert names(of_kind(specs, "target_lag")) == [f"y_lag{k}" for k in lags]


def test_design_costs_one_rollup_and_one_series_shuffle(spark, tmp_path):
    target, daily, weekly = mixed_frequency()
    paths = {}
    for name, frame in (("t", target), ("d", daily), ("w", weekly)):
        paths[name] = str(tmp_path / name)
        to_spark(spark, frame).write.parquet(paths[name])
    t, d, w = (spark.read.parquet(paths[n]) for n in "tdw")
    out = align.nowcast_features(t, ["k"], "y", (d, ["load"]), (w, ["idx"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan and "load_ind" not in plan


def test_vintages_are_nested(spark):
    _, daily, _ = mixed_frequency()
    df = to_spark(spark, daily)
    curve = align.vintage_curve(df, ["k"], ["load"])
    for cutoff in (10, 20, 30):
        one = pandas_of(align.daily_to_monthly(df, ["k"], ["load"], cutoff))
        part = pandas_of(curve.filter(f"cutoff = {cutoff}")).drop(columns="cutoff")
        assert np.allclose(one["load_mean"], part["load_mean"]) and np.allclose(one["load_last"], part["load_last"])


def test_no_series_disappears_from_a_wide_table(spark):
    df = panel(spark, [("a", month(0), 1.0), ("z", month(0), 2.0), ("b", month(1), 3.0)])
    assert shape.series_names(df, "k") == ["a", "b", "z"]
    with pytest.raises(ValueError):
        shape.series_names(df, "k", most=2)
    with pytest.raises(Exception, match="not listed: z"):
        shape.pivot_series(df, "k", "y", ["a", "b"]).collect()


def test_pivot_melt_and_split(spark):
    df = panel(spark, [("a", month(0), 1.0), ("b", month(0), 2.0), ("a", month(1), 3.0)])
    wide = shape.pivot_series(df, "k", "y", ["a", "b", "c"])
    assert wide.columns == ["ds", "a", "b", "c"]
    row = wide.filter("ds = '2020-01-01'").first()
    assert (row["a"], row["b"], row["c"]) == (1.0, 2.0, None)
    assert shape.melt_series(wide, ["a", "b"], ["ds"]).count() == 4
    x, y = shape.split_xy(wide, "a", ["ds"])
    assert x.columns == ["ds", "b", "c"] and y.columns == ["ds", "a"]
    with pytest.raises(ValueError):
        shape.split_xy(wide, "zzz")

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import month, noisy_panel, pandas_of, panel, series
from panelcast.functions import scalars
from panelcast.operators import evaluate, quality, scenarios


def test_verdict_counts_nulls_nan_and_repeated_values(spark):
    rows = [("a", month(i), float(i)) for i in range(40)]
    rows += [("b", month(i), float(i % 39)) for i in range(40)]
    rows += [("c", month(i), float(i) if i else None) for i in range(40)]
    rows += [("d", month(0), float("nan"))]
    out = pandas_of(quality.quality_verdict(panel(spark, rows), ["k"], ["y"]), "k").set_index("k")
    assert out["is_valid"].to_dict() == {"a": True, "b": False, "c": False, "d": False}
    assert out["n_duplicates"].to_dict() == {"a": 0, "b": 1, "c": 0, "d": 0}
    assert out["n_null"].to_dict() == {"a": 0, "b": 0, "c": 1, "d": 1}
    exact = quality.quality_verdict(panel(spark, rows[:36]), ["k"], ["y"]).first()
    assert not exact["is_valid"] and exact["n_rows"] == 36


def test_whole_table_quartiles_are_exact_beyond_the_sketch(spark):
    rng = np.random.default_rng(3)
    skewed = np.round(np.exp(rng.normal(0, 2, 60_000)), 4)
    tied = rng.integers(0, 4, 60_000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"u": skewed, "v": tied})).repartition(7)
    out = pandas_of(quality.describe_panel(df, [], ["u", "v"]), "column").set_index("column")
    for c, x in (("u", skewed), ("v", tied)):
        assert np.allclose(out.loc[c, ["p25", "p50", "p75"]].astype(float), np.percentile(x, [25, 50, 75]), rtol=1e-12)
        assert out.loc[c, "count"] == 60_000 and out.loc[c, "max"] == x.max()


def test_ranks_of_odd_values(spark):
    rng = np.random.default_rng(6)
    columns = {
        "hot": np.r_[np.full(3000, 7.25), rng.normal(7.25, 1e-9, 40)],
        "wide": np.exp(rng.uniform(-600, 600, 3040)) * rng.choice([-1, 1], 3040),
        "ends": np.r_[np.full(900, -np.inf), rng.normal(size=240), np.full(1900, np.inf)],
        "tiny": rng.integers(-3, 4, 3040) * 5e-324,
        "near": 1.0 + rng.integers(0, 9, 3040) * 2.0**-52,
        "o'clock": rng.choice([-1.7e308, -1.0, 1.0, 1.7e308], 3040),
        "same": np.full(3040, 3.0),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    df = df.withColumns({"nans": F.when(F.col("same") == 3, F.when(F.rand(1) < 0.4, float("nan")).otherwise(1.0)), "none": F.lit(None).cast("double")})
    out = pandas_of(quality.describe_panel(df, [], df.columns), "column").set_index("column")
    for c, x in columns.items():
        x = np.sort(x)
        for q in (0.25, 0.5, 0.75):
            at = (len(x) - 1) * q
            low, high = x[math.floor(at)], x[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert out.loc[c, f"p{int(q * 100)}"] == want, (c, q)
    assert out.loc["nans", "p25"] == 1.0 and np.isnan(out.loc["nans", "p75"])
    assert out.loc["none", "count"] == 0 and pd.isna(out.loc["none", "p50"])


def test_no_task_ranks_the_rows_of_one_value(spark, tmp_path):
    """What reaches the tasks behind a shuffle is sums of bins: far below a hundredth of the rows."""
    rows = 2_000_000
    df = spark.range(0, rows, 1, 8).select(F.when(F.col("id") % 1000 == 0, F.rand(3)).otherwise(0.5).alias("v"))
    sc = spark.sparkContext

    def read_by_stage():
        none = sc._gateway.new_array(sc._jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleReadRecords() for i in range(stages.size())}

    before = read_by_stage()
    out = quality.describe_panel(df, [], ["v"]).first()
    assert out["p25"] == out["p50"] == out["p75"] == 0.5
    read = [n for stage, n in read_by_stage().items() if stage not in before]
    assert read and max(read) < rows // 100


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 101])
def test_whole_table_quartiles_of_short_columns(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    out = quality.describe_panel(series(spark, [float(v) for v in x]), [], ["y"]).first()
    assert np.allclose([out["p25"], out["p50"], out["p75"]], np.percentile(x, [25, 50, 75]))


def test_metrics_by_hand(spark):
    rows = [("a", month(i), m, y, p) for m, shift in (("good", 1.0), ("bad", 2.0))
            for i, (y, p) in enumerate([(10.0, 10.0 + shift), (12.0, 12.0 - shift), (9.0, 9.0 + shift)])]
    pred = panel(spark, rows, "k string, ds date, model string, y double, yhat double")
    out = pandas_of(evaluate.metrics_table(pred, ["k"]), "model").set_index("model")
    assert out["rmse"].to_dict() == {"bad": 2.0, "good": 1.0}
    assert np.isclose(out.loc["good", "mase"], 1.0 / 2.5)
    assert np.isclose(out.loc["good", "mape"], (1 / 10 + 1 / 12 + 1 / 9) / 3)
    gains = pandas_of(evaluate.gain_vs_baseline(evaluate.metrics_table(pred, ["k"]), ["k"], "bad"), "model")
    assert gains["gain_pct"].tolist() == [0.0, 50.0]
    assert evaluate.best_model(evaluate.metrics_table(pred, ["k"]), ["k"]).first()["model"] == "good"


def test_a_failed_model_never_wins(spark):
    rows = [("a", "ridge", 2.0), ("a", "bridge", None), ("a", "tree", float("nan")), ("b", "bridge", None)]
    metrics = spark.createDataFrame(rows, "k string, model string, rmse double")
    best = {r["k"]: (r["model"], r["rmse"]) for r in evaluate.best_model(metrics, ["k"]).collect()}
    assert best == {"a": ("ridge", 2.0), "b": (None, None)}


def test_folds_from_a_table_need_no_join(spark):
    df = panel(spark, [("a", month(i), float(i)) for i in range(6)])
    folds = spark.createDataFrame(
        [(1, month(2), month(4)), (2, month(4), month(6))], "fold int, test_start date, test_end date"
    )
    out = evaluate.expand_folds(df, folds, ["k"])
    got = {(r["fold"], r["split"]): r["count"] for r in out.groupBy("fold", "split").count().collect()}
    assert got == {(1, "train"): 2, (1, "test"): 2, (2, "train"): 4, (2, "test"): 2}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_ties_and_constant_series(spark):
    rows = [("a", month(i), m, 5.0, 6.0) for m in ("zeta", "alpha") for i in range(3)]
    pred = panel(spark, rows, "k string, ds date, model string, y double, yhat double")
    metrics = evaluate.metrics_table(pred, ["k"])
    assert {r["mase"] for r in metrics.collect()} == {0.0}
    assert evaluate.best_model(metrics, ["k"]).first()["model"] == "alpha"


def test_predictions_beyond_the_actuals_are_not_scored(spark):
    pred = panel(spark, [("a", month(i), "m", 1.0) for i in range(5)], "k string, ds date, model string, yhat double")
    assert evaluate.align_eval(series(spark, [1.0, 2.0]), pred, ["k"]).count() == 2


def test_folds_are_disjoint_ordered_and_sized(spark):
    out = pandas_of(evaluate.expanding_folds(series(spark, [float(i) for i in range(120)]), ["k"]), "fold", "ds")
    seen = []
    for fold, rows in out.groupby("fold"):
        train, test = rows[rows["split"] == "train"], rows[rows["split"] == "test"]
        assert len(train) == 120 - (5 - fold + 1) * 12 and len(test) == 12
        assert train["ds"].max() < test["ds"].min()
        seen += test["ds"].tolist()
    assert len(seen) == len(set(seen)) == 60 and max(seen) == month(119)


def test_fold_table_gives_the_same_folds(spark):
    df = series(spark, [float(i) for i in range(120)])
    bounds = [(k, month(120 - (5 - k + 1) * 12), month(120 - (5 - k) * 12)) for k in range(1, 6)]
    table = spark.createDataFrame(bounds, "fold int, test_start date, test_end date")
    order = ["k", "ds", "y", "fold", "split"]
    a = pandas_of(evaluate.expand_folds(df, table, ["k"]).select(order), "fold", "ds")
    b = pandas_of(evaluate.expanding_folds(df, ["k"]).select(order), "fold", "ds")
    pd.testing.assert_frame_equal(a, b)


def test_histogram_counts_every_row(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=500), np.zeros(500)]
    df = series(spark, [float(v) for v in x]).withColumnRenamed("y", "residual")
    for keys in (["k"], []):
        out = pandas_of(evaluate.residual_histogram(df, keys), "bin")
        assert out["n"].sum() == 1000 and out["bin"].between(0, 29).all()
    want, _ = np.histogram(x, 30)
    assert out.set_index("bin")["n"].reindex(range(30), fill_value=0).tolist() == want.tolist()
    flat = evaluate.residual_histogram(series(spark, [2.0, 2.0]).withColumnRenamed("y", "residual"), ["k"])
    assert [(r["bin"], r["n"]) for r in flat.collect()] == [(0, 2)]


def test_interval_levels(spark):
    df = panel(spark, [("a", month(0), 10.0, 2.0)], "k string, ds date, yhat double, sigma double")
    row = scalars.interval(df, 0.90).first()
    assert np.isclose(row["lower"], 10 - 3.29) and np.isclose(row["upper"], 10 + 3.29)
    with pytest.raises(ValueError):
        scalars.interval(df, 0.8)


def test_clip_and_total_with_nulls(spark):
    df = panel(spark, [("a", month(0), None, 1.005), ("b", month(0), 9.0, 2.0)], "k string, ds date, u double, v double")
    out = pandas_of(scalars.row_total(df, ["u", "v"]).withColumn("c", scalars.clip("u", 0.0, 5.0)))
    assert out["total"].tolist() == [1.01, 11.0] or out["total"].tolist() == [1.0, 11.0]
    assert math.isnan(out["c"][0]) and out["c"][1] == 5.0


def test_scenarios(spark):
    df = series(spark, [1.0, 3.0])
    paths = scenarios.scenario_path(df.withColumnRenamed("y", "yhat"))
    final = {r["scenario"]: r["final_value"] for r in scenarios.scenario_table(paths, ["k"]).collect()}
    assert np.allclose([final["pessimista"], final["base"], final["otimista"]], [2.94, 3.0, 3.06])
    sigma = math.sqrt(2)
    with pytest.warns(UserWarning):
        out = scenarios.scenario_inputs(df, ["k"], {"y": 0.5}, ["otimista", "strange"], magnitude=2.0)
    got = {(r["scenario"], r["ds"]): r["y"] for r in out.collect()}
    assert np.isclose(got["otimista", month(0)], 1.0 + sigma)
    assert got["base", month(0)] == 1.0


def test_date_parts_and_factor(spark):
    from panelcast.functions import dates
    df = spark.createDataFrame([(dt.date(2024, 6, 1),), (dt.date(2024, 6, 2),), (dt.date(2024, 6, 3),)], "ds date")
    assert [r[0] for r in df.select(dates.weekday_factor("ds")).collect()] == [0.75, 0.6, 1.0]
    row = dates.cyclical(dates.month_dummies(dates.date_parts(df))).first()
    assert (row["month"], row["quarter"], row["day_of_year"], row["month_6"], row["month_5"]) == (6, 2, 153, 1, 0)
    assert np.isclose(row["month_cos"], -1) and np.isclose(row["quarter_sin"], 0)


def test_a_model_with_fewer_scored_rows_loses(spark):
    rows = [("a", month(i), m, float(i), None if m == "lucky" and i else i + (m == "full")) for i in range(6) for m in ("full", "lucky")]
    rows = [(k, d, m, y, None if p is None else float(p)) for k, d, m, y, p in rows]
    pred = panel(spark, rows, "k string, ds date, model string, y double, yhat double")
    metrics = evaluate.metrics_table(pred, ["k"], counted=True)
    assert {r["model"]: r["n_scored"] for r in metrics.collect()} == {"full": 6, "lucky": 1}
    assert evaluate.best_model(metrics, ["k"]).first()["model"] == "full"


def test_rolling_cv_equals_a_loop(spark):
    from panelcast.config import BoostConfig
    from panelcast.operators import boosted, linear, structural

    df, xs = noisy_panel(spark), ["x1", "x2"]
    ridge = evaluate.rolling_cv(
        df, ["k"], lambda t, k: linear.ar_baseline_fit(t, k, "y", xs),
        lambda m, t, k: linear.bridge_predict(m, t, k, xs), 3, 6, "ridge",
    )
    line = evaluate.rolling_cv(
        df, ["k"], lambda t, k: structural.structural_fit(t, k),
        lambda m, t, k: structural.structural_predict(m, k, 6).filter("is_future"), 3, 6, "structural",
    )
    got = {(r["k"], r["fold"], r["ds"], r["model"]): r["yhat"] for r in ridge.unionByName(line).collect()}
    assert len(got) == 2 * 2 * 3 * 6
    for fold in (1, 3):
        end = 72 - (3 - fold) * 6
        train = df.filter(F.col("ds") < month(end - 6))
        test = df.filter((F.col("ds") >= month(end - 6)) & (F.col("ds") < month(end)))
        one = linear.bridge_predict(linear.ar_baseline_fit(train, ["k"], "y", xs), test, ["k"], xs)
        two = structural.structural_predict(structural.structural_fit(train, ["k"]), ["k"], 6).filter("is_future")
        for name, rows in (("ridge", one), ("structural", two)):
            for r in rows.collect():
                assert np.isclose(got[r["k"], fold, r["ds"], name], r["yhat"])
    trees = evaluate.rolling_cv(
        df, ["k"], lambda t, k: boosted.boosted_forecast_fit(t, k, "y", xs, BoostConfig(max_depth=2, n_estimators=2)),
        lambda m, t, k: m.predict(t), 2, 6, "trees", pooled=True,
    )
    assert trees.filter("yhat is not null").groupBy("k", "fold").count().filter("count = 6").count() == 4

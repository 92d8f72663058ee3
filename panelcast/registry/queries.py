"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.functions import dates, scalars
from panelcast.functions.spec import FeatureSpec, names, select_by_kind
from panelcast.operators import (
    align, bands, bends, boosted, evaluate, explain, foldfit, forecast, linear, midas, quality, scenarios, shape, structural,
    vintages, windows,
)
from panelcast.plans import forecast as forecast_plan, nowcast as nowcast_plan
from panelcast.registry.common import (
    DRIVERS, KEYS, SHOCKS, known_target, macro, rounded, target, yardsticks,
)
from panelcast.session import cut_lineage, shared_dir
from panelcast.sources import calendars, io, store, testdata as td
from panelcast.streaming import months, rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _weekly(spark, sf) -> DataFrame:
    return td.weekly_indicator(td.daily_indicator(spark, sf))


def _indicators(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Daily and weekly panel; the daily one is written once, as the raw rows feed both."""
    daily = cut_lineage(td.daily_indicator(spark, sf))
    return daily.select("series", "ds", "qty", "rev"), td.weekly_indicator(daily)


# ---- sources, sinks, calendars -------------------------------------------------------------

@query
def a1_read_panel(spark, sf):
    return io.read_panel(
        spark, f"{sf}/orders.parquet", ["o_orderpriority"], "o_orderdate", ["o_totalprice"]
    )


@query
def a2_time_slice(spark, sf):
    rows = io.time_slice(td.table(spark, sf, "orders"), "1996-02-01", "1998-06-30", "o_orderdate")
    return rows.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ds"), "o_totalprice")


def _revenue_by_month(spark, sf):
    daily = td.daily_indicator(spark, sf)
    return daily.groupBy("series", dates.month_floor("ds").alias("ds")).agg(
        F.sum(F.col("rev").cast("decimal(28,4)")).cast("double").alias("y")
    )


@query
def a3_merge_sources(spark, sf):
    merged = io.merge_sources(td.monthly_target(spark, sf), _revenue_by_month(spark, sf), KEYS, ["y"])
    return rounded(merged)


@query
def a4_calendar_spine(spark, sf):
    orders = td.table(spark, sf, "orders")
    bounds = orders.groupBy("o_orderpriority").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first"),
        F.max(F.col("o_orderdate").cast("date")).alias("last"),
    )
    out = None
    for freq in dates.STEPS:
        part = calendars.calendar_spine(bounds, "first", "last", freq, ["o_orderpriority"])
        part = part.withColumn("freq", F.lit(freq))
        out = part if out is None else out.unionByName(part)
    return out


@query
def a5_gap_fill(spark, sf):
    return target(spark, sf)


@query
def a5_missing_periods(spark, sf):
    return calendars.missing_periods(td.monthly_wide_panel(spark, sf), KEYS)


@query
def a5_gap_fill_daily(spark, sf):
    return calendars.gap_fill(td.daily_indicator(spark, sf).select("series", "ds", "qty"), KEYS, freq="D")


@query
def a6_future_spine(spark, sf):
    return calendars.future_spine(td.monthly_wide_panel(spark, sf), KEYS, 12)


@query
def a7_assemble_wide(spark, sf):
    return rounded(td.macro_panel(spark, sf))


@query
def a8_pivot_series(spark, sf):
    panel = td.monthly_target(spark, sf)
    return shape.pivot_series(panel, "series", "y", shape.series_names(panel, "series"))


@query
def a8_melt_series(spark, sf):
    return shape.melt_series(td.daily_indicator(spark, sf), ["qty", "rev"], ["series", "ds"], "measure")


@query
def a9_dedupe_columns(spark, sf):
    panel = _weekly(spark, sf)
    doubled = panel.select("*", "idx", F.lit(False).alias("isPartial"))
    return io.dedupe_columns(doubled, drop=["isPartial"])


@query
def a10_write_report(spark, sf):
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    io.write_report(td.monthly_wide_panel(spark, sf), path, "csv")
    return io.read_panel(spark, path, KEYS, "ds", ["y"], "csv")


def _stored(spark, panel: DataFrame) -> tuple[DataFrame, str]:
    name = f"stored_{uuid.uuid4().hex}"
    return store.create_store(panel, name, KEYS, buckets=16, path=f"{shared_dir(spark)}/{name}"), name


@query
def a10_store_panel(spark, sf):
    """The nation panel as a bucketed table with every second month missing; those are put in later, and
    all of the last year once more, which changes nothing."""
    panel = cut_lineage(td.monthly_wide_panel(spark, sf))
    _, name = _stored(spark, panel.filter(F.month("ds") % 2 == 1))
    store.replace_months(panel.filter(F.month("ds") % 2 == 0), name)
    store.replace_months(panel.filter(F.col("ds") >= F.add_months(td.first_open_month(spark, sf), -12)), name)
    return store.read_store(spark, name)


@query
def e1_lags_stored(spark, sf):
    """Lags of the stored panel: its buckets take the place of the shuffle."""
    stored, _ = _stored(spark, target(spark, sf))
    return windows.lags(stored, KEYS, "y")


# ---- projections, filters, scalar functions ------------------------------------------------

@query
def b1_date_parts(spark, sf):
    return dates.date_parts(td.daily_indicator(spark, sf).select("series", "ds"))


@query
def b2_cyclical(spark, sf):
    return rounded(dates.cyclical(td.daily_indicator(spark, sf).select("series", "ds")))


@query
def b3_month_dummies(spark, sf):
    return dates.month_dummies(td.monthly_wide_panel(spark, sf))


@query
def b4_split_xy(spark, sf):
    x, y = shape.split_xy(td.macro_panel(spark, sf), "y", ["series", "ds"])
    return rounded(x)


@query
def b5_drop_incomplete(spark, sf):
    lagged = windows.lags(target(spark, sf), KEYS, "y")
    return shape.drop_incomplete(lagged)


@query
def b5_incomplete_counts(spark, sf):
    lagged = windows.lags(target(spark, sf), KEYS, "y")
    return shape.incomplete_counts(lagged, KEYS, [c for c in lagged.columns if c.startswith("y")])


@query
def b6_cutoff_filter(spark, sf):
    return align.cutoff_filter(td.daily_indicator(spark, sf), 20)


@query
def b7_month_floor(spark, sf):
    feed = td.table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    return feed.groupBy(dates.month_floor(day).alias("ds")).agg(F.count(F.lit(1)).alias("n"))


@query
def b8_row_total(spark, sf):
    daily = cut_lineage(td.daily_indicator(spark, sf).select("series", "ds", "qty"))
    segments = shape.series_names(daily, "series")
    return scalars.row_total(shape.pivot_series(daily, "series", "qty", segments), segments)


@query
def b9_clip(spark, sf):
    rows = td.macro_panel(spark, sf).select("series", "ds", "policy_rate")
    return rounded(rows.withColumn("policy_rate", scalars.clip("policy_rate", 0.048, 0.052)))


@query
def b10_weekday_factor(spark, sf):
    rows = td.daily_indicator(spark, sf).select("series", "ds", "qty")
    factor = dates.weekday_factor("ds")
    return rounded(rows.withColumns({"factor": factor, "adjusted": F.col("qty") / factor}))


@query
def b11_scenario_path(spark, sf):
    paths = forecast.persistence_forecast(known_target(spark, sf), KEYS)
    return rounded(scenarios.scenario_path(paths))


@query
def b12_scenario_inputs(spark, sf):
    k = {"production": 0.5, "unemployment": -0.5, "policy_rate": 0.3}
    rows = macro(spark, sf).select("series", "ds", *k)
    return rounded(scenarios.scenario_inputs(rows, KEYS, k), production=2)


@query
def b13_select_by_kind(spark, sf):
    specs = align.nowcast_feature_specs(["qty"], [], "y", (1, 2, 12))
    return select_by_kind(_daily_nowcast(spark, sf, ["qty"]), specs, ["target_lag"], ["series", "ds"])


@query
def b14_fill_zero(spark, sf):
    return scalars.fill_zero(target(spark, sf), ["y"])


@query
def b15_round_report(spark, sf):
    metrics = evaluate.gain_vs_baseline(evaluate.error_metrics(yardsticks(spark, sf), KEYS), KEYS, "naive")
    return scalars.round_report(metrics, {"rmse": 4, "mae": 4, "mape": 4, "gain_pct": 2})


@query
def b16_growth_path(spark, sf):
    known = known_target(spark, sf)
    now = windows.latest_row(known, KEYS).withColumnRenamed("y", "nowcast")
    base = windows.value_back(known, KEYS, "y", 12, name="base").select("series", "base")
    return rounded(forecast.growth_path(now.join(base, KEYS), KEYS), yhat=2)


@query
def b17_interval(spark, sf):
    pred = yardsticks(spark, sf)
    sigma = evaluate.residual_sigma(pred, ["series", "model"])
    return rounded(scalars.interval(pred.join(sigma, ["series", "model"]), 0.95))


@query
def b18_residuals(spark, sf):
    return rounded(scalars.residuals(yardsticks(spark, sf)))


# ---- joins ---------------------------------------------------------------------------------

@query
def c1_join_frequencies(spark, sf):
    daily = cut_lineage(td.daily_indicator(spark, sf))
    d = align.daily_to_monthly(daily, KEYS, ["qty"], 20)
    w = align.weekly_to_monthly(td.weekly_indicator(daily), KEYS, ["idx"], 20)
    return rounded(shape.join_frequencies(d, w, KEYS))


@query
def c2_join_target(spark, sf):
    d = align.daily_to_monthly(td.daily_indicator(spark, sf), KEYS, ["qty"], 20)
    return rounded(shape.join_target(td.monthly_target(spark, sf), d, KEYS))


@query
def c3_expand_folds(spark, sf):
    known = known_target(spark, sf)
    k = F.explode(F.sequence(F.lit(1), F.lit(5)))
    folds = known.agg(F.max("ds").alias("_m")).select("_m", k.alias("fold")).select(
        "fold",
        F.add_months("_m", (F.col("fold") - 6) * 12 + 1).alias("test_start"),
        F.add_months("_m", (F.col("fold") - 5) * 12 + 1).alias("test_end"),
    )
    return evaluate.expand_folds(known, folds, KEYS)


@query
def c4_cross_params(spark, sf):
    return align.cross_params(td.monthly_wide_panel(spark, sf), "cutoff", [10, 20, 30])


@query
def c5_align_eval(spark, sf):
    known = known_target(spark, sf)
    train = windows.holdout_split(known, KEYS, 12).filter("split = 'train'").drop("split")
    pred = forecast.persistence_forecast(train, KEYS).withColumn("model", F.lit("flat"))
    return evaluate.align_eval(known, pred, KEYS)


@query
def c6_attach_baseline(spark, sf):
    return rounded(evaluate.attach_baseline(evaluate.error_metrics(yardsticks(spark, sf), KEYS), KEYS, "naive"))


# ---- aggregations --------------------------------------------------------------------------

@query
def d1_daily_to_monthly(spark, sf):
    return rounded(align.daily_to_monthly(td.daily_indicator(spark, sf), KEYS, ["qty", "rev"], 20))


@query
def d2_weekly_to_monthly(spark, sf):
    return rounded(align.weekly_to_monthly(_weekly(spark, sf), KEYS, ["idx"], 20))


@query
def d3_null_profile(spark, sf):
    return quality.null_profile(macro(spark, sf), KEYS, ["y", *DRIVERS])


@query
def d4_duplicate_rows(spark, sf):
    rows = td.daily_indicator(spark, sf)
    return quality.duplicate_rows(rows, KEYS, ["qty", "n_lines"])


_TWO = dict.fromkeys(("mean", "std", "min", "p25", "p50", "p75", "max"), 2)


@query
def d5_describe_panel(spark, sf):
    return rounded(quality.describe_panel(td.daily_indicator(spark, sf), KEYS, ["qty", "rev"]), **_TWO)


@query
def d5_describe_whole_table(spark, sf):
    rows = td.table(spark, sf, "lineitem")
    return rounded(quality.describe_panel(rows, [], ["l_quantity", "l_extendedprice", "l_tax"]))


@query
def d6_quality_verdict(spark, sf):
    return quality.quality_verdict(macro(spark, sf), KEYS, ["y", *DRIVERS])


@query
def d7_series_sigma(spark, sf):
    return rounded(quality.series_sigma(macro(spark, sf), KEYS, DRIVERS), production_sigma=2)


@query
def d8_error_metrics(spark, sf):
    return rounded(evaluate.error_metrics(yardsticks(spark, sf), KEYS))


@query
def d8_predictions_wide(spark, sf):
    return rounded(evaluate.predictions_wide(yardsticks(spark, sf), KEYS, ["naive", "seasonal"]))


@query
def d9_mase(spark, sf):
    return rounded(evaluate.mase(yardsticks(spark, sf), KEYS))


@query
def d9_mase_train_scale(spark, sf):
    train = windows.holdout_split(known_target(spark, sf), KEYS).filter("split = 'train'")
    return rounded(evaluate.mase(yardsticks(spark, sf), KEYS, "train", train))


@query
def d10_gain_vs_baseline(spark, sf):
    metrics = evaluate.metrics_table(yardsticks(spark, sf), KEYS)
    return rounded(evaluate.gain_vs_baseline(metrics, KEYS, "naive"))


@query
def d11_best_model(spark, sf):
    return rounded(evaluate.best_model(evaluate.error_metrics(yardsticks(spark, sf), KEYS), KEYS))


@query
def d12_residual_sigma(spark, sf):
    return rounded(evaluate.residual_sigma(yardsticks(spark, sf), ["series", "model"]))


@query
def d13_global_attribution(spark, sf):
    return rounded(explain.global_attribution(_ridge_contributions(spark, sf), KEYS), importance=2)


@query
def d14_fold_summary(spark, sf):
    return rounded(
        evaluate.fold_summary(evaluate.error_metrics(_cv_predictions(spark, sf), [*KEYS, "fold"]), KEYS),
    )


@query
def d15_residual_histogram(spark, sf):
    rows = scalars.residuals(yardsticks(spark, sf))
    return rounded(evaluate.residual_histogram(rows, ["model"]))


@query
def d16_split_counts(spark, sf):
    return boosted.split_counts(_boosted_ar(spark, sf)[0])


# ---- windows -------------------------------------------------------------------------------

@query
def e1_lags(spark, sf):
    return windows.lags(target(spark, sf), KEYS, "y")


@query
def e2_rolling_mean(spark, sf):
    return rounded(windows.rolling_mean(target(spark, sf), KEYS, ["y"]))


@query
def e2_rolling_mean_shifted(spark, sf):
    return rounded(windows.rolling_mean(target(spark, sf), KEYS, ["y"], shift=1))


@query
def e3_shock(spark, sf):
    return rounded(windows.shock(macro(spark, sf).select("series", "ds", "policy_rate"), KEYS, "policy_rate"))


@query
def e4_pct_change(spark, sf):
    return rounded(windows.pct_change(target(spark, sf), KEYS, ["y"]))


@query
def e4_pct_change_nofill(spark, sf):
    return rounded(windows.pct_change(target(spark, sf), KEYS, ["y"], fill="none"))


@query
def e5_impute_edges(spark, sf):
    rows = windows.holdout_split(windows.lags(target(spark, sf), KEYS, "y", [1, 12]), KEYS)
    return windows.impute_edges(rows, KEYS, ["y", "y_lag1", "y_lag12"])


@query
def e6_deflate(spark, sf):
    rows = macro(spark, sf).select("series", "ds", "y", "price_index")
    first = windows.deflate(rows, KEYS, "y", "price_index", name="real_first")
    return rounded(windows.deflate(first, KEYS, "y", "price_index", 1998, name="real_1998"), real_first=2, real_1998=2)


@query
def e7_chain_index(spark, sf):
    rows = macro(spark, sf).select("series", "ds", (F.col("policy_rate") / 12).alias("rate"))
    return rounded(windows.chain_index(rows, KEYS, "rate"))


@query
def e8_minmax_scale(spark, sf):
    return _weekly(spark, sf)


@query
def e9_holdout_split(spark, sf):
    return windows.holdout_split(target(spark, sf), KEYS)


@query
def e10_drop_warmup(spark, sf):
    return windows.drop_warmup(target(spark, sf), KEYS, 12)


@query
def e11_expanding_folds(spark, sf):
    return evaluate.expanding_folds(known_target(spark, sf), KEYS)


@query
def e11_fold_report(spark, sf):
    return evaluate.fold_report(evaluate.expanding_folds(known_target(spark, sf), KEYS), KEYS)


@query
def e12_latest_row(spark, sf):
    return rounded(windows.latest_row(macro(spark, sf), KEYS))


@query
def e13_value_back(spark, sf):
    return windows.value_back(target(spark, sf), KEYS, "y", 12)


@query
def e14_naive_diff(spark, sf):
    return rounded(windows.naive_diff(target(spark, sf), KEYS))


def _ar(spark, sf) -> tuple[DataFrame, list[FeatureSpec]]:
    rows = windows.ar_features(macro(spark, sf), KEYS, "y", DRIVERS, SHOCKS)
    return rows, windows.ar_feature_specs("y", DRIVERS, SHOCKS)


@query
def e15_ar_features(spark, sf):
    rows, _ = _ar(spark, sf)
    return rounded(rows)


# ---- top-k ---------------------------------------------------------------------------------

@query
def f1_top_features(spark, sf):
    return rounded(evaluate.top_features(explain.global_attribution(_ridge_contributions(spark, sf)), 10), importance=2)


@query
def f1_top_features_by_series(spark, sf):
    scores = explain.global_attribution(_ridge_contributions(spark, sf), KEYS)
    return rounded(evaluate.top_features(scores, 2, KEYS), importance=2)


@query
def f2_top15_table(spark, sf):
    scores = explain.global_attribution(_ridge_contributions(spark, sf), KEYS)
    return rounded(evaluate.top15_table(scores, KEYS), importance=2)


@query
def f3_order_by_time(spark, sf):
    return shape.order_by_time(target(spark, sf), KEYS)


# ---- unions --------------------------------------------------------------------------------

@query
def g1_append_forecast(spark, sf):
    known = known_target(spark, sf)
    path = forecast.persistence_forecast(known, KEYS)
    return forecast.append_forecast(known, path)


@query
def g2_stitched_series(spark, sf):
    known = known_target(spark, sf)
    now = forecast.persistence_forecast(known, KEYS, horizon=1).withColumns(
        {"lower": F.col("yhat") * 0.9, "upper": F.col("yhat") * 1.1}
    )
    after = calendars.future_spine(known, KEYS, 13).filter("step > 1")
    path = after.join(now.select("series", "yhat"), KEYS).drop("step")
    return rounded(forecast.stitched_series(known, now, path, KEYS))


@query
def g3_scenario_table(spark, sf):
    paths = scenarios.scenario_path(forecast.persistence_forecast(known_target(spark, sf), KEYS))
    return rounded(scenarios.scenario_table(paths, KEYS))


# ---- models --------------------------------------------------------------------------------

@query
def h1_standardize(spark, sf):
    rows = windows.holdout_split(macro(spark, sf).select("series", "ds", *DRIVERS), KEYS)
    z = linear.standardize(rows, KEYS, DRIVERS, F.col("split") == "train")
    return rounded(z.select("series", "ds", "split", *[f"{d}_z" for d in DRIVERS]))


def _daily_nowcast(spark, sf, cols, target_df=None):
    return align.nowcast_features(
        td.monthly_target(spark, sf) if target_df is None else target_df,
        KEYS, "y", daily=(td.daily_indicator(spark, sf).select("series", "ds", *cols), cols),
    )


def _nowcast(spark, sf, known=False) -> tuple[DataFrame, list[FeatureSpec]]:
    y = td.monthly_target(spark, sf)
    if known:
        y = td.known_until(y, td.first_open_month(spark, sf))
    daily, weekly = _indicators(spark, sf)
    rows = align.nowcast_features(
        y, KEYS, "y", daily=(daily, ["qty", "rev"]), weekly=(weekly, ["idx"])
    )
    return rows, align.nowcast_feature_specs(["qty", "rev"], ["idx"])


@query
def h2_bridge_fit(spark, sf):
    """One indicator, where the elastic net has a closed form."""
    rows = _daily_nowcast(spark, sf, ["rev"], td.known_until(td.monthly_target(spark, sf), td.first_open_month(spark, sf)))
    model = linear.bridge_fit(rows, KEYS, "y", ["rev_mean"], 0.5, 0.5)
    return rounded(model.select("series", "n", "intercept", F.col("coef")[0].alias("coef"), "sigma", "status"), intercept=1, sigma=1)


@query
def h2_bridge_fit_full(spark, sf):
    rows, specs = _nowcast(spark, sf, known=True)
    xs = names(specs)
    known = windows.impute_edges(rows.filter("y is not null"), KEYS, xs, split=None)
    model = linear.bridge_fit(known, KEYS, "y", xs, 0.5, 0.5)
    return rounded(linear.coefficient_table(model, KEYS, xs))


@query
def h2_bridge_fit_pooled(spark, sf):
    rows, specs = _nowcast(spark, sf, known=True)
    xs = names(specs)
    known = windows.impute_edges(rows.filter("y is not null"), KEYS, xs, split=None)
    model = linear.bridge_fit_pooled(known, "y", xs, 0.5, 0.5)
    return rounded(model.predict(known).select("series", "ds", "y", "yhat"), yhat=2)


LAG_XS = ["y_lag1", "y_lag2", "y_lag12"]


def _lagged(spark, sf) -> DataFrame:
    rows = windows.lags(known_target(spark, sf), KEYS, "y", [1, 2, 12])
    return windows.holdout_split(rows, KEYS)


def _ridge(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _lagged(spark, sf)
    return linear.ar_baseline_fit(rows.filter("split = 'train'"), KEYS, "y", LAG_XS), rows


@query
def h3_ar_baseline_fit(spark, sf):
    model, _ = _ridge(spark, sf)
    coefs = [F.col("coef")[i].alias(f"c_{x}") for i, x in enumerate(LAG_XS)]
    return rounded(model.select("series", "n", "intercept", *coefs, "sigma"), intercept=2, sigma=2)


@query
def h3_ar1_fit(spark, sf):
    return rounded(linear.ar1_fit(known_target(spark, sf), KEYS), intercept=2)


@query
def h4_bridge_predict(spark, sf):
    model, rows = _ridge(spark, sf)
    scored = linear.bridge_predict(model, rows.filter("split = 'test'"), KEYS, LAG_XS)
    return rounded(scored.select("series", "ds", "y", "yhat"), yhat=2)


@query
def h5_predict_with_interval(spark, sf):
    model, rows = _ridge(spark, sf)
    scored = linear.predict_with_interval(model, rows.filter("split = 'test'"), KEYS, LAG_XS, 0.90)
    return rounded(scored.select("series", "ds", "yhat", "lower", "upper"), yhat=2, lower=2, upper=2)


@query
def h6_boosted_nowcast_fit(spark, sf):
    rows, specs = _nowcast(spark, sf, known=True)
    xs = names(specs)
    known = windows.impute_edges(rows.filter("y is not null"), KEYS, xs, split=None)
    model = boosted.boosted_nowcast_fit(known, KEYS, "y", xs)
    return rounded(model.predict_with_interval(known).select("series", "ds", "y", "yhat", "lower", "upper"), yhat=2, lower=2, upper=2)


def _boosted_ar(spark, sf):
    panel = td.known_until(td.macro_panel(spark, sf), td.first_open_month(spark, sf))
    rows = windows.ar_features(calendars.gap_fill(panel, KEYS), KEYS, "y", DRIVERS, SHOCKS)
    specs = windows.ar_feature_specs("y", DRIVERS, SHOCKS)
    rows = cut_lineage(rows)
    model = boosted.boosted_forecast_fit(rows, KEYS, "y", names(specs))
    return model, rows, specs


@query
def h7_boosted_forecast_fit(spark, sf):
    model, rows, _ = _boosted_ar(spark, sf)
    return rounded(model.predict(rows).select("series", "ds", "y", "yhat"), yhat=2)


@query
def h8_recursive_forecast(spark, sf):
    known = known_target(spark, sf)
    return rounded(forecast.recursive_forecast_ar1(linear.ar1_fit(known, KEYS), known, KEYS), yhat=2)


@query
def h8_ar1_band(spark, sf):
    known = known_target(spark, sf)
    model = linear.ar1_fit(known, KEYS, spread=True)
    return rounded(bands.ar1_band(forecast.recursive_forecast_ar1(model, known, KEYS), model, KEYS), yhat=2, lower=2, upper=2)


@query
def h8_ridge_band(spark, sf):
    """Three lags and the season: the band follows the shocks through all lags."""
    model, rows, specs = _seasonal_ridge(spark, sf)
    paths = forecast.recursive_forecast_linear(model, rows, KEYS, specs)
    return rounded(bands.linear_band(paths, model, KEYS, specs), yhat=2, lower=2, upper=2)


def _seasonal_ridge(spark, sf):
    specs = [FeatureSpec(x, "target_lag", "y", k) for x, k in zip(LAG_XS, (1, 2, 12))]
    specs += [FeatureSpec(n, "season") for n in ("month_sin", "month_cos")]
    rows = dates.cyclical(_lagged(spark, sf))
    return linear.fit_linear(rows, KEYS, "y", names(specs), 1.0, 0.0), rows, specs


@query
def h8_recursive_ridge(spark, sf):
    """Three lags and the season, through the general linear recursion."""
    model, rows, specs = _seasonal_ridge(spark, sf)
    return rounded(forecast.recursive_forecast_linear(model, rows, KEYS, specs), yhat=2)


@query
def h8_recursive_dummies(spark, sf):
    """The recursion with twelve month dummies in place of waves, each step with its own month."""
    known = known_target(spark, sf)
    rows = windows.ar_features(known, KEYS, "y", [], ks=(1, 2), seasonal="categorical")
    specs = [s for s in windows.ar_feature_specs("y", [], ks=(1, 2), seasonal="categorical") if s.name.startswith(("month_", "y_lag"))]
    model = linear.fit_linear(rows, KEYS, "y", names(specs), 0.1, 0.0)
    return rounded(forecast.recursive_forecast_linear(model, rows, KEYS, specs), yhat=2)


@query
def h8_recursive_boosted(spark, sf):
    model, rows, specs = _boosted_ar(spark, sf)
    return rounded(boosted.recursive_forecast_boosted(model, rows, specs), yhat=2)


@query
def h9_direct_forecast(spark, sf):
    return rounded(forecast.direct_forecast_ar1(known_target(spark, sf), KEYS), yhat=2)


@query
def h9_direct_band(spark, sf):
    return rounded(forecast.direct_forecast_ar1(known_target(spark, sf), KEYS, level=0.95), yhat=2, lower=2, upper=2)


@query
def h9_direct_bridge(spark, sf):
    rows = _lagged(spark, sf)
    return rounded(forecast.direct_forecast(rows, KEYS, "y", ["y", *LAG_XS], 6, 0.5, 0.5), yhat=2)


def _season_table(model: DataFrame) -> DataFrame:
    return model.select(
        "series", "n", "intercept", "slope", "sigma",
        F.explode("season").alias("month", "effect"),
    )


@query
def h10_structural_fit(spark, sf):
    model = structural.structural_fit(known_target(spark, sf), KEYS)
    return rounded(_season_table(model), intercept=2, slope=2, sigma=2, effect=2)


@query
def h10_structural_multiplicative(spark, sf):
    model = structural.structural_fit(known_target(spark, sf), KEYS, mode="multiplicative")
    return rounded(_season_table(model), intercept=2, slope=2, sigma=2)


@query
def h10_piecewise_fit(spark, sf):
    model = structural.piecewise_fit(known_target(spark, sf), KEYS)
    return rounded(structural.piecewise_predict(model, KEYS), yhat=2, lower=2, upper=2, trend=2, seasonal=2)


@query
def h10_bent_trend(spark, sf):
    model = bends.bent_trend_fit(known_target(spark, sf), KEYS)
    return rounded(bends.bent_trend_predict(model, KEYS), yhat=2, lower=2, upper=2, trend=2, seasonal=2)


@query
def h10_change_dates(spark, sf):
    model = bends.bent_trend_fit(known_target(spark, sf), KEYS)
    return rounded(bends.change_dates(model, KEYS), slope_before=2, slope_after=2)


@query
def h11_piecewise_band(spark, sf):
    model = structural.piecewise_fit(known_target(spark, sf), KEYS)
    rows = structural.piecewise_predict(model, KEYS, widen=True).filter("is_future")
    return rounded(rows, yhat=2, lower=2, upper=2, trend=2, seasonal=2)


@query
def h11_structural_predict(spark, sf):
    model = structural.structural_fit(known_target(spark, sf), KEYS)
    return rounded(structural.structural_predict(model, KEYS), yhat=2, lower=2, upper=2, trend=2, seasonal=2)


def _ridge_contributions(spark, sf):
    model, rows = _ridge(spark, sf)
    return explain.linear_contributions(model, shape.drop_incomplete(rows, LAG_XS), KEYS, LAG_XS)


@query
def h12_contributions(spark, sf):
    return rounded(_ridge_contributions(spark, sf), phi=2)


@query
def h12_tree_contributions(spark, sf):
    model, rows, _ = _boosted_ar(spark, sf)
    return rounded(explain.tree_contributions(model, rows)[0], phi=2)


@query
def h13_gain_importance(spark, sf):
    return rounded(boosted.gain_importance(_boosted_ar(spark, sf)[0]))


@query
def h14_nowcast_backtest(spark, sf):
    rows, specs = _nowcast(spark, sf, known=True)
    out = nowcast_plan.nowcast_backtest(rows, KEYS, specs)
    return rounded(out.metrics)


def _cv_predictions(spark, sf):
    """AR(1) refitted in every fold of every series, in one job."""
    def fit(train, keys):
        return train.groupBy(*keys).agg(
            F.regr_intercept("y", "y_lag1").alias("a"), F.regr_slope("y", "y_lag1").alias("b")
        )

    def predict(model, test, keys):
        yhat = F.col("a") + F.col("b") * F.col("y_lag1")
        return shape.attach(test, model, keys, ["a", "b"]).withColumn("yhat", yhat)

    rows = windows.lags(known_target(spark, sf), KEYS, "y", [1])
    return evaluate.rolling_cv(rows, KEYS, fit, predict, 5, 12, "ar1").filter("y is not null")


@query
def h15_rolling_cv(spark, sf):
    return rounded(evaluate.error_metrics(_cv_predictions(spark, sf), [*KEYS, "fold"]))


RIDGE_GRID = (0.01, 0.1, 1.0)


def _moment_cv(spark, sf):
    """Ridge on the last value, every fold and penalty from one table of moments."""
    rows = windows.lags(known_target(spark, sf), KEYS, "y", [1])
    return foldfit.fold_fits(rows, KEYS, "y", ["y_lag1"], RIDGE_GRID, 0.0)


@query
def h15_moment_cv(spark, sf):
    fits = _moment_cv(spark, sf).withColumn("coef", F.col("coef")[0])
    return rounded(fits.select("series", "fold", "alpha", "n", "n_test", "intercept", "coef", "sigma", "rmse", "status"), intercept=2, coef=6, sigma=2, rmse=2)


@query
def h15_alpha_choice(spark, sf):
    return rounded(foldfit.choose_alpha(_moment_cv(spark, sf), KEYS), rmse=2)


@query
def h2_bridge_fit_cv(spark, sf):
    """The full mixed-frequency design with its penalty chosen by fold error."""
    rows, specs = _nowcast(spark, sf, known=True)
    xs = names(specs)
    known = windows.impute_edges(rows.filter("y is not null"), KEYS, xs, split=None)
    fits = foldfit.fold_fits(known, KEYS, "y", xs, foldfit.ALPHAS, 0.5)
    return rounded(linear.coefficient_table(foldfit.bridge_fit_cv(fits, KEYS), KEYS, xs))


@query
def h16_persistence_forecast(spark, sf):
    return forecast.persistence_forecast(known_target(spark, sf), KEYS)


@query
def h17_vintage_curve(spark, sf):
    return rounded(align.vintage_curve(td.daily_indicator(spark, sf), KEYS, ["qty", "rev"]))


#: Days at which the revised panel is looked at.
KNOWN_ON = (dt.date(1995, 6, 30), dt.date(1997, 1, 15), dt.date(1998, 8, 31))


@query
def h17_known_at(spark, sf):
    """Shipped value of each order month as published by three days."""
    known = vintages.known_at(td.shipped_revisions(spark, sf), KEYS, KNOWN_ON, ["shipped"], name="known_on")
    return rounded(known, shipped=2)


@query
def h17_asof_join(spark, sf):
    """Each target month with the newest order month, and its value, published before its last day."""
    target = td.monthly_target(spark, sf).withColumn("origin", F.last_day("ds"))
    news = td.shipped_revisions(spark, sf).withColumnRenamed("ds", "period")
    return rounded(vintages.asof_join(
        target, news, KEYS, "origin", "published_at", ["period", "shipped"], strict=True, told_at="published_at"
    ))


@query
def h17_cutoff_vintage(spark, sf):
    """The cut-off day as the special case of a vintage: rows public by the 20th of their month."""
    return vintages.monthly_known_at(td.daily_indicator(spark, sf), KEYS, 20, ["qty", "rev", "n_lines"])


@query
def h18_nowcast_features(spark, sf):
    rows, specs = _nowcast(spark, sf)
    return rounded(rows)


@query
def h19_run_summary(spark, sf):
    """Parts that do not depend on tree fits: contest of two yardsticks, flat path, scenarios."""
    known = known_target(spark, sf)
    metrics = evaluate.error_metrics(yardsticks(spark, sf), KEYS)
    paths = scenarios.scenario_path(forecast.persistence_forecast(known, KEYS))
    scores = explain.global_attribution(_ridge_contributions(spark, sf), KEYS)
    out = forecast_plan.forecast_summary(known, metrics, paths, scores, KEYS)
    return rounded(
        out.withColumn("top_features", F.array_join("top_features", ","))
    )


@query
def h19_nowcast_run(spark, sf):
    daily, weekly = _indicators(spark, sf)
    result = nowcast_plan.run_nowcast(
        td.known_until(td.monthly_target(spark, sf), td.first_open_month(spark, sf)), KEYS, (daily, ["qty", "rev"]),
        (weekly, ["idx"]),
    )
    return rounded(result.summary)


@query
def h19_forecast_run(spark, sf):
    panel = calendars.gap_fill(td.known_until(td.macro_panel(spark, sf), td.first_open_month(spark, sf)), KEYS)
    result = forecast_plan.run_forecast(panel, KEYS, DRIVERS, SHOCKS)
    return rounded(result.summary.withColumn("top_features", F.array_join("top_features", ",")))


# ---- feed ----------------------------------------------------------------------------------

@query
def s1_stream_rollup(spark, sf):
    like = td.table(spark, sf, "events")
    feed = rollup.read_feed(spark, f"{sf}/event[s].parquet", like).select("event_type", "ts", "value")
    rolled = rollup.stream_rollup(feed, ["event_type"], "value", watermark="30 days")
    return rounded(rollup.run_to_table(rolled, ["event_type"]), mean=6)


@query
def s1_month_stream(spark, sf):
    """The feed's months as stream state: values up to the 20th, and how many rows came after it."""
    like = td.table(spark, sf, "events")
    feed = rollup.read_feed(spark, f"{sf}/event[s].parquet", like).select("event_type", "ts", "value")
    stream = months.month_feed(feed, ["event_type"], ["value"], 20, "ts", "30 days")
    return rounded(months.run_months(stream, ["event_type"]).drop("is_final"), value_mean=6)


@query
def s2_late_rows(spark, sf):
    return rollup.late_rows(td.table(spark, sf, "events"), ["event_type"], 20)


# ---- other weightings of the days of a month -----------------------------------------------

@query
def x1_almon_mean(spark, sf):
    return rounded(align.almon_mean(td.daily_indicator(spark, sf), KEYS, "qty", (1.0, -0.02, 0.0001), 20))


@query
def x1_almon_fit(spark, sf):
    """Order value on the newest ten days of shipped quantity, weights a line over their recency."""
    y = td.known_until(td.monthly_target(spark, sf), td.first_open_month(spark, sf))
    model = midas.almon_fit(y.filter("y is not null"), td.daily_indicator(spark, sf), KEYS, "y", "qty", 10, 1, (), 20)
    theta = [F.col("theta")[p].alias(f"theta{p}") for p in (0, 1)]
    return rounded(model.select("series", "n", "intercept", *theta, "sigma", "status"), intercept=0, theta0=1, theta1=1, sigma=0)


@query
def x2_umidas_orders(spark, sf):
    """How many of the newest days to use, by BIC; lags go across month ends."""
    y = td.known_until(td.monthly_target(spark, sf), td.first_open_month(spark, sf))
    out = midas.umidas_orders(y.filter("y is not null"), td.daily_indicator(spark, sf), KEYS, "y", "qty", 10, 20)
    return rounded(out.drop("coef"), intercept=0, sigma=0, bic=4)


@query
def x2_umidas_features(spark, sf):
    return rounded(align.umidas_features(td.daily_indicator(spark, sf), KEYS, "rev", 5, 20), **{f"rev_d{j}": 4 for j in range(1, 6)})

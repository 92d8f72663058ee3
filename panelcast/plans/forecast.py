"""Twelve-month forecast of a panel of monthly targets with drivers."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from panelcast.config import SCENARIO_SHOCKS, BoostConfig, ForecastConfig
from panelcast.functions.spec import names
from panelcast.operators.boosted import boosted_forecast_fit, recursive_forecast_boosted
from panelcast.operators.evaluate import align_eval, best_model, metrics_table, top_features
from panelcast.operators.explain import global_attribution, tree_contributions
from panelcast.operators.quality import quality_verdict
from panelcast.operators.scenarios import scenario_path, scenario_table
from panelcast.operators.shape import attach
from panelcast.operators.structural import (
    piecewise_fit, piecewise_predict, structural_fit, structural_predict,
)
from panelcast.operators.windows import ar_feature_specs, ar_features
from panelcast.session import cut_lineage

STRUCTURAL, BOOSTED = "structural", "boosted"


@dataclass
class ForecastResult:
    quality: DataFrame
    features: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    forecast: DataFrame
    scenarios: DataFrame
    importance: DataFrame
    summary: DataFrame


# Name of a structural model: how it is fitted and how it is continued.
FORMS = {
    "straight": (structural_fit, structural_predict),
    "piecewise": (piecewise_fit, piecewise_predict),
}


def _structural_path(
    history: DataFrame, keys: Sequence[str], horizon: int, config: ForecastConfig
) -> DataFrame:
    if config.structural not in FORMS:
        raise ValueError(f"structural must be one of {tuple(FORMS)}")
    fit, predict = FORMS[config.structural]
    rows = predict(fit(history, keys, mode=config.mode), keys, horizon, config.interval)
    return rows.filter("is_future").select(*keys, "ds", F.lit(STRUCTURAL).alias("model"), "yhat")


def run_forecast(
    panel: DataFrame,
    keys: Sequence[str],
    drivers: Sequence[str],
    shocks: Sequence[str] = (),
    y: str = "y",
    config: ForecastConfig = ForecastConfig(),
    boost: BoostConfig | None = None,
) -> ForecastResult:
    """Quality, features, hold-out contest of two models, refit, attribution, path, scenarios.

    ``panel`` is gap-filled monthly data ``(keys..., ds, y, drivers...)``.  The test months are the
    last ``test_size`` months of the calendar up to a series' last complete feature row.  The
    structural model and the recursion's state see the panel itself, also months whose features are
    incomplete.  The panel is written once, so what it is made of is read once.  The trial and the
    final ensemble are fitted at the same time: both wait for their rounds' small jobs.
    """
    boost = boost or config.boost
    f = config.features
    shape = dict(shocks=shocks, ks=f.lags, windows=f.rolling, seasonal=f.seasonal)
    panel = cut_lineage(panel.select(*keys, "ds", F.col(y).alias("y"), *drivers))
    quality = quality_verdict(panel, keys, ["y", *drivers], config.min_rows)
    specs = ar_feature_specs("y", drivers, **shape)
    xs = names(specs)
    features = ar_features(panel, keys, "y", drivers, shock_lag=f.shock_lag, **shape)
    features = cut_lineage(features)
    ends = features.groupBy(*keys).agg(F.max("ds").alias("_end"))
    first_test = F.add_months("_end", 1 - config.test_size)
    split = F.when(F.col("ds") >= first_test, "test").otherwise("train")
    rows = cut_lineage(attach(features, ends, keys, ["_end"]).withColumn("split", split).drop("_end"))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    known = attach(panel.select(*keys, "ds", "y"), ends, keys, ["_end"]).filter("ds <= _end")
    known = cut_lineage(known.withColumn("split", split).drop("_end"))
    known_train = known.filter("split = 'train'")

    with ThreadPoolExecutor(2) as pool:
        # One wrapper a thread: each takes its own copy of the local properties.
        fits = [
            pool.submit(inheritable_thread_target(panel.sparkSession)(boosted_forecast_fit), part, keys, "y", xs, boost)
            for part in (train, rows)
        ]
    trial, final = (f.result() for f in fits)
    recursive = recursive_forecast_boosted(trial, train, specs, "y", config.test_size, values=known_train)
    contest = _structural_path(known_train, keys, config.test_size, config).unionByName(
        recursive.select(*keys, "ds", F.lit(BOOSTED).alias("model"), "yhat")
    )
    predictions = cut_lineage(align_eval(test.select(*keys, "ds", "y"), contest, keys))
    metrics = metrics_table(predictions, keys, counted=True)
    winner = best_model(metrics, keys)

    paths = _structural_path(known, keys, config.horizon, config).unionByName(
        recursive_forecast_boosted(final, rows, specs, "y", config.horizon, values=known).select(
            *keys, "ds", F.lit(BOOSTED).alias("model"), "yhat"
        )
    )
    forecast = cut_lineage(paths.join(winner.select(*keys, "model"), [*keys, "model"], "left_semi"))
    scenarios = scenario_path(forecast, config.scenarios, config.scenario_pct)
    contributions, _ = tree_contributions(final, rows)
    importance = cut_lineage(global_attribution(contributions, keys))
    return ForecastResult(
        quality, rows, predictions, metrics, forecast, scenarios, importance,
        forecast_summary(rows, metrics, scenarios, importance, keys, config.horizon, names_of=tuple(config.scenarios)),
    )


def forecast_summary(
    history: DataFrame,
    metrics: DataFrame,
    scenarios: DataFrame,
    importance: DataFrame,
    keys: Sequence[str],
    horizon: int = 12,
    n_top: int = 5,
    names_of: Sequence[str] = tuple(SCENARIO_SHOCKS),
) -> DataFrame:
    """One row per series: period, rows, winner with errors, last value of each scenario in
    ``names_of``, top features."""
    on = list(keys) or ["_one"]

    def keyed(df: DataFrame) -> DataFrame:
        return df if keys else df.withColumn("_one", F.lit(1))

    period = keyed(history).groupBy(*on).agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n_rows")
    )
    winner = keyed(best_model(metrics, keys)).withColumnRenamed("model", "best_model")
    last = keyed(scenario_table(scenarios, keys)).groupBy(*on).agg(
        *[
            F.max(F.when(F.col("scenario") == s, F.col("final_value"))).alias(f"final_{s}")
            for s in names_of
        ]
    )
    ranked = top_features(keyed(importance), n_top, on)
    top = ranked.groupBy(*on).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda p: p["feature"]
        ).alias("top_features")
    )
    out = period.join(winner, on, "left").join(last, on, "left").join(top, on, "left")
    return out.withColumn("horizon", F.lit(horizon)).drop("_one")

"""Mixed-frequency nowcast of a panel of monthly targets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelcast.config import BoostConfig, NowcastBoostConfig, NowcastConfig
from panelcast.functions.spec import FeatureSpec, names, of_kind
from panelcast.operators.align import nowcast_feature_specs, nowcast_features
from panelcast.operators.boosted import boosted_nowcast_fit
from panelcast.operators.evaluate import best_model, gain_vs_baseline, metrics_table
from panelcast.operators.forecast import growth_path, stitched_series
from panelcast.operators.linear import ar_baseline_fit, bridge_fit, bridge_predict
from panelcast.operators.windows import holdout_split, impute_edges, latest_row, value_back
from panelcast.session import cut_lineage

BASELINE, BRIDGE, BOOSTED = "lags_ridge", "bridge", "boosted"


@dataclass
class Backtest:
    predictions: DataFrame
    metrics: DataFrame


def nowcast_backtest(
    features: DataFrame,
    keys: Sequence[str],
    specs: Sequence[FeatureSpec],
    y: str = "y",
    config: NowcastConfig = NowcastConfig(),
    boost: BoostConfig | None = None,
    ds: str = "ds",
) -> Backtest:
    """Last ``test_size`` known months out of sample: lags-only ridge, bridge, boosted trees."""
    boost = boost or config.boost
    xs, lag_xs = names(specs), names(of_kind(specs, "target_lag"))
    known = features.filter(F.col(y).isNotNull()).select(*keys, ds, F.col(y).alias("y"), *xs)
    rows = impute_edges(holdout_split(known, keys, config.test_size, ds), keys, xs, ds)
    rows = cut_lineage(rows)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    linear = {
        BASELINE: (ar_baseline_fit(train, keys, "y", lag_xs, config.baseline_alpha), lag_xs),
        BRIDGE: (bridge_fit(train, keys, "y", xs, config.bridge_alpha, config.bridge_l1_ratio), xs),
    }
    parts = [
        bridge_predict(model, test, keys, cols).withColumn("model", F.lit(name))
        for name, (model, cols) in linear.items()
    ]
    trees = boosted_nowcast_fit(train, keys, "y", xs, boost)
    parts.append(trees.predict(test).withColumn("model", F.lit(BOOSTED)))
    stacked = None
    for part in parts:
        part = part.select(*keys, ds, "model", "y", "yhat", "sigma")
        stacked = part if stacked is None else stacked.unionByName(part)
    metrics = gain_vs_baseline(metrics_table(stacked, keys, ds, counted=True), keys, BASELINE)
    return Backtest(stacked, metrics)


@dataclass
class NowcastResult:
    features: DataFrame
    backtest: Backtest
    nowcast: DataFrame
    path: DataFrame
    timeline: DataFrame
    summary: DataFrame


def current_month(
    features: DataFrame, keys: Sequence[str], y: str = "y", ds: str = "ds"
) -> DataFrame:
    """The first month after the last known target of each series: the row to nowcast."""
    last = features.groupBy(*keys).agg(F.max(F.when(F.col(y).isNotNull(), F.col(ds))).alias("_known"))
    joined = features.join(last, list(keys)) if keys else features.withColumn(
        "_known", last.select("_known").scalar()
    )
    return joined.filter(F.col(ds) == F.add_months("_known", 1)).drop("_known")


def run_nowcast(
    target: DataFrame,
    keys: Sequence[str],
    daily: tuple[DataFrame, Sequence[str]] | None = None,
    weekly: tuple[DataFrame, Sequence[str]] | None = None,
    y: str = "y",
    config: NowcastConfig = NowcastConfig(),
    boost: NowcastBoostConfig | None = None,
    ds: str = "ds",
) -> NowcastResult:
    """Features, backtest, point and band for the current month, growth path, time line, summary."""
    boost = boost or config.boost
    features = cut_lineage(
        nowcast_features(
            target, keys, y, daily, weekly, config.cutoff_day, config.target_lags, ds=ds
        ).withColumnRenamed(y, "y")
    )
    specs = nowcast_feature_specs(
        daily[1] if daily else (), weekly[1] if weekly else (), y, config.target_lags
    )
    xs = names(specs)
    backtest = nowcast_backtest(features, keys, specs, "y", config, boost, ds)
    known = features.filter(F.col("y").isNotNull())
    trees = boosted_nowcast_fit(
        impute_edges(known, keys, xs, ds, split=None), keys, "y", xs, boost
    )
    now = impute_edges(current_month(features, keys, "y", ds), keys, xs, ds, split=None)
    nowcast = trees.predict_with_interval(now, config.interval).select(
        *keys, ds, "yhat", "lower", "upper"
    )
    nowcast = cut_lineage(nowcast)
    year_ago = value_back(known, keys, "y", 12, ds, "base").select(*keys, "base")
    start = nowcast.withColumnRenamed("yhat", "nowcast")
    start = start.join(year_ago, list(keys)) if keys else start.withColumn(
        "base", year_ago.select("base").scalar()
    )
    path = growth_path(start, keys, horizon=config.horizon, ds=ds)
    timeline = stitched_series(known, nowcast, path, keys, "y", ds)
    return NowcastResult(
        features, backtest, nowcast, path, timeline,
        nowcast_summary(known, nowcast, backtest.metrics, keys, ds),
    )


def nowcast_summary(
    known: DataFrame, nowcast: DataFrame, metrics: DataFrame, keys: Sequence[str], ds: str = "ds"
) -> DataFrame:
    """One row per series: last official value, nowcast with band, winner and its gain."""
    last = latest_row(known.select(*keys, ds, "y"), keys, ds).select(
        *keys, F.col(ds).alias("last_ds"), F.col("y").alias("last_value")
    )
    point = nowcast.select(
        *keys, F.col(ds).alias("nowcast_ds"), F.col("yhat").alias("nowcast"), "lower", "upper"
    )
    winner = best_model(metrics, keys).select(
        *keys, F.col("model").alias("best_model"), "rmse", "gain_pct"
    )
    on = list(keys)
    if not on:
        last, point, winner = (t.withColumn("_one", F.lit(1)) for t in (last, point, winner))
        on = ["_one"]
    return last.join(point, on, "left").join(winner, on, "left").drop("_one")

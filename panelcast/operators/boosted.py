"""Gradient-boosted trees over the whole panel (spark.ml), scaled per series."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import BoostConfig, NowcastBoostConfig
from panelcast.functions.dates import date_features
from panelcast.functions.scalars import interval
from panelcast.functions.spec import FeatureSpec
from panelcast.operators.forecast import back, recent_values, state_depth, trailing_mean
from panelcast.operators.shape import attach, doubles, drop_incomplete
from panelcast.operators.windows import latest_row
from panelcast.session import cut_lineage, shared_dir

#: Rows of the design that one task of a boosting round takes.
ROWS_PER_TASK = 65_536
#: Rounds between two checkpoints of the rounds' state.
ROUNDS_PER_CHECKPOINT = 50


def _scale(value: Column, mean: Column, sd: Column) -> Column:
    return (value - mean) / sd


@dataclass
class BoostedModel:
    """``scales`` has one row per series: ``keys..., _ym, _ys, _xm, _xs, sigma``.

    Features and target are z-scored inside each series, which changes nothing for one series
    (trees ignore monotone scaling, squared loss follows the target scale) and makes millions of
    series comparable for one pooled ensemble.
    """

    keys: list[str]
    xs: list[str]
    scales: DataFrame
    trees: GBTRegressionModel

    def predict(self, df: DataFrame, yhat: str = "yhat") -> DataFrame:
        rows = attach(df, self.scales, self.keys, ["_ym", "_ys", "_xm", "_xs", "sigma"])
        return self.score(rows, yhat).drop("_ym", "_ys", "_xm", "_xs")

    def score(self, rows: DataFrame, yhat: str) -> DataFrame:
        """Prediction for rows that already carry the scales of their series."""
        z = [_scale(F.col(x), F.col("_xm")[i], F.col("_xs")[i]) for i, x in enumerate(self.xs)]
        complete = F.col("_ys").isNotNull()
        for x in self.xs:
            complete = complete & F.col(x).isNotNull()
        values = F.when(complete, F.array(*z)).otherwise(F.array(*[F.lit(0.0)] * len(self.xs)))
        scored = self.trees.transform(rows.withColumn("_z", array_to_vector(values)))
        out = F.when(complete, F.col("_pred") * F.col("_ys") + F.col("_ym"))
        return scored.withColumn(yhat, out).drop("_z", "_pred")

    def predict_with_interval(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        return interval(self.predict(df), level)


def boosted_fit(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    xs: Sequence[str],
    config: BoostConfig = BoostConfig(),
) -> BoostedModel:
    """Fit on complete rows.  Rows and scaled design are written once: the rows are read for scales and
    residuals, and the design by every boosting round."""
    rows = cut_lineage(drop_incomplete(df.select(*keys, *doubles(df, [y, *xs])), [y, *xs]))

    def deviation(c: str) -> Column:
        sd = F.stddev_pop(c)
        return F.when(sd == 0, 1.0).otherwise(sd)

    scales = rows.groupBy(*keys).agg(
        F.avg(y).alias("_ym"),
        deviation(y).alias("_ys"),
        F.array(*[F.avg(x) for x in xs]).alias("_xm"),
        F.array(*[deviation(x) for x in xs]).alias("_xs"),
    )
    # A round is some seven jobs over the design: no more tasks than its rows need.
    tasks = max(1, ceil(rows.count() / ROWS_PER_TASK))
    scaled = attach(rows, scales, keys, ["_ym", "_ys", "_xm", "_xs"]).coalesce(tasks)
    z = [_scale(F.col(x), F.col("_xm")[i], F.col("_xs")[i]) for i, x in enumerate(xs)]
    design = cut_lineage(scaled.select(
        _scale(F.col(y), F.col("_ym"), F.col("_ys")).alias("_target"),
        array_to_vector(F.array(*z)).alias("_z"),
    ))
    trees = GBTRegressor(
        featuresCol="_z", labelCol="_target", predictionCol="_pred",
        maxDepth=config.max_depth, stepSize=config.learning_rate, maxIter=config.n_estimators,
        subsamplingRate=config.subsample, featureSubsetStrategy=str(config.colsample), seed=config.seed,
        checkpointInterval=ROUNDS_PER_CHECKPOINT,
    ).fit(design)
    model = BoostedModel(list(keys), list(xs), scales.withColumn("sigma", F.lit(None).cast("double")), trees)
    fitted = model.predict(rows).groupBy(*keys).agg(F.stddev_pop(F.col(y) - F.col("yhat")).alias("sigma"))
    model.scales = cut_lineage(attach(scales, fitted, keys, ["sigma"]))
    return model


def boosted_nowcast_fit(
    df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str],
    config: BoostConfig = NowcastBoostConfig(),
) -> BoostedModel:
    return boosted_fit(df, keys, y, xs, config)


def boosted_forecast_fit(
    df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], config: BoostConfig = BoostConfig()
) -> BoostedModel:
    return boosted_fit(df, keys, y, xs, config)


def recursive_forecast_boosted(
    model: BoostedModel,
    history: DataFrame,
    specs: Sequence[FeatureSpec],
    target: str = "y",
    horizon: int = 12,
    ds: str = "ds",
    values: DataFrame | None = None,
) -> DataFrame:
    """All series take each step together; the state of a series is one row with a value buffer.

    ``values`` is the gap-filled target up to the last known period, for a ``history`` of feature
    rows from which incomplete ones were dropped: lags count its periods.  The steps are narrow projections on that row, so the whole path is one stage without shuffle.
    """
    keys = model.keys
    by_name = {s.name: s for s in specs}
    used = [by_name[x] for x in model.xs]
    moving = ("target_lag", "target_rolling")
    frozen = [s for s in used if s.kind not in (*moving, "season")]
    dated = [s for s in used if s.kind == "season"]
    fed_back = [s for s in used if s.kind in moving]
    place = {x: i for i, x in enumerate(model.xs)}
    order = [place[s.name] for s in (*frozen, *dated, *fed_back)]

    state = history if values is None else values
    rows = recent_values(state, keys, target, state_depth(used), ds)
    if frozen:
        last = latest_row(history.select(*keys, ds, *[s.name for s in frozen]), keys, ds)
        rows = attach(rows, last, keys, [s.name for s in frozen])
    rows = attach(rows, model.scales, keys, ["_ym", "_ys", "_xm", "_xs"])

    def z(value: Column, s: FeatureSpec) -> Column:
        i = place[s.name]
        return _scale(value.cast("double"), F.col("_xm")[i], F.col("_xs")[i])

    def dated_z(i: Column) -> Column:
        parts = date_features(F.add_months("last_ds", i))
        return F.array(*[z(parts[s.name], s) for s in dated])

    # Everything known before the first step is scaled once: frozen features and all date features.
    rows = rows.withColumns(
        {
            "_fixed": F.array(*[z(F.col(s.name), s) for s in frozen]),
            "_dated": F.transform(F.sequence(F.lit(1), F.lit(horizon)), dated_z),
        }
    ).drop(*[s.name for s in frozen])
    back_to_model = F.array(*[F.lit(order.index(i) + 1) for i in range(len(order))])
    for i in range(horizon):
        values = [
            z(back(F.col("recent"), s.k) if s.kind == "target_lag" else trailing_mean(F.col("recent"), s.k), s)
            for s in fed_back
        ]
        vector = F.concat(F.col("_fixed"), F.col("_dated")[i], F.array(*values))
        if order != sorted(order):
            # The one-element array binds the vector, so it is built once and not per element.
            vector = F.transform(
                F.array(vector),
                lambda v: F.transform(back_to_model, lambda at: F.element_at(v, at)),
            )[0]
        rows = rows.withColumn("_v", vector)
        ready = F.forall("_v", lambda v: v.isNotNull()) & F.col("_ys").isNotNull()
        blank = F.array_repeat(F.lit(0.0), len(order))
        scored = model.trees.transform(
            rows.withColumn("_ready", ready).withColumn(
                "_z", array_to_vector(F.when(F.col("_ready"), F.col("_v")).otherwise(blank))
            )
        )
        value = F.when(F.col("_ready"), F.col("_pred") * F.col("_ys") + F.col("_ym"))
        rows = scored.withColumn("recent", F.array_append("recent", value)).drop(
            "_v", "_z", "_ready", "_pred"
        )
    path = F.slice("recent", -horizon, horizon)
    out = rows.select(*keys, "last_ds", F.posexplode(path).alias("_at", "yhat"))
    return out.select(*keys, F.add_months("last_ds", F.col("_at") + 1).alias("ds"), "yhat")


def gain_importance(model: BoostedModel) -> DataFrame:
    """Normalised gain per feature; as many rows as there are features."""
    spark = model.scales.sparkSession
    rows = [(x, float(v)) for x, v in zip(model.xs, model.trees.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def saved_nodes(model: BoostedModel) -> tuple[DataFrame, list[float]]:
    """Node table of the ensemble, from its saved form, and the tree weights."""
    spark = model.scales.sparkSession
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.trees.write().save(path)
    return spark.read.parquet(f"{path}/data"), list(model.trees.treeWeights)


def split_counts(model: BoostedModel) -> DataFrame:
    """How many splits use each feature, for every feature of the design."""
    nodes, _ = saved_nodes(model)
    spark = nodes.sparkSession
    splits = nodes.select("nodeData.*").filter(F.col("leftChild") >= 0)
    counts = splits.groupBy(F.col("split.featureIndex").alias("at")).agg(
        F.count(F.lit(1)).alias("importance")
    )
    features = spark.createDataFrame(list(enumerate(model.xs)), "at int, feature string")
    return features.join(counts, "at", "left").select(
        "feature", F.coalesce("importance", F.lit(0)).alias("importance")
    )

"""Folds, error metrics, model choice and the tables behind the reports.

Predictions are long: ``(keys..., ds, model, y, yhat)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.operators.shape import attach
from panelcast.operators.windows import from_end, naive_diff

# Fixed value: machine epsilon, the floor of the denominator in the percentage error.
EPS = 2.220446049250313e-16
# Parts of a group that are joined apart.
SALTS = 64


def expanding_folds(
    df: DataFrame, keys: Sequence[str], n_splits: int = 5, test_size: int = 12, ds: str = "ds"
) -> DataFrame:
    """Rows of every expanding-window fold, with ``fold`` and ``split``.

    Fold k of S tests the ``test_size`` rows that end (S-k)*test_size rows before the series end
    and trains on everything before.  The fold bounds are literals, so a row is assigned to its
    folds by an explode and a filter; no theta join.
    """
    bounds = F.array(
        *[
            F.struct(F.lit(k).alias("fold"), F.lit((n_splits - k) * test_size).alias("after"))
            for k in range(1, n_splits + 1)
        ]
    )
    back = df.withColumn("_back", from_end(keys, ds)).withColumn("_fold", F.explode(bounds))
    after = F.col("_fold.after")
    split = F.when(F.col("_back") > after + test_size, "train").otherwise("test")
    return (
        back.filter(F.col("_back") > after)
        .withColumns({"fold": F.col("_fold.fold"), "split": split})
        .drop("_back", "_fold")
    )


def expand_folds(df: DataFrame, folds: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """The same from a table of date bounds ``(fold, test_start, test_end)`` (end is open).

    For bounds that live in a table with a row per fold.  They enter as one array from a scalar
    subquery, and each row is repeated for the folds it belongs to: no join, no job at plan time.
    """
    bounds = folds.agg(F.collect_list(F.struct("fold", "test_start", "test_end"))).scalar()
    rows = df.withColumn("_bounds", bounds)
    rows = rows.withColumn("_f", F.explode(F.filter("_bounds", lambda f: F.col(ds) < f["test_end"])))
    split = F.when(F.col(ds) < F.col("_f.test_start"), "train").otherwise("test")
    return rows.withColumns({"fold": F.col("_f.fold"), "split": split}).drop("_bounds", "_f")


def rolling_cv(
    df: DataFrame,
    keys: Sequence[str],
    fit: Callable[[DataFrame, list[str]], Any],
    predict: Callable[[Any, DataFrame, list[str]], DataFrame],
    n_splits: int = 5,
    test_size: int = 12,
    model: str = "model",
    y: str = "y",
    ds: str = "ds",
    pooled: bool = False,
) -> DataFrame:
    """Out-of-sample predictions ``(keys..., fold, ds, model, y, yhat)`` of a model refitted per fold.

    ``fit(train, keys)`` gives a model and ``predict(model, test, keys)`` the test rows, or rows of
    their dates, with ``yhat``.  Models with one fit per series see the fold as one more key, so all
    folds run in one job.  A model that shares rows between series (``pooled``) would learn one
    fold's test rows from the next fold, so it is fitted fold by fold.  Test rows that the model does
    not reach have a NULL ``yhat``.  Feed ``error_metrics`` and ``fold_summary`` with the result.
    """
    by_fold = [*keys, "fold"]
    folds = expanding_folds(df, keys, n_splits, test_size, ds)

    def score(rows: DataFrame) -> DataFrame:
        fitted = fit(rows.filter("split = 'train'").drop("split"), by_fold)
        test = rows.filter("split = 'test'").drop("split")
        path = predict(fitted, test, by_fold).select(*by_fold, ds, "yhat")
        truth = test.select(*by_fold, ds, F.col(y).alias("y"))
        return truth.join(path, [*by_fold, ds], "left").select(
            *by_fold, ds, F.lit(model).alias("model"), "y", "yhat"
        )

    if not pooled:
        return score(folds)
    out = score(folds.filter("fold = 1"))
    for k in range(2, n_splits + 1):
        out = out.unionByName(score(folds.filter(F.col("fold") == k)))
    return out


def fold_report(folds: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    return folds.groupBy(*keys, "fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ds).alias("first_ds"), F.max(ds).alias("last_ds")
    )


def align_eval(actual: DataFrame, predicted: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """Truth next to prediction, by date; rows without a partner are not scored."""
    return predicted.join(actual, [*keys, ds], "inner")


def _error_exprs() -> list[Column]:
    error = F.col("y") - F.col("yhat")
    scale = F.greatest(F.abs(F.col("y")), F.lit(EPS))
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.abs(error) / scale).alias("mape"),
    ]


def error_metrics(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, MAE and MAPE (a fraction) per series and model."""
    return predicted.groupBy(*keys, "model").agg(*_error_exprs())


def _mase(mae: Column, naive: Column) -> Column:
    return F.when(naive > 0, mae / naive).otherwise(F.lit(0.0))


def metrics_table(
    predicted: DataFrame, keys: Sequence[str], ds: str = "ds", counted: bool = False
) -> DataFrame:
    """All four metrics; the MASE scale is the naive error of the evaluation window.

    ``counted`` adds ``n_scored``, the rows with truth and prediction, which ``best_model`` heeds.
    """
    diffs = naive_diff(predicted, [*keys, "model"], "y", ds)
    n_scored = [F.count(F.col("y") - F.col("yhat")).alias("n_scored")] if counted else []
    out = diffs.groupBy(*keys, "model").agg(
        *_error_exprs(), F.avg("naive_diff").alias("_naive"), *n_scored
    )
    return out.withColumn("mase", _mase(F.col("mae"), F.col("_naive"))).drop("_naive")


def mase(
    predicted: DataFrame,
    keys: Sequence[str],
    scale: str = "test",
    train: DataFrame | None = None,
    ds: str = "ds",
) -> DataFrame:
    """MAE over the mean absolute step of the series in the evaluation or the train window."""
    if scale == "test":
        return metrics_table(predicted, keys, ds).select(*keys, "model", "mase")
    if scale != "train" or train is None:
        raise ValueError("scale is 'test', or 'train' with a train panel")
    naive = naive_diff(train, keys, "y", ds).groupBy(*keys).agg(F.avg("naive_diff").alias("_naive"))
    mae = predicted.groupBy(*keys, "model").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("_mae"))
    return mae.join(naive, list(keys), "left").select(
        *keys, "model", _mase(F.col("_mae"), F.col("_naive")).alias("mase")
    )


def attach_baseline(metrics: DataFrame, keys: Sequence[str], baseline: str) -> DataFrame:
    """``base_rmse`` next to each model of the series; a window, not a self-join."""
    base = F.max(F.when(F.col("model") == baseline, F.col("rmse")))
    return metrics.withColumn("base_rmse", base.over(Window.partitionBy(*keys)))


def gain_vs_baseline(metrics: DataFrame, keys: Sequence[str], baseline: str) -> DataFrame:
    gain = F.try_divide(F.col("base_rmse") - F.col("rmse"), F.col("base_rmse")) * 100
    return attach_baseline(metrics, keys, baseline).withColumn("gain_pct", gain).drop("base_rmse")


def best_model(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest RMSE per series; equal models are ordered by name.

    If the metrics have ``n_scored``, a model that scores fewer rows than another loses to it.  A
    model without a finite RMSE has failed and never wins; a series on which all have failed stays,
    with NULL for its model and its figures.
    """
    failed = F.col("rmse").isNull() | F.isnan("rmse")
    fewer = [-F.col("n_scored")] if "n_scored" in metrics.columns else []
    rank = F.struct(failed, *fewer, "rmse", "model")
    values = [F.when(~failed, F.col(c)).alias(c) for c in metrics.columns if c not in keys]
    return metrics.groupBy(*keys).agg(F.min_by(F.struct(*values), rank).alias("_best")).select(
        *keys, "_best.*"
    )


def residual_sigma(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population deviation of the train residuals."""
    return train.groupBy(*keys).agg(F.stddev_pop(F.col("y") - F.col("yhat")).alias("sigma"))


def fold_summary(metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = ("rmse", "mape")) -> DataFrame:
    exprs = []
    for m in names:
        exprs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return metrics.groupBy(*keys).agg(*exprs)


def residual_histogram(
    df: DataFrame, keys: Sequence[str], col: str = "residual", bins: int = 30
) -> DataFrame:
    """Equal-width counts per group.  The range comes from a partial aggregate and is joined back
    in ``SALTS`` copies, so a group of any size is never sorted or held by one task."""
    rows = df.select(*keys, F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    extent = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    if keys:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        extent = extent.withColumn("_salt", copies)
        rows = attach(rows, extent, [*keys, "_salt"], ["_low", "_high"])
    else:
        rows = attach(rows, extent, keys, ["_low", "_high"])
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_low"), width)), F.lit(0))
    bin_no = F.least(at, F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*keys, bin_no.alias("bin"), "_low", width.alias("_width")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        *keys,
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("bin_end"),
        "n",
    )


def top_features(
    importance: DataFrame, n: int = 10, keys: Sequence[str] = (), score: str = "importance"
) -> DataFrame:
    """Highest scores first; ties by name.  Overall a bounded heap per task, per series a window."""
    order = [F.desc(score), F.asc("feature")]
    if not keys:
        return importance.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return importance.withColumn("rank", rank).filter(F.col("rank") <= n)


def top15_table(importance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return top_features(importance, 15, keys)


def predictions_wide(predicted: DataFrame, keys: Sequence[str], models: Sequence[str], ds: str = "ds") -> DataFrame:
    """One column per model next to the truth, as in the exported detail file."""
    return predicted.groupBy(*keys, ds).agg(
        F.max("y").alias("y"),
        *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models],
    )

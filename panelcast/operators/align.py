"""Mixed frequencies: cut at a day of the month, roll up to months, align with the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.functions.dates import month_floor
from panelcast.functions.spec import FeatureSpec, lag_name
from panelcast.operators.windows import change_exprs, drop_warmup, lags
from panelcast.sources.calendars import gap_fill

DAILY_STATS = ("mean", "std", "last")
WEEKLY_STATS = ("mean", "last")


def cutoff_filter(df: DataFrame, day: int | None, ds: str = "ds") -> DataFrame:
    """What was known on a given day of each month."""
    return df if day is None else df.filter(F.dayofmonth(ds) <= day)


def stat_exprs(cols: Sequence[str], stats: Sequence[str], ds: str = "ds") -> list[Column]:
    """``{col}_{stat}`` aggregates; all skip NULLs, ``last`` is the newest known value."""
    known = {
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ds))),
    }
    return [known[s](c).alias(f"{c}_{s}") for c in cols for s in stats]


def _to_monthly(df, keys, cols, stats, cutoff, ds):
    rows = cutoff_filter(df, cutoff, ds).select(*keys, month_floor(ds).alias("_month"), ds, *cols)
    return (
        rows.groupBy(*keys, "_month")
        .agg(*stat_exprs(cols, stats, ds))
        .withColumnRenamed("_month", ds)
    )


def daily_to_monthly(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], cutoff: int | None = None, ds: str = "ds"
) -> DataFrame:
    return _to_monthly(df, keys, cols, DAILY_STATS, cutoff, ds)


def weekly_to_monthly(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], cutoff: int | None = None, ds: str = "ds"
) -> DataFrame:
    """A week counts for the month of its Sunday label."""
    return _to_monthly(df, keys, cols, WEEKLY_STATS, cutoff, ds)


def cross_params(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """The same rows under several parameter values, in one job and without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def vintage_curve(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    stats: Sequence[str] = DAILY_STATS,
    cutoffs: Sequence[int] = (10, 20, 30),
    ds: str = "ds",
) -> DataFrame:
    """Monthly roll-ups as known on several days of the month, keyed by ``cutoff``."""
    rows = df.select(*keys, month_floor(ds).alias("_month"), ds, *cols)
    vintages = cross_params(rows, "cutoff", cutoffs).filter(F.dayofmonth(ds) <= F.col("cutoff"))
    return (
        vintages.groupBy(*keys, "cutoff", "_month")
        .agg(*stat_exprs(cols, stats, ds))
        .withColumnRenamed("_month", ds)
    )


def _recency(df: DataFrame, keys: Sequence[str], col: str, cutoff: int | None, ds: str) -> DataFrame:
    """Known values of each month numbered from the newest (1); a month has at most 31 of them."""
    rows = cutoff_filter(df, cutoff, ds).filter(F.col(col).isNotNull())
    rows = rows.select(*keys, month_floor(ds).alias("_month"), ds, col)
    newest_first = Window.partitionBy(*keys, "_month").orderBy(F.desc(ds))
    return rows.withColumn("_at", F.row_number().over(newest_first))


def almon_mean(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    weights: Sequence[float] = (1.0, -0.02),
    cutoff: int | None = None,
    ds: str = "ds",
) -> DataFrame:
    """Monthly mean with polynomial weights w(j) = sum_p weights[p] * j^p on the recency j."""
    rows = _recency(df, keys, col, cutoff, ds)
    w = F.lit(0.0)
    for power, factor in enumerate(weights):
        w = w + F.pow(F.col("_at").cast("double"), F.lit(power)) * factor
    total = F.try_divide(F.sum(w * F.col(col)), F.sum(w)).alias(f"{col}_almon")
    return rows.groupBy(*keys, F.col("_month").alias(ds)).agg(total)


def umidas_features(
    df: DataFrame, keys: Sequence[str], col: str, k: int = 5, cutoff: int | None = None, ds: str = "ds"
) -> DataFrame:
    """The newest ``k`` values of each month as separate regressors ``{col}_d1`` (newest) .. ``_dk``."""
    rows = _recency(df, keys, col, cutoff, ds).filter(F.col("_at") <= k)
    return rows.groupBy(*keys, F.col("_month").alias(ds)).agg(
        *[F.max(F.when(F.col("_at") == j, F.col(col))).alias(f"{col}_d{j}") for j in range(1, k + 1)]
    )


def nowcast_feature_specs(
    daily_cols: Sequence[str],
    weekly_cols: Sequence[str],
    target: str = "y",
    target_lags: Sequence[int] = (1, 2, 12),
) -> list[FeatureSpec]:
    levels = [(c, s) for c in daily_cols for s in DAILY_STATS]
    levels += [(c, s) for c in weekly_cols for s in WEEKLY_STATS]
    specs = [FeatureSpec(f"{c}_{s}", "high_freq", c) for c, s in levels]
    specs += [FeatureSpec(f"{c}_{s}_mom", "high_freq", c) for c, s in levels if s != "std"]
    specs += [FeatureSpec(lag_name(target, k), "target_lag", target, k) for k in target_lags]
    return specs


def stack_frequencies(
    target_df: DataFrame,
    keys: Sequence[str],
    target: str = "y",
    daily: tuple[DataFrame, Sequence[str]] | None = None,
    weekly: tuple[DataFrame, Sequence[str]] | None = None,
    ds: str = "ds",
) -> DataFrame:
    """Target months, daily and weekly rows in one table: ``(keys..., ds, target, cols..., is_indicator)``.

    Kept as a stored panel (``sources.store``) it lets ``features_of_stack`` run without a shuffle.
    """
    if daily is None and weekly is None:
        raise ValueError("a daily or a weekly panel is needed")
    stacked = target_df.select(*keys, ds, target, F.lit(None).cast("boolean").alias("is_indicator"))
    for source in (daily, weekly):
        if source is not None:
            frame, cols = source
            rows = frame.select(*keys, ds, *cols, F.lit(True).alias("is_indicator"))
            stacked = stacked.unionByName(rows, allowMissingColumns=True)
    return stacked


def features_of_stack(
    stacked: DataFrame,
    keys: Sequence[str],
    target: str = "y",
    daily_cols: Sequence[str] = (),
    weekly_cols: Sequence[str] = (),
    cutoff: int | None = 20,
    target_lags: Sequence[int] = (1, 2, 12),
    fill_gaps: bool = True,
    ds: str = "ds",
) -> DataFrame:
    """Cut, roll up, align with the target, month-over-month changes, target lags, warm-up drop.

    The stacked rows are rolled up by ONE aggregate (partial sums travel, not rows).  A second,
    month-sized shuffle by series serves the calendar completion and every window after it.
    """
    if cutoff is not None:
        stacked = stacked.filter(F.col("is_indicator").isNull() | (F.dayofmonth(ds) <= cutoff))
    aggregates = [F.max(target).alias(target)]
    levels: list[str] = []
    for cols, stats in ((daily_cols, DAILY_STATS), (weekly_cols, WEEKLY_STATS)):
        aggregates += stat_exprs(cols, stats, ds)
        levels += [f"{c}_{s}" for c in cols for s in stats if s != "std"]
    month = F.when(F.col("is_indicator"), month_floor(ds)).otherwise(F.col(ds))
    monthly = (
        stacked.withColumn("_month", month).groupBy(*keys, "_month")
        .agg(*aggregates, F.max("is_indicator").alias("_hf"))
        .withColumnRenamed("_month", ds)
    )
    if fill_gaps:
        monthly = gap_fill(monthly, keys, ds, "MS")
    changes = change_exprs(levels, keys, ds)
    monthly = monthly.withColumns(
        {name: F.when(F.col("_hf"), change) for name, change in changes.items()}
    ).drop("_hf")
    monthly = lags(monthly, keys, target, target_lags, ds)
    return drop_warmup(monthly, keys, max(target_lags), ds)


def nowcast_features(
    target_df: DataFrame,
    keys: Sequence[str],
    target: str = "y",
    daily: tuple[DataFrame, Sequence[str]] | None = None,
    weekly: tuple[DataFrame, Sequence[str]] | None = None,
    cutoff: int | None = 20,
    target_lags: Sequence[int] = (1, 2, 12),
    fill_gaps: bool = True,
    ds: str = "ds",
) -> DataFrame:
    """``features_of_stack`` from panels of their own: each is cut before it is stacked."""

    def cut(source):
        return source and (cutoff_filter(source[0], cutoff, ds), source[1])

    stacked = stack_frequencies(target_df, keys, target, cut(daily), cut(weekly), ds)
    return features_of_stack(
        stacked, keys, target, daily[1] if daily else (), weekly[1] if weekly else (), None, target_lags,
        fill_gaps, ds,
    )

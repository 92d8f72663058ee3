"""Panels and helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.operators.windows import holdout_split, lags
from panelcast.sources import testdata as td
from panelcast.sources.calendars import gap_fill

KEYS = td.SERIES
DRIVERS = ["production", "policy_rate", "unemployment", "fx", "price_index"]
SHOCKS = ["policy_rate", "fx"]


def digits_of(col: str) -> int:
    """Digits to compare a column at: finer than the decimal grid of its exact values, so that a
    mean does not sit on a rounding tie, and coarser than the noise of its magnitude."""
    if col.startswith(("policy_rate", "unemployment", "fx", "rate")):
        return 10
    if col.endswith("_mom") or col.startswith(("mape", "mase")):
        return 8
    if col.startswith("price_index") or col.endswith(("_sin", "_cos")) or col == "index":
        return 6
    return 2 if col.startswith(("rev_mean", "rev_std")) else 4


def rounded(df: DataFrame, **by_col: int) -> DataFrame:
    """Round all doubles so that summation order does not show; also turns -0.0 into 0.0."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns(
        {c: F.round(F.col(c), by_col.get(c, digits_of(c))) + F.lit(0.0) for c in doubles}
    )


def target(spark: SparkSession, sf: str) -> DataFrame:
    """Nation panel, calendar completed."""
    return gap_fill(td.monthly_wide_panel(spark, sf), KEYS)


def known_target(spark: SparkSession, sf: str) -> DataFrame:
    """Nation panel up to the last full month."""
    panel = td.monthly_wide_panel(spark, sf)
    return gap_fill(panel.filter(F.col("ds") < td.first_open_month(spark, sf)), KEYS)


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """Segment panel of target and drivers, calendar completed."""
    return gap_fill(td.macro_panel(spark, sf), KEYS)


def yardsticks(spark: SparkSession, sf: str, test_size: int = 12) -> DataFrame:
    """Naive and seasonal-naive predictions of the last year, as long predictions."""
    rows = holdout_split(lags(known_target(spark, sf), KEYS, "y", [1, 12]), KEYS, test_size)
    wide = rows.filter("split = 'test' and y is not null").select(
        "series", "ds", "y", F.col("y_lag1").alias("naive"), F.col("y_lag12").alias("seasonal")
    )
    long = wide.unpivot(["series", "ds", "y"], ["naive", "seasonal"], "model", "yhat")
    return long.filter("yhat is not null").select("series", "ds", "model", "y", "yhat")

"""Calendars per series: spines, gaps and future periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.functions.dates import first_on_grid, step


def calendar_spine(
    bounds: DataFrame, start: str, end: str, freq: str, keep: Sequence[str] = (), ds: str = "ds"
) -> DataFrame:
    """One row per calendar point between two date columns of each input row."""
    first = first_on_grid(F.col(start), freq)
    points = F.when(first <= F.col(end), F.sequence(first, F.col(end), step(freq)))
    return bounds.select(*keep, F.explode(points).alias(ds))


def _with_slots(df: DataFrame, keys: Sequence[str], ds: str, freq: str) -> DataFrame:
    """Each row also emits the empty periods up to the next row of its series.

    A window instead of "spine left-joined to the panel": the panel is read and shuffled once,
    and the result stays partitioned by the series keys for the windows that follow.
    """
    following = F.lead(ds).over(Window.partitionBy(*keys).orderBy(ds))
    until = F.coalesce(F.date_sub(following, 1), F.col(ds))
    return df.withColumn("_until", until).select(
        "*", F.explode(F.sequence(F.col(ds), F.col("_until"), step(freq))).alias("_slot")
    )


def gap_fill(df: DataFrame, keys: Sequence[str], ds: str = "ds", freq: str = "MS") -> DataFrame:
    """Complete the calendar of each series; values of added periods are NULL."""
    slots = _with_slots(df, keys, ds, freq)
    present = F.col("_slot") == F.col(ds)
    return slots.select(
        *[
            F.col(c) if c in keys else F.col("_slot").alias(ds) if c == ds
            else F.when(present, F.col(c)).alias(c)
            for c in df.columns
        ]
    )


def missing_periods(df: DataFrame, keys: Sequence[str], ds: str = "ds", freq: str = "MS") -> DataFrame:
    """The periods that ``gap_fill`` would add."""
    slots = _with_slots(df.select(*keys, ds), keys, ds, freq)
    return slots.filter(F.col("_slot") != F.col(ds)).select(*keys, F.col("_slot").alias(ds))


def future_spine(
    df: DataFrame, keys: Sequence[str], horizon: int, ds: str = "ds", freq: str = "MS"
) -> DataFrame:
    """The ``horizon`` periods after the last row of each series, numbered by ``step``."""
    last = df.groupBy(*keys).agg(F.max(ds).alias("_last"))
    if freq == "MS":
        point = F.add_months(F.col("_last"), F.col("step"))
    else:
        point = F.date_add(F.col("_last"), F.col("step") * (1 if freq == "D" else 7))
    return last.select(
        *keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).select(*keys, point.alias(ds), "step")

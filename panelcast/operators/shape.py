"""Side by side, long to wide, and the feature/target split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def assemble_wide(
    panels: Sequence[DataFrame], keys: Sequence[str], ds: str = "ds"
) -> DataFrame:
    """Outer alignment of panels with disjoint value columns on (keys, ds).

    Tagged union and one aggregate.  With one row per (keys, ds) in each input this equals a chain
    of full outer joins, but n inputs cost one shuffle with map-side combine instead of n-1 joins
    whose results have no usable partitioning.
    """
    if not panels:
        raise ValueError("at least one panel is needed")
    index = [*keys, ds]
    seen: set[str] = set()
    for panel in panels:
        values = {c for c in panel.columns if c not in index}
        clash = values & seen
        if clash:
            raise ValueError(f"columns in more than one panel: {sorted(clash)}")
        seen |= values
    stacked = panels[0]
    for panel in panels[1:]:
        stacked = stacked.unionByName(panel, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in index]
    return stacked.groupBy(*index).agg(*[F.max(v).alias(v) for v in values])


def join_frequencies(
    daily_monthly: DataFrame | None,
    weekly_monthly: DataFrame | None,
    keys: Sequence[str],
    ds: str = "ds",
) -> DataFrame:
    """Outer alignment of monthly-ised daily and weekly tables."""
    given = [p for p in (daily_monthly, weekly_monthly) if p is not None]
    if not given:
        raise ValueError("a daily or a weekly panel is needed")
    return assemble_wide(given, keys, ds)


def join_target(
    target: DataFrame, high_freq: DataFrame, keys: Sequence[str], ds: str = "ds"
) -> DataFrame:
    """Outer alignment of target and indicators; indicator-only months are the ones to nowcast."""
    return assemble_wide([target, high_freq], keys, ds)


def series_names(df: DataFrame, key: str, most: int = 1000) -> list[str]:
    """The names of all series, sorted, for columns of a wide table; more than ``most`` are an error."""
    rows = df.select(key).filter(F.col(key).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{key} has more than {most} values; keep the table long")
    return sorted(r[0] for r in rows)


def pivot_series(
    df: DataFrame, key: str, value: str, names: Sequence[str], index: Sequence[str] = ("ds",)
) -> DataFrame:
    """One column per listed series; ``series_names`` finds the list.  A row of a series that is not
    listed is an error when the table is computed, so that no series can disappear."""
    listed = F.col(key).isin(list(names)) | F.col(key).isNull()
    unlisted = F.raise_error(F.concat(F.lit(f"{key} not listed: "), F.col(key).cast("string")))
    wide = df.withColumn(key, F.when(listed, F.col(key)).otherwise(unlisted.cast("string"))).groupBy(*index).agg(
        *[F.max(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names]
    )
    return wide


def melt_series(
    df: DataFrame, cols: Sequence[str], index: Sequence[str], key: str = "series", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(index), list(cols), key, value)


def split_xy(df: DataFrame, target: str, index: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(features, target), both keeping the index columns."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in {df.columns}")
    return df.drop(target), df.select(*index, target)


def known(df: DataFrame, cols: Sequence[str]) -> Column:
    """All columns present (neither NULL nor NaN).

    One predicate per column: each can be pushed down on its own, and the optimizer does not have
    to carry one expression over all of them through every rename.
    """
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            out = out & ~F.isnan(c)
    return out


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.filter(known(df, cols or df.columns))


def doubles(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """The columns as DOUBLE, left alone where they already are."""
    types = dict(df.dtypes)
    return [F.col(c) if types[c] == "double" else F.col(c).cast("double").alias(c) for c in cols]


def incomplete_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows, rows that ``drop_incomplete`` keeps, and rows it drops, per series, in one aggregate."""
    kept = F.sum(known(df, cols).cast("long"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        kept.alias("n_kept"),
        (F.count(F.lit(1)) - kept).alias("n_dropped"),
    )


def order_by_time(df: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """Chronological inside each series and partition, for file output; not a global sort."""
    return df.repartition(*keys).sortWithinPartitions(*keys, ds) if keys else df.orderBy(ds)


def attach(df: DataFrame, per_series: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add columns of a one-row-per-series table; without keys its only row becomes one scalar, so the
    table is computed once whatever the number of columns."""
    if keys:
        return df.join(per_series.select(*keys, *cols), list(keys), "left")
    row = per_series.select(F.struct(*cols)).scalar()
    return df.withColumn("_row", row).withColumns({c: F.col("_row")[c] for c in cols}).drop("_row")

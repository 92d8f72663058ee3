"""Features along time.  All of them share one window, hence one shuffle and one sort per chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelcast.functions.dates import season_exprs, season_form  # noqa: F401 (callers take season_exprs from here)
from panelcast.functions.spec import FeatureSpec, lag_name, rolling_name
from panelcast.operators.shape import drop_incomplete

START, END, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def over_time(keys: Sequence[str], ds: str = "ds") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ds)


def whole(keys: Sequence[str], ds: str = "ds") -> WindowSpec:
    """All rows of the series, on the same partitioning and order as ``over_time``."""
    return over_time(keys, ds).rowsBetween(START, END)


def from_end(keys: Sequence[str], ds: str = "ds") -> Column:
    """1 for the newest row, 2 for the one before, ... without a second, descending sort."""
    return (
        F.count(F.lit(1)).over(whole(keys, ds)) - F.row_number().over(over_time(keys, ds)) + 1
    ).cast("int")


def lags(
    df: DataFrame, keys: Sequence[str], col: str, ks: Sequence[int] = (1, 3, 6, 12), ds: str = "ds"
) -> DataFrame:
    w = over_time(keys, ds)
    return df.withColumns({lag_name(col, k): F.lag(col, k).over(w) for k in ks})


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    windows: Sequence[int] = (3, 6),
    ds: str = "ds",
    shift: int = 0,
) -> DataFrame:
    """Trailing means; ``shift=1`` leaves the current row out, so the value is known ahead."""
    w = over_time(keys, ds)
    return df.withColumns(
        {
            rolling_name(c, n): F.avg(c).over(w.rowsBetween(1 - n - shift, -shift))
            for c in cols
            for n in windows
        }
    )


def shock(df: DataFrame, keys: Sequence[str], col: str, k: int = 12, ds: str = "ds") -> DataFrame:
    change = F.col(col) - F.lag(col, k).over(over_time(keys, ds))
    return df.withColumns({f"{col}_12m_change": change, f"{col}_shock_magnitude": F.abs(change)})


def change_exprs(
    cols: Sequence[str], keys: Sequence[str], ds: str = "ds", fill: str = "pad"
) -> dict[str, Column]:
    if fill not in ("pad", "none"):
        raise ValueError("fill must be 'pad' or 'none'")
    w = over_time(keys, ds)
    out = {}
    for c in cols:
        if fill == "pad":
            now = F.last(c, ignorenulls=True).over(w.rowsBetween(START, HERE))
            before = F.last(c, ignorenulls=True).over(w.rowsBetween(START, -1))
        else:
            now, before = F.col(c), F.lag(c, 1).over(w)
        out[f"{c}_mom"] = F.try_divide(now, before) - 1
    return out


def pct_change(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], ds: str = "ds", fill: str = "pad"
) -> DataFrame:
    """Change on the previous row; ``pad`` compares with the last known value over gaps."""
    return df.withColumns(change_exprs(cols, keys, ds, fill))


def impute_edges(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    ds: str = "ds",
    split: str | None = "split",
    bfill: bool = True,
) -> DataFrame:
    """Forward fill, then the first known value for leading gaps, then zero.

    Runs inside each split so that test rows never see train values and vice versa.  After the
    forward fill only leading gaps are left, so backward fill is the first known value of the
    block: no frame that grows backwards.
    """
    block = [*keys, split] if split else list(keys)
    w = over_time(block, ds)
    exprs = {}
    for c in cols:
        parts = [F.last(c, ignorenulls=True).over(w.rowsBetween(START, HERE))]
        if bfill:
            parts.append(F.first(c, ignorenulls=True).over(whole(block, ds)))
        exprs[c] = F.coalesce(*parts, F.lit(0.0))
    return df.withColumns(exprs)


def deflate(
    df: DataFrame,
    keys: Sequence[str],
    nominal: str,
    index: str,
    base: str | int = "first",
    ds: str = "ds",
    name: str = "real",
) -> DataFrame:
    """Nominal value in prices of the first period, or of the mean index of a base year."""
    if base == "first":
        reference = F.first(index).over(whole(keys, ds))
    elif isinstance(base, int):
        reference = F.avg(F.when(F.year(ds) == base, F.col(index))).over(whole(keys, ds))
    else:
        raise ValueError("base must be 'first' or a year")
    normal = F.try_divide(F.col(index), reference) * 100
    return df.withColumn(name, F.try_divide(F.col(nominal), normal) * 100)


def chain_index(
    df: DataFrame, keys: Sequence[str], rate: str, base: float = 100.0, ds: str = "ds", name: str = "index"
) -> DataFrame:
    """Cumulative product of (1 + rate)."""
    w = over_time(keys, ds).rowsBetween(START, HERE)
    return df.withColumn(name, F.product(1 + F.col(rate)).over(w) * base)


def minmax_scale(
    df: DataFrame, keys: Sequence[str], col: str, ds: str = "ds", name: str | None = None, top: float = 100.0
) -> DataFrame:
    w = whole(keys, ds)
    low, high = F.min(col).over(w), F.max(col).over(w)
    scaled = (F.col(col) - low) / (high - low + 1e-8) * top
    return df.withColumn(name or f"{col}_scaled", F.round(scaled, 2))


def holdout_split(
    df: DataFrame, keys: Sequence[str], test_size: int = 12, ds: str = "ds", name: str = "split"
) -> DataFrame:
    """Last ``test_size`` rows of each series are test."""
    is_test = from_end(keys, ds) <= test_size
    return df.withColumn(name, F.when(is_test, "test").otherwise("train"))


def drop_warmup(df: DataFrame, keys: Sequence[str], rows: int, ds: str = "ds") -> DataFrame:
    """Drop the first ``rows`` rows of each series; other gaps stay."""
    position = F.row_number().over(over_time(keys, ds))
    return df.withColumn("_position", position).filter(F.col("_position") > rows).drop("_position")


def latest_row(df: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """Newest row of each series.  An aggregate with map-side combine: no window, no sort."""
    values = [c for c in df.columns if c not in (*keys, ds)]
    return df.groupBy(*keys).agg(
        F.max(ds).alias(ds), *[F.max_by(c, ds).alias(c) for c in values]
    )


def value_back(
    df: DataFrame, keys: Sequence[str], col: str, k: int, ds: str = "ds", name: str = "value"
) -> DataFrame:
    """The value ``k`` rows from the end (1 is the newest)."""
    return (
        df.select(*keys, ds, col, from_end(keys, ds).alias("_back"))
        .filter(F.col("_back") == k)
        .select(*keys, ds, F.col(col).alias(name))
    )


def naive_diff(df: DataFrame, keys: Sequence[str], y: str = "y", ds: str = "ds") -> DataFrame:
    return df.withColumn(
        "naive_diff", F.abs(F.col(y) - F.lag(y, 1).over(over_time(keys, ds)))
    )


def ar_feature_specs(
    target: str,
    drivers: Sequence[str],
    shocks: Sequence[str] = (),
    ks: Sequence[int] = (1, 3, 6, 12),
    windows: Sequence[int] = (3, 6),
    seasonal: bool | str = True,
) -> list[FeatureSpec]:
    specs = [FeatureSpec(d, "driver", d) for d in drivers]
    specs += [FeatureSpec(rolling_name(d, n), "rolling", d, n) for d in drivers for n in windows]
    for s in shocks:
        specs += [
            FeatureSpec(f"{s}_12m_change", "shock", s),
            FeatureSpec(f"{s}_shock_magnitude", "shock", s),
        ]
    specs += [FeatureSpec(n, "season") for n in season_form(seasonal, "ds")]
    specs += [FeatureSpec(lag_name(target, k), "target_lag", target, k) for k in ks]
    return specs


def ar_features(
    df: DataFrame,
    keys: Sequence[str],
    target: str,
    drivers: Sequence[str],
    shocks: Sequence[str] = (),
    ks: Sequence[int] = (1, 3, 6, 12),
    windows: Sequence[int] = (3, 6),
    shock_lag: int = 12,
    seasonal: bool | str = True,
    shift: int = 0,
    ds: str = "ds",
) -> DataFrame:
    """Lags of the target, trailing means of the drivers, shocks, seasonality, complete rows.

    ``seasonal`` is False, ``cyclical`` (or True) or ``categorical``, twelve month dummies instead of
    waves."""
    out = lags(df, keys, target, ks, ds)
    out = rolling_mean(out, keys, drivers, windows, ds, shift)
    for s in shocks:
        out = shock(out, keys, s, shock_lag, ds)
    season = season_form(seasonal, ds)
    return drop_incomplete(out.withColumns(season) if season else out)

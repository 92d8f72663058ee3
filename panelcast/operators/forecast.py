"""Paths into the future: recursive, direct, flat and growth-rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.functions.dates import date_features
from panelcast.functions.scalars import interval
from panelcast.functions.spec import FeatureSpec
from panelcast.operators.linear import bridge_predict, fit_linear, line_deviation
from panelcast.operators.shape import attach
from panelcast.operators.windows import from_end, latest_row, over_time


def recent_values(
    history: DataFrame, keys: Sequence[str], y: str, depth: int, ds: str = "ds"
) -> DataFrame:
    """``(keys..., last_ds, recent)``: the last ``depth`` target values of each series, oldest first.

    The array is bounded by ``depth``, so one row carries the whole state of a series.
    """
    tail = history.select(*keys, ds, y, from_end(keys, ds).alias("_back")).filter(
        F.col("_back") <= depth
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ds).alias("d"), F.col(y).alias("v"))))
    return tail.groupBy(*keys).agg(F.max(ds).alias("last_ds"), ordered.alias("_pairs")).select(
        *keys, "last_ds", F.transform("_pairs", lambda p: p["v"]).alias("recent")
    )


def state_depth(specs: Sequence[FeatureSpec]) -> int:
    return max([s.k for s in specs if s.kind in ("target_lag", "target_rolling")], default=1)


def back(buffer: Column, k: int) -> Column:
    """k-th value from the end of the buffer, NULL when the history is shorter."""
    return F.try_element_at(buffer, F.lit(-k))


def trailing_mean(buffer: Column, window: int) -> Column:
    size = F.size(buffer)
    part = F.slice(buffer, F.greatest(size - window + 1, F.lit(1)), window)
    known = F.filter(part, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))


def _points(forecast: Column, keys: Sequence[str], rows: DataFrame, name: str) -> DataFrame:
    out = rows.select(*keys, "last_ds", F.posexplode(forecast).alias("_at", name))
    return out.select(*keys, F.add_months("last_ds", F.col("_at") + 1).alias("ds"), name)


def recursive_forecast_linear(
    model: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    specs: Sequence[FeatureSpec],
    target: str = "y",
    horizon: int = 12,
    ds: str = "ds",
) -> DataFrame:
    """Step-by-step forecast of a linear model, all steps inside one projection.

    Lags and target means come from a growing array that starts with the last known values, date
    features from the date of the step, every other feature stays at its last value.
    """
    rows = recent_values(history, keys, target, state_depth(specs), ds)
    frozen = [s for s in specs if s.kind not in ("target_lag", "target_rolling", "season")]
    if frozen:
        last = latest_row(history.select(*keys, ds, *[s.name for s in frozen]), keys, ds)
        rows = attach(rows, last, keys, [s.name for s in frozen])
    rows = attach(rows, model, keys, ["intercept", "coef"])
    place = {s.name: n for n, s in enumerate(specs)}

    def coef(s: FeatureSpec) -> Column:
        return F.col("coef")[place[s.name]]

    constant = F.col("intercept")
    for s in frozen:
        constant = constant + coef(s) * F.col(s.name)
    rows = rows.withColumn("_constant", constant)

    def advance(buffer: Column, i: Column) -> Column:
        value = F.col("_constant")
        date_parts = date_features(F.add_months("last_ds", i))
        for s in specs:
            if s.kind == "target_lag":
                value = value + coef(s) * back(buffer, s.k)
            elif s.kind == "target_rolling":
                value = value + coef(s) * trailing_mean(buffer, s.k)
            elif s.kind == "season":
                value = value + coef(s) * date_parts[s.name]
        return F.concat(buffer, F.array(value))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("recent"), advance)
    return _points(F.slice(grown, -horizon, horizon), keys, rows, "yhat")


def recursive_forecast_ar1(
    model: DataFrame, history: DataFrame, keys: Sequence[str], y: str = "y", horizon: int = 12, ds: str = "ds"
) -> DataFrame:
    """Recursive path of the least-squares AR(1)."""
    last = history.groupBy(*keys).agg(
        F.max(ds).alias("last_ds"), F.max_by(y, ds).alias("_now")
    )
    rows = attach(last, model, keys, ["intercept", "slope"])
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)),
        F.array("_now"),
        lambda b, i: F.concat(b, F.array(F.col("intercept") + F.col("slope") * F.element_at(b, -1))),
    )
    return _points(F.slice(grown, -horizon, horizon), keys, rows, "yhat")


def direct_design(df: DataFrame, keys: Sequence[str], y: str, horizon: int, ds: str = "ds") -> DataFrame:
    """One row per (row, step) with the target ``step`` periods ahead as ``y_ahead``."""
    w = over_time(keys, ds)
    ahead = F.array(*[F.lead(y, h).over(w) for h in range(1, horizon + 1)])
    return df.withColumn("_ahead", ahead).select("*", F.posexplode("_ahead").alias("_at", "y_ahead")).withColumn(
        "step", F.col("_at") + 1
    ).drop("_ahead", "_at")


def direct_forecast_ar1(
    df: DataFrame, keys: Sequence[str], y: str = "y", horizon: int = 12, ds: str = "ds",
    level: float | None = None,
) -> DataFrame:
    """One least-squares line per series and horizon, evaluated at the newest value.

    With a ``level`` each step has the band of its own line's residuals, which widens by itself."""
    rows = direct_design(df.select(*keys, ds, y), keys, y, horizon, ds)
    fits = rows.groupBy(*keys, "step").agg(
        F.regr_intercept("y_ahead", y).alias("intercept"),
        F.regr_slope("y_ahead", y).alias("slope"),
        F.max(ds).alias("_last"),
        F.max_by(y, ds).alias("_now"),
        *([line_deviation("y_ahead", y).alias("sigma")] if level else []),
    )
    scored = fits.select(
        *keys, F.add_months("_last", F.col("step")).alias(ds), "step",
        (F.col("intercept") + F.col("slope") * F.col("_now")).alias("yhat"), *(["sigma"] if level else []),
    )
    return interval(scored, level).drop("sigma") if level else scored


def direct_forecast(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    xs: Sequence[str],
    horizon: int = 12,
    alpha: float = 0.5,
    l1_ratio: float = 0.5,
    ds: str = "ds",
) -> DataFrame:
    """The same with any features: all horizons of all series are fitted in one job."""
    rows = direct_design(df.select(*keys, ds, y, *xs), keys, y, horizon, ds)
    model = fit_linear(rows, [*keys, "step"], "y_ahead", xs, alpha, l1_ratio)
    newest = latest_row(df.select(*keys, ds, *xs), keys, ds).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    scored = bridge_predict(model, newest, [*keys, "step"], xs)
    return scored.select(*keys, F.add_months(ds, F.col("step")).alias(ds), "step", "yhat")


def persistence_forecast(
    df: DataFrame, keys: Sequence[str], y: str = "y", horizon: int = 12, ds: str = "ds"
) -> DataFrame:
    """Flat path at the last known value, starting after the last period of the panel."""
    last = df.groupBy(*keys).agg(
        F.max(ds).alias("_last"),
        F.max_by(y, F.when(F.col(y).isNotNull(), F.col(ds))).alias("yhat"),
    )
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return last.select(*keys, "_last", "yhat", step.alias("step")).select(
        *keys, F.add_months("_last", F.col("step")).alias(ds), "yhat"
    )


def growth_path(
    df: DataFrame,
    keys: Sequence[str],
    nowcast: str = "nowcast",
    base: str = "base",
    horizon: int = 12,
    ds: str = "ds",
) -> DataFrame:
    """From a nowcast at ``ds``: the yearly growth on ``base`` turned into a monthly rate."""
    growth = F.try_divide(F.col(nowcast) - F.col(base), F.col(base))
    monthly = F.pow(1 + growth, F.lit(1.0 / 12)) - 1
    rows = df.select(
        *keys, ds, nowcast, monthly.alias("_rate"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    )
    return rows.select(
        *keys, F.add_months(ds, F.col("step")).alias(ds),
        (F.col(nowcast) * F.pow(1 + F.col("_rate"), F.col("step"))).alias("yhat"),
    )


def append_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    return history.unionByName(forecast, allowMissingColumns=True)


def stitched_series(
    history: DataFrame,
    nowcast: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str],
    y: str = "y",
    ds: str = "ds",
) -> DataFrame:
    """One time line: history, current month with its band, months ahead.

    ``nowcast`` needs ``yhat, lower, upper``; ``forecast`` needs ``yhat``.
    """
    none = F.lit(None).cast("double")

    def part(df: DataFrame, name: str, value: str, low: Column, high: Column) -> DataFrame:
        return df.select(
            *keys, ds, F.lit(name).alias("segment"), F.col(value).alias("value"),
            low.alias("lower"), high.alias("upper"),
        )

    return (
        part(history.filter(F.col(y).isNotNull()), "history", y, none, none)
        .unionByName(part(nowcast, "nowcast", "yhat", F.col("lower"), F.col("upper")))
        .unionByName(part(forecast, "forecast", "yhat", none, none))
    )

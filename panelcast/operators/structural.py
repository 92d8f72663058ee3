"""Trend plus yearly season per series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelcast.functions.dates import month_number
from panelcast.functions.scalars import interval
from panelcast.operators.bands import slope_change_variance
from panelcast.operators.windows import whole

MODES = ("additive", "multiplicative")


def structural_fit(
    df: DataFrame, keys: Sequence[str], y: str = "y", mode: str = "additive", ds: str = "ds"
) -> DataFrame:
    """Linear trend and centred month-of-year means, one row per series.

    One shuffle by series: trend by whole-series windows, then the month means and the residual
    deviation from twelve partial sums per series.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w = whole(keys, ds)
    rows = df.filter(F.col(y).isNotNull()).select(*keys, ds, F.col(y).cast("double").alias("_y"))
    rows = rows.withColumns({"_first": F.min(ds).over(w), "_last": F.max(ds).over(w)})
    rows = rows.withColumn("_t", (month_number(ds) - month_number("_first")).cast("double"))
    rows = rows.withColumns(
        {"_b": F.regr_slope("_y", "_t").over(w), "_a": F.regr_intercept("_y", "_t").over(w)}
    ).withColumn("_trend", F.col("_a") + F.col("_b") * F.col("_t"))
    if mode == "additive":
        rows = rows.withColumns({"_d": F.col("_y") - F.col("_trend"), "_u": F.lit(1.0)})
        # y - trend - s = d - s * 1
        rows = rows.withColumn("_v", F.col("_d"))
    else:
        rows = rows.withColumns(
            {"_d": F.try_divide(F.col("_y"), F.col("_trend")), "_u": F.col("_trend"), "_v": F.col("_y")}
        )
    months = rows.groupBy(*keys, F.month(ds).alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_d").alias("_s"),
        F.sum("_v").alias("_sv"),
        F.sum("_u").alias("_su"),
        F.sum(F.col("_v") * F.col("_v")).alias("_svv"),
        F.sum(F.col("_u") * F.col("_v")).alias("_suv"),
        F.sum(F.col("_u") * F.col("_u")).alias("_suu"),
        *[F.max(c).alias(c) for c in ("_a", "_b", "_first", "_last")],
    )
    level = F.avg("_s")
    series = months.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.max("_a").alias("intercept"),
        F.max("_b").alias("slope"),
        F.max("_first").alias("first_ds"),
        F.max("_last").alias("last_ds"),
        level.alias("_level"),
        F.collect_list(F.struct("_m", "_s", "_n", "_sv", "_su", "_svv", "_suv", "_suu")).alias("_months"),
    )

    def centred(s: Column) -> Column:
        return s - F.col("_level") if mode == "additive" else F.try_divide(s, F.col("_level"))

    def total(term) -> Column:
        return F.aggregate("_months", F.lit(0.0), lambda acc, m: acc + term(m, centred(m["_s"])))

    square = total(lambda m, s: m["_svv"] - 2 * s * m["_suv"] + s * s * m["_suu"])
    mean = total(lambda m, s: m["_sv"] - s * m["_su"]) / F.col("n")
    season = F.map_from_entries(
        F.transform("_months", lambda m: F.struct(m["_m"], centred(m["_s"])))
    )
    return series.select(
        *keys, "n", "first_ds", "last_ds", "intercept", "slope", season.alias("season"),
        F.sqrt(F.greatest(square / F.col("n") - mean * mean, F.lit(0.0))).alias("sigma"),
        F.lit(mode).alias("mode"),
    )


def _model_months(model: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """History and future months of each series, generated from its model row: no join."""
    points = F.sequence(
        F.col("first_ds"), F.add_months(F.col("last_ds"), horizon), F.expr("interval 1 month")
    )
    rows = model.withColumn("ds", F.explode(points))
    return rows.withColumn(
        "_t", (month_number("ds") - month_number("first_ds")).cast("double")
    )


def structural_predict(
    model: DataFrame, keys: Sequence[str], horizon: int = 12, level: float = 0.95
) -> DataFrame:
    """``(keys..., ds, yhat, lower, upper, trend, seasonal)`` over history and ``horizon`` months."""
    rows = _model_months(model, keys, horizon)
    trend = F.col("intercept") + F.col("slope") * F.col("_t")
    seasonal = F.element_at("season", F.month("ds"))
    additive = F.col("mode") == "additive"
    seasonal = F.coalesce(seasonal, F.when(additive, 0.0).otherwise(1.0))
    yhat = F.when(additive, trend + seasonal).otherwise(trend * seasonal)
    out = rows.select(
        *keys, "ds", yhat.alias("yhat"), "sigma", trend.alias("trend"), seasonal.alias("seasonal"),
        (F.col("ds") > F.col("last_ds")).alias("is_future"),
    )
    return interval(out, level).select(
        *keys, "ds", "yhat", "lower", "upper", "trend", "seasonal", "is_future"
    )


def _fourier(days: np.ndarray, order: int) -> np.ndarray:
    """Sine and cosine waves of the day of the year; ``days`` counts from 1970-01-01."""
    date = days.astype("datetime64[D]")
    day_of_year = (date - date.astype("datetime64[Y]")).astype(int) + 1
    angle = 2 * np.pi * day_of_year / 365.25
    return np.stack([f(angle * k) for k in range(1, order + 1) for f in (np.sin, np.cos)], axis=1)


def piecewise_fit(
    df: DataFrame,
    keys: Sequence[str],
    y: str = "y",
    n_knots: int = 25,
    history_share: float = 0.8,
    order: int = 10,
    knot_penalty: float = 1.0,
    wave_penalty: float = 0.01,
    mode: str = "additive",
    ds: str = "ds",
) -> DataFrame:
    """Piecewise-linear trend and Fourier season by ridge, one fit per series.

    Knots lie evenly in the first ``history_share`` of the history; time runs from 0 to 1.  A
    series is bounded by its calendar, so it travels as one row of two arrays, and a task fits the
    series of a whole Arrow batch without a pandas frame per series.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    def fit_one(days: np.ndarray, target: np.ndarray) -> dict:
        span = max(int(days[-1] - days[0]), 1)
        t = (days - days[0]) / span
        n = len(t)
        size = float(np.abs(target).max()) or 1.0
        inside = int(min(n_knots, max(int(n * history_share) - 1, 0)))
        places = np.linspace(0, int(n * history_share) - 1, inside + 1).round().astype(int)[1:]
        knots = t[places]
        hinges = np.maximum(t[:, None] - knots[None, :], 0.0)
        base = np.stack([np.ones(n), t], axis=1)
        straight = np.linalg.lstsq(base, target / size, rcond=None)[0]
        factor = np.ones(n) if mode == "additive" else base @ straight
        design = np.hstack([base, hinges, _fourier(days, order) * factor[:, None]])
        penalty = np.r_[1e-8, 1e-8, np.full(len(knots), knot_penalty), np.full(2 * order, wave_penalty)]
        beta = np.linalg.solve(design.T @ design + np.diag(penalty), design.T @ (target / size))
        cut = 2 + len(knots)
        return {
            "span_days": float(span),
            "intercept": beta[0] * size,
            "slope": beta[1] * size,
            "straight": straight * size,
            "knots": knots,
            "knot_slopes": beta[2:cut] * size,
            "waves": beta[cut:] * (size if mode == "additive" else 1.0),
            "sigma": float((target / size - design @ beta).std() * size),
        }

    names = [*keys, "n", "first_ds", "last_ds"]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [fit_one(d.astype("int64"), v) for d, v in zip(batch["_days"], batch["_values"])]
            found = pd.DataFrame(fits, index=batch.index, columns=[f for f, _ in fields])
            yield pd.concat([batch[names], found], axis=1)

    doubles = T.ArrayType(T.DoubleType())
    fields = [(c, T.DoubleType()) for c in ("span_days", "intercept", "slope")]
    fields += [(c, doubles) for c in ("straight", "knots", "knot_slopes", "waves")]
    fields += [("sigma", T.DoubleType())]
    points = F.array_sort(F.collect_list(F.struct(F.unix_date(ds).alias("d"), F.col(y).cast("double").alias("v"))))
    series = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(ds).alias("first_ds"), F.max(ds).alias("last_ds"),
        points.alias("_points"),
    )
    arrays = series.select(
        *names, F.col("_points.d").alias("_days"), F.col("_points.v").alias("_values")
    )
    schema = T.StructType([arrays.schema[c] for c in names] + [T.StructField(c, t) for c, t in fields])
    return arrays.mapInPandas(fit, schema).withColumn("mode", F.lit(mode))


def piecewise_predict(
    model: DataFrame, keys: Sequence[str], horizon: int = 12, level: float = 0.95, widen: bool = False
) -> DataFrame:
    """Same output as ``structural_predict``; evaluated in columns from the coefficient arrays.

    ``widen`` lets the trend bend on: every future month changes the slope as often and as much as the
    months of the history did on average, in the fit's own (shrunk) slope changes.
    """
    rows = _model_months(model, keys, horizon).withColumn(
        "_t", F.datediff("ds", "first_ds") / F.col("span_days")
    )
    bends = F.aggregate(
        F.zip_with("knots", "knot_slopes", lambda k, b: b * F.greatest(F.col("_t") - k, F.lit(0.0))),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    trend = F.col("intercept") + F.col("slope") * F.col("_t") + bends
    angle = F.dayofyear("ds") * (2 * math.pi / 365.25)

    def wave(coef: Column, i: Column) -> Column:
        turn = angle * (F.floor(i / 2) + 1)
        return coef * F.when(i % 2 == 0, F.sin(turn)).otherwise(F.cos(turn))

    additive = F.col("mode") == "additive"
    season = F.aggregate(F.transform("waves", wave), F.lit(0.0), lambda acc, v: acc + v)
    line = F.element_at("straight", 1) + F.element_at("straight", 2) * F.col("_t")
    effect = F.when(additive, season).otherwise(season * line)
    if widen:
        step = F.greatest(month_number("ds") - month_number("last_ds"), F.lit(0))
        months = F.months_between("last_ds", "first_ds") + 1
        squares = F.aggregate("knot_slopes", F.lit(0.0), lambda acc, b: acc + b * b)
        # Changes per month times their mean square is their sum of squares per month; slopes are per
        # span of the history, which a month is a part of.
        per_month = F.try_divide(squares, months)
        part = F.try_divide(F.lit(1.0), F.greatest(months - 1, F.lit(1.0)))
        bent = slope_change_variance(per_month, part * part, step)
        rows = rows.withColumn("sigma", F.sqrt(F.col("sigma") * F.col("sigma") + bent))
    out = rows.select(
        *keys, "ds", (trend + effect).alias("yhat"), "sigma", trend.alias("trend"),
        season.alias("seasonal"), (F.col("ds") > F.col("last_ds")).alias("is_future"),
    )
    return interval(out, level).select(
        *keys, "ds", "yhat", "lower", "upper", "trend", "seasonal", "is_future"
    )

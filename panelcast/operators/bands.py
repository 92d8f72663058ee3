"""Forecast bands that widen with the horizon, from the model's own dynamics.

A recursive forecast repeats its past errors: the error at step h is the sum of the h shocks since the
end of the history, each times the weight that the lags give it by then.  A trend may bend again: each
month ahead may add a slope change of the size that the history has shown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.config import Z_BY_LEVEL
from panelcast.functions.spec import FeatureSpec
from panelcast.operators.shape import attach


def shock_weights(lags: Sequence[tuple[int, Column]], horizon: int) -> Column:
    """Array of ``horizon`` weights: what a shock adds to the target 0, 1, 2, ... periods later, by the
    recursion w_0 = 1, w_j = sum of coef_k * w_(j-k) over the lags k."""

    def grow(weights: Column, _: Column) -> Column:
        parts = [c * F.coalesce(F.try_element_at(weights, F.lit(-k)), F.lit(0.0)) for k, c in lags]
        return F.concat(weights, F.array(sum(parts[1:], parts[0]) if parts else F.lit(0.0)))

    if horizon == 1:
        return F.array(F.lit(1.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon - 1)), F.array(F.lit(1.0)), grow)


def growing_deviation(weights: Column, step: Column) -> Column:
    """Deviation of the error at ``step`` in units of one shock's."""
    squares = F.transform(F.slice(weights, F.lit(1), step), lambda w: w * w)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def slope_change_variance(rate: Column, mean_square: Column, step: Column) -> Column:
    """Variance of a trend ``step`` periods ahead if every period from now on changes its slope with
    probability ``rate`` by a change of mean square ``mean_square``: a change made i periods before
    moves the trend by i times its size, so it is rate * mean_square * (1 + 4 + ... + step^2)."""
    h = step.cast("double")
    return rate * mean_square * h * (h + 1) * (2 * h + 1) / 6


def steps_ahead(paths: DataFrame, keys: Sequence[str], ds: str = "ds", name: str = "step") -> DataFrame:
    """1, 2, ... along the path of each series, which has a row for every period."""
    by = Window.partitionBy(*keys).orderBy(ds) if keys else Window.partitionBy(F.lit(0)).orderBy(ds)
    return paths.withColumn(name, F.row_number().over(by))


def with_band(df: DataFrame, deviation: Column, level: float, yhat: str = "yhat") -> DataFrame:
    if level not in Z_BY_LEVEL:
        raise ValueError(f"interval level must be one of {sorted(Z_BY_LEVEL)}, got {level}")
    margin = deviation * Z_BY_LEVEL[level]
    return df.withColumns({"lower": F.col(yhat) - margin, "upper": F.col(yhat) + margin})


def ar1_band(paths: DataFrame, model: DataFrame, keys: Sequence[str], horizon: int = 12, level: float = 0.95, ds: str = "ds") -> DataFrame:
    """``(keys..., ds, yhat, lower, upper)`` for the path of ``recursive_forecast_ar1``; the model comes from
    ``ar1_fit(spread=True)``."""
    rows = attach(steps_ahead(paths, keys, ds), model, keys, ["slope", "sigma"])
    grown = growing_deviation(shock_weights([(1, F.col("slope"))], horizon), F.col("step"))
    return with_band(rows, F.col("sigma") * grown, level).select(*keys, ds, "yhat", "lower", "upper")


def lag_coefficients(specs: Sequence[FeatureSpec]) -> list[tuple[int, Column]]:
    """(lag, coefficient) of a linear model in the order of ``specs``: a trailing mean over k values of
    the target is k lags with a k-th of its coefficient each."""
    parts: dict[int, list[Column]] = {}
    for i, s in enumerate(specs):
        if s.kind == "target_lag":
            parts.setdefault(s.k, []).append(F.col("coef")[i])
        elif s.kind == "target_rolling":
            for k in range(1, s.k + 1):
                parts.setdefault(k, []).append(F.col("coef")[i] / s.k)
    return [(k, sum(found[1:], found[0])) for k, found in sorted(parts.items())]


def linear_band(
    paths: DataFrame, model: DataFrame, keys: Sequence[str], specs: Sequence[FeatureSpec],
    horizon: int = 12, level: float = 0.95, ds: str = "ds",
) -> DataFrame:
    """The same for the path of ``recursive_forecast_linear`` of a model of ``fit_linear``.

    The residual deviation is corrected for the coefficients that were fitted.  Features that the
    recursion freezes are taken as known; a 'short' series has no band.
    """
    rows = attach(steps_ahead(paths, keys, ds), model, keys, ["coef", "sigma", "n"])
    free = F.greatest(F.col("n") - len(specs) - 1, F.lit(1))
    shock = F.col("sigma") * F.sqrt(F.col("n") / free)
    grown = growing_deviation(shock_weights(lag_coefficients(specs), horizon), F.col("step"))
    return with_band(rows, shock * grown, level).select(*keys, ds, "yhat", "lower", "upper")

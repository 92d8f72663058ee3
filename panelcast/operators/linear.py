"""Linear bridge models: per series from aggregated moments, pooled through spark.ml.

A linear fit needs only means, variances and covariances.  Spark aggregates those per series with
map-side combine; the small systems are then solved in batches over the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelcast.functions.scalars import interval
from panelcast.operators.shape import attach, doubles, drop_incomplete
from panelcast.operators.windows import lags, whole
from panelcast.session import cut_lineage

MAX_SWEEPS = 5000
TOLERANCE = 1e-12


def standardize(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    train: Column | None = None,
    ds: str = "ds",
    suffix: str = "_z",
) -> DataFrame:
    """Z-scores with the population deviation of the train rows of each series."""
    w = whole(keys, ds)
    used = F.lit(True) if train is None else train
    out = {}
    for c in cols:
        seen = F.when(used, F.col(c))
        sd = F.stddev_pop(seen).over(w)
        out[f"{c}{suffix}"] = (F.col(c) - F.avg(seen).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return df.withColumns(out)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def moments(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per series: count, means, and population covariances of complete rows.

    Designs of any width take this path.  The partial states are p*p/2 covariances however long a
    series is, and Spark merges them before and after the one shuffle.
    """
    p = len(xs)
    rows = drop_incomplete(df.select(*keys, *doubles(df, [y, *xs])), [y, *xs])
    pairs = _pairs(p)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("y_mean"),
        F.var_pop(y).alias("y_var"),
        F.array(*[F.avg(x) for x in xs]).alias("x_mean"),
        F.array(*[F.covar_pop(xs[i], xs[j]) for i, j in pairs]).alias("cov"),
        F.array(*[F.covar_pop(x, y) for x in xs]).alias("cov_xy"),
    )


def solve_penalized(
    cov: np.ndarray, cov_xy: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray | None = None
) -> np.ndarray:
    """Coefficients on the z-scored features for many series at once; ``start`` is where a descent begins.

    Minimises 1/(2n)|y - Zw|^2 + alpha*l1_ratio*|w|_1 + alpha*(1-l1_ratio)/2*|w|^2 from the
    correlation-scaled moments, ``cov`` (s, p, p) and ``cov_xy`` (s, p).
    """
    p = cov.shape[1]
    if alpha == 0:
        return np.stack([np.linalg.lstsq(c, b, rcond=None)[0] for c, b in zip(cov, cov_xy)])
    ridge = alpha * (1 - l1_ratio)
    if l1_ratio == 0:
        return np.linalg.solve(cov + ridge * np.eye(p), cov_xy[..., None])[..., 0]
    w = np.zeros_like(cov_xy) if start is None else start.copy()
    diagonal = np.einsum("sii->si", cov) + ridge
    for _ in range(MAX_SWEEPS):
        moved = np.zeros(len(w))
        for j in range(p):
            rest = cov_xy[:, j] - np.einsum("sk,sk->s", cov[:, j, :], w) + cov[:, j, j] * w[:, j]
            new = np.sign(rest) * np.maximum(np.abs(rest) - alpha * l1_ratio, 0.0)
            new = np.divide(new, diagonal[:, j], out=np.zeros_like(new), where=diagonal[:, j] > 0)
            moved = np.maximum(moved, np.abs(new - w[:, j]))
            w[:, j] = new
        if np.all(moved <= TOLERANCE * np.maximum(1.0, np.abs(w).max(axis=1))):
            break
    return w


def fit_linear(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    xs: Sequence[str],
    alpha: float = 1.0,
    l1_ratio: float = 0.5,
) -> DataFrame:
    """One penalised regression per series on z-scored features.

    Returns ``(keys..., n, intercept, coef, x_mean, sigma, status)``; coefficients are on the
    original scale in the order of ``xs``, ``sigma`` is the population deviation of the train
    residuals.  A series with fewer than p + 2 complete rows gets status 'short' and NULLs.
    """
    p = len(xs)
    upper = _pairs(p)
    at = {pair: n for n, pair in enumerate(upper)}
    square = [at[min(i, j), max(i, j)] for i in range(p) for j in range(p)]
    key_names = list(keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*key_names, "n", "x_mean"]].copy()
            out["intercept"], out["sigma"] = np.nan, np.nan
            out["coef"], out["status"] = None, "short"
            ready = (batch["n"] >= p + 2).to_numpy()
            if ready.any():
                part = batch[ready]
                cov = np.stack(part["cov"].to_numpy())[:, square].reshape(-1, p, p)
                cxy = np.stack(part["cov_xy"].to_numpy())
                mean = np.stack(part["x_mean"].to_numpy())
                sd = np.sqrt(np.einsum("sii->si", cov))
                sd[sd == 0] = 1.0
                w = solve_penalized(
                    cov / sd[:, :, None] / sd[:, None, :], cxy / sd, alpha, l1_ratio
                )
                coef = w / sd
                unexplained = (
                    part["y_var"].to_numpy()
                    - 2 * np.einsum("si,si->s", coef, cxy)
                    + np.einsum("si,sij,sj->s", coef, cov, coef)
                )
                where = np.flatnonzero(ready)
                out.iloc[where, out.columns.get_loc("intercept")] = part["y_mean"].to_numpy() - np.einsum(
                    "si,si->s", coef, mean
                )
                out.iloc[where, out.columns.get_loc("sigma")] = np.sqrt(np.maximum(unexplained, 0))
                out.iloc[where, out.columns.get_loc("status")] = "ok"
                coefs = out["coef"].to_list()
                for row, c in zip(where, coef):
                    coefs[row] = c
                out["coef"] = coefs
            yield out[[*key_names, "n", "intercept", "coef", "x_mean", "sigma", "status"]]

    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coef", doubles),
            T.StructField("x_mean", doubles),
            T.StructField("sigma", T.DoubleType()),
            T.StructField("status", T.StringType()),
        ]
    )
    solved = moments(df, keys, y, xs).mapInPandas(solve, schema)
    # Pandas has no NULL for doubles: a short series comes back as NaN.
    return solved.withColumns(
        {c: F.when(F.col("status") == "ok", F.col(c)) for c in ("intercept", "coef", "sigma")}
    )


def bridge_fit(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], alpha: float = 1.0, l1_ratio: float = 0.5) -> DataFrame:
    """Elastic-net bridge equation per series."""
    return fit_linear(df, keys, y, xs, alpha, l1_ratio)


def ar_baseline_fit(
    df: DataFrame, keys: Sequence[str], y: str, lag_cols: Sequence[str], alpha: float = 1.0
) -> DataFrame:
    """Ridge on the target lags only: the pure-forecast yardstick."""
    return fit_linear(df, keys, y, lag_cols, alpha, l1_ratio=0.0)


def bridge_predict(
    model: DataFrame, df: DataFrame, keys: Sequence[str], xs: Sequence[str], yhat: str = "yhat"
) -> DataFrame:
    """Adds the prediction and the residual deviation of the model of each series."""
    needed = {"intercept", "coef", "sigma"}
    if not needed <= set(model.columns):
        raise ValueError(f"not a fitted model table, needs columns {sorted(needed)}")
    terms = F.col("intercept")
    for i, x in enumerate(xs):
        terms = terms + F.col("coef")[i] * F.col(x)
    joined = attach(df, model, keys, ["intercept", "coef", "sigma"])
    return joined.withColumn(yhat, terms).drop("intercept", "coef")


def predict_with_interval(
    model: DataFrame, df: DataFrame, keys: Sequence[str], xs: Sequence[str], level: float = 0.95
) -> DataFrame:
    return interval(bridge_predict(model, df, keys, xs), level)


def line_deviation(y: str, x: str) -> Column:
    """Residual deviation of the least-squares line of y on x, two degrees of freedom taken."""
    left = F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x))
    return F.when(F.regr_count(y, x) > 2, F.sqrt(F.greatest(left, F.lit(0.0)) / (F.regr_count(y, x) - 2)))


def ar1_fit(
    df: DataFrame, keys: Sequence[str], y: str = "y", ds: str = "ds", spread: bool = False
) -> DataFrame:
    """Least-squares y on its own previous value, as plain aggregates; ``spread`` adds the residual
    deviation as ``sigma``."""
    rows = lags(df.select(*keys, ds, y), keys, y, [1], ds)
    return rows.groupBy(*keys).agg(
        F.regr_intercept(y, f"{y}_lag1").alias("intercept"),
        F.regr_slope(y, f"{y}_lag1").alias("slope"),
        F.regr_count(y, f"{y}_lag1").alias("n"),
        *([line_deviation(y, f"{y}_lag1").alias("sigma")] if spread else []),
    )


@dataclass
class PooledBridge:
    """One elastic net over all series, from spark.ml, on original-scale columns."""

    xs: list[str]
    intercept: float
    coef: list[float]
    sigma: float

    def predict(self, df: DataFrame, yhat: str = "yhat") -> DataFrame:
        total = F.lit(self.intercept)
        for x, c in zip(self.xs, self.coef):
            total = total + F.col(x) * c
        return df.withColumns({yhat: total, "sigma": F.lit(self.sigma)})


def bridge_fit_pooled(
    df: DataFrame, y: str, xs: Sequence[str], alpha: float = 1.0, l1_ratio: float = 0.5
) -> PooledBridge:
    """Same objective for all series together.

    spark.ml penalises on a label scaled to unit deviation, so the textbook pair (alpha, l1_ratio)
    is re-expressed for it.  The rows are written once, since scaling, fit and residuals each read
    them.  The driver sees 2p + 2 numbers for the scaling and p + 1 for the fit.
    """
    rows = cut_lineage(drop_incomplete(df.select(*doubles(df, [y, *xs]))))
    scale = rows.agg(
        F.stddev_pop(y).alias("_sy"),
        *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)],
        *[F.stddev_pop(x).alias(f"_s{i}") for i, x in enumerate(xs)],
    ).first()
    means = [scale[f"_m{i}"] for i in range(len(xs))]
    sds = [scale[f"_s{i}"] or 1.0 for i in range(len(xs))]
    design = rows.select(
        F.col(y).alias("_y"),
        array_to_vector(F.array(*[(F.col(x) - m) / s for x, m, s in zip(xs, means, sds)])).alias("_z"),
    )
    reg = alpha * l1_ratio + alpha * (1 - l1_ratio) * scale["_sy"]
    model = LinearRegression(
        featuresCol="_z", labelCol="_y", solver="normal", standardization=False,
        regParam=reg, elasticNetParam=alpha * l1_ratio / reg if reg else 0.0,
        maxIter=MAX_SWEEPS, tol=1e-10,
    ).fit(design)
    coef = [float(c) / s for c, s in zip(model.coefficients, sds)]
    intercept = float(model.intercept) - sum(c * m for c, m in zip(coef, means))
    pooled = PooledBridge(list(xs), intercept, coef, 0.0)
    sigma = pooled.predict(rows).agg(F.stddev_pop(F.col(y) - F.col("yhat"))).first()[0]
    pooled.sigma = float(sigma)
    return pooled


def coefficient_table(model: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Model rows to ``(keys..., feature, coef)``."""
    names = F.array(*[F.lit(x) for x in xs])
    return model.filter(F.col("status") == "ok").select(
        *keys, F.explode(F.arrays_zip(names.alias("feature"), F.col("coef"))).alias("_c")
    ).select(*keys, F.col("_c.feature").alias("feature"), F.col("_c.coef").alias("coef"))

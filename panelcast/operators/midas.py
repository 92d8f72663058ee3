"""Fitted weights of a high frequency: a polynomial over the recency of the days, or free lags.

Both are least squares on monthly regressors, so a series is fitted from its moments; see ``linear``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelcast.functions.dates import month_floor
from panelcast.operators.linear import _pairs, fit_linear, moments
from panelcast.operators.vintages import asof_join

#: Ends at which a weight polynomial may be held at zero: before the newest value, behind the oldest.
ENDS = ("near", "far")


def recent_days(
    target: DataFrame, daily: DataFrame, keys: Sequence[str], col: str, k: int, cutoff: int | None = None, ds: str = "ds"
) -> DataFrame:
    """target with ``{col}_recent``: the newest ``k`` known values of ``col`` up to the cut-off day of each
    target month (its end without one), newest first, across month ends; shorter at a series' start.

    A window gathers each day's array, a second one carries the last before each month's day forward:
    days are never multiplied by months.
    """
    known = daily.filter(F.col(col).isNotNull()).select(*keys, F.col(ds).alias("_day"), F.col(col).cast("double").alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_day").rowsBetween(1 - k, Window.currentRow)
    arrays = known.withColumn(f"{col}_recent", F.reverse(F.collect_list("_v").over(w)))
    month_end = F.last_day(ds)
    at = month_end if cutoff is None else F.least(F.date_add(month_floor(ds), cutoff - 1), month_end)
    return asof_join(target.withColumn("_at", at), arrays, keys, "_at", "_day", [f"{col}_recent"]).drop("_at")


def almon_design(rows: DataFrame, col: str, k: int, degree: int = 2, ends: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Power sums of the recent values, ``{col}_p0`` .. ``{col}_p{degree}``: sum over j of u^p x_j with the
    recency u = j / k of the j-th newest value; rows with fewer than ``k`` values have NULLs.

    Held ends take columns away: the weight is zero at u = 0 without the constant, and at the place
    behind the oldest value, u = (k + 1) / k, with the remaining columns less the first one's share.
    """
    unknown = set(ends) - set(ENDS)
    if unknown:
        raise ValueError(f"ends are {ENDS}")
    powers = list(range(1 if "near" in ends else 0, degree + 1))
    if "far" in ends and len(powers) < 2:
        raise ValueError("a polynomial held at its ends needs a higher degree")
    recent, behind = F.col(f"{col}_recent"), (k + 1) / k

    def power_sum(p: int):
        terms = F.transform(recent, lambda x, j: x * F.pow((j + 1).cast("double") / k, F.lit(float(p))))
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)

    columns = {}
    first = powers[0]
    for p in powers[1:] if "far" in ends else powers:
        value = power_sum(p)
        if "far" in ends:
            value = value - behind ** (p - first) * power_sum(first)
        columns[f"{col}_p{p}"] = F.when(F.size(recent) == k, value)
    return rows.withColumns(columns), list(columns)


def almon_fit(
    target: DataFrame, daily: DataFrame, keys: Sequence[str], y: str, col: str, k: int = 20, degree: int = 2,
    ends: Sequence[str] = (), cutoff: int | None = None, ds: str = "ds",
) -> DataFrame:
    """``(keys..., n, intercept, theta, sigma, status, weights)``: y on a weighted sum of the newest ``k``
    values, weights a polynomial of the recency with estimated coefficients ``theta`` (by rising power;
    held ends included).  ``weights[j - 1]`` belongs to the j-th newest value.
    """
    rows = recent_days(target.select(*keys, ds, y), daily, keys, col, k, cutoff, ds)
    design, xs = almon_design(rows, col, k, degree, ends)
    model = fit_linear(design, keys, y, xs, 0.0, 0.0)
    first, behind = (1 if "near" in ends else 0), (k + 1) / k
    theta = []
    for p in range(degree + 1):
        name = f"{col}_p{p}"
        if name in xs:
            theta.append(F.col("coef")[xs.index(name)])
        elif p == first and "far" in ends:
            shares = [F.col("coef")[i] * -(behind ** (int(x.rsplit("_p", 1)[1]) - first)) for i, x in enumerate(xs)]
            theta.append(sum(shares[1:], shares[0]))
        else:
            theta.append(F.when(F.col("coef").isNotNull(), F.lit(0.0)))
    weight = lambda j: sum(
        (F.col("theta")[p] * F.pow(j / k, F.lit(float(p))) for p in range(1, degree + 1)), F.col("theta")[0]
    )
    out = model.select(*keys, "n", "intercept", F.array(*theta).alias("theta"), "sigma", "status")
    out = out.withColumn("theta", F.when(F.col("status") == "ok", F.col("theta")))
    places = F.sequence(F.lit(1), F.lit(k))
    return out.withColumn("weights", F.when(F.col("status") == "ok", F.transform(places, lambda j: weight(j.cast("double")))))


def umidas_lags(rows: DataFrame, col: str, k: int) -> DataFrame:
    """``{col}_d1`` (newest) .. ``{col}_d{k}`` as columns; rows with fewer values have NULLs."""
    recent = F.col(f"{col}_recent")
    return rows.withColumns({f"{col}_d{j}": F.when(F.size(recent) == k, recent[j - 1]) for j in range(1, k + 1)})


def umidas_orders(
    target: DataFrame, daily: DataFrame, keys: Sequence[str], y: str, col: str, most: int = 10,
    cutoff: int | None = None, ds: str = "ds",
) -> DataFrame:
    """``(keys..., k, n, bic, intercept, coef, sigma, is_best)``: y on the newest k values, for k = 0 .. ``most``.

    All fits use the rows that have ``most`` values, so their criteria compare.  One Cholesky factor of
    the values' covariance serves every k: what the k-th value explains beyond the ones before is the
    square of the k-th entry of the forward solution.  BIC is n log(squares / n) + (k + 1) log n.  Values that the
    ones before determine explain nothing more; from there on k has no fit.  A series with fewer than
    ``most`` + 2 complete rows has no rows here.
    """
    xs = [f"{col}_d{j}" for j in range(1, most + 1)]
    rows = umidas_lags(recent_days(target.select(*keys, ds, y), daily, keys, col, most, cutoff, ds), col, most)
    upper = _pairs(most)
    at = {pair: i for i, pair in enumerate(upper)}
    square = [at[min(i, j), max(i, j)] for i in range(most) for j in range(most)]
    key_names = list(keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in [*key_names, "k", "n", "bic", "intercept", "coef", "sigma", "is_best"]}
            for _, row in batch[batch["n"] >= most + 2].iterrows():
                n, x_mean, cxy = int(row["n"]), np.asarray(row["x_mean"]), np.asarray(row["cov_xy"])
                cov = np.asarray(row["cov"])[square].reshape(most, most)
                factor, forward, usable = np.zeros((most, most)), np.zeros(most), most
                for k in range(most):
                    part = np.linalg.solve(factor[:k, :k], cov[:k, k]) if k else np.zeros(0)
                    left = cov[k, k] - part @ part
                    if left <= 1e-10 * max(cov[k, k], 1e-300):
                        usable = k
                        break
                    factor[k, :k], factor[k, k] = part, np.sqrt(left)
                    forward[k] = (cxy[k] - part @ forward[:k]) / factor[k, k]
                squares = np.maximum(row["y_var"] - np.r_[0.0, np.cumsum(forward[:usable] ** 2)], 1e-14 * max(row["y_var"], 1e-300))
                bic = n * np.log(squares) + (np.arange(usable + 1) + 1) * np.log(n)
                for k in range(usable + 1):
                    coef = np.linalg.solve(factor[:k, :k].T, forward[:k]) if k else np.zeros(0)
                    for name in key_names:
                        out[name].append(row[name])
                    for name, value in (
                        ("k", k), ("n", n), ("bic", float(bic[k])), ("intercept", float(row["y_mean"] - coef @ x_mean[:k])),
                        ("coef", coef), ("sigma", float(np.sqrt(squares[k]))), ("is_best", k == int(np.argmin(bic))),
                    ):
                        out[name].append(value)
            yield pd.DataFrame(out)

    schema = T.StructType([target.schema[c] for c in key_names] + [
        T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("bic", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("sigma", T.DoubleType()), T.StructField("is_best", T.BooleanType()),
    ])
    return moments(rows, keys, y, xs).mapInPandas(solve, schema)

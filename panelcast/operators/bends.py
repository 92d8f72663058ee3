"""Trends that change slope at a few dates: a lasso over all possible bends, then the ones worth keeping.

Every period may be a bend: a column that is zero up to it and then grows with time.  That matrix is
never built.  What all its columns say about a residual comes from two cumulative sums, and only the
few bends in use have columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from panelcast.functions.dates import month_number
from panelcast.functions.scalars import interval

#: Penalties tried, as shares of the smallest one that allows no bend.
SHARES = tuple(0.5 * 0.6**i for i in range(14))
#: Periods at both ends in which no bend is looked for.
MARGIN = 3


def bend_products(t: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """For each period j the product of the residual with the bend there: sum over later i of
    (t_i - t_j) r_i, for all j at once by cumulative sums from the end."""
    late = np.cumsum(residual[::-1])[::-1]
    timed = np.cumsum((t * residual)[::-1])[::-1]
    return timed - t * late


def bend_columns(t: np.ndarray, at: Sequence[int]) -> np.ndarray:
    return np.maximum(t[:, None] - t[list(at)][None, :], 0.0)


def bend_lasso(
    t: np.ndarray, y: np.ndarray, free: np.ndarray, penalty: float, places: np.ndarray,
    start: dict[int, float] | None = None,
) -> dict[int, float]:
    """Slope changes {place: size} that minimise half the squares plus ``penalty`` times their absolute sum;
    the columns of ``free`` (level, slope, season) are not penalised.

    One bend enters at a time, the one that the residual asks for most; then the bends in use are solved
    for exactly under their signs.  A solution that turns a sign is followed only as far as that bend's
    zero, where the bend leaves.
    """
    basis = np.linalg.qr(free)[0]
    clear = lambda v: v - basis @ (basis.T @ v)
    target = clear(y)
    used = dict(start or {})
    scale = np.abs(bend_products(t, target)[places]).max(initial=0.0)
    for _ in range(20 * len(t)):
        while used:
            at = list(used)
            columns = clear(bend_columns(t, at))
            now = np.array([used[j] for j in at])
            # A bend that has just entered has no size yet: its sign is that of its product.
            signs = np.sign(now)
            fresh = signs == 0
            if fresh.any():
                signs[fresh] = np.sign(columns.T @ (target - columns @ now))[fresh]
            goal = np.linalg.lstsq(columns.T @ columns, columns.T @ target - penalty * signs, rcond=None)[0]
            turned = np.flatnonzero((np.sign(goal) != signs) & ~fresh)
            if fresh.any() and (np.sign(goal) != signs)[fresh].any():
                used = {j: v for j, v in used.items() if v}  # it would enter the wrong way: numerical noise
                return used
            if not len(turned):
                used = dict(zip(at, goal.tolist()))
                break
            share = now[turned] / (now[turned] - goal[turned])
            first = share.min()
            left = now + first * (goal - now)
            gone = {at[i] for i in turned[share <= first + 1e-12]}
            used = {j: float(v) for j, v in zip(at, left) if j not in gone and v != 0}
        residual = target - (clear(bend_columns(t, list(used))) @ np.array(list(used.values())) if used else 0.0)
        asks = np.abs(bend_products(t, residual))
        asks[list(used)] = 0.0
        best = places[np.argmax(asks[places])] if len(places) else -1
        if best < 0 or asks[best] <= penalty + 1e-9 * scale:
            break
        used[int(best)] = 0.0
    return used


def _criterion(y: np.ndarray, design: np.ndarray) -> tuple[float, np.ndarray]:
    """Schwarz's criterion of a least-squares fit, a bend counted as two (its place and its size)."""
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    n = len(y)
    squares = max(float(((y - design @ beta) ** 2).sum()), 1e-12 * float((y * y).sum()) + 1e-300)
    return n * np.log(squares / n), beta


def find_bends(t: np.ndarray, y: np.ndarray, free: np.ndarray, shares: Sequence[float] = SHARES) -> list[int]:
    """Places of the bends: the lasso's for the penalty that the criterion likes best, then without those
    that it can do without or finds better one period beside."""
    n = len(t)
    places = np.arange(MARGIN - 1, n - MARGIN)
    if len(places) < 1 or n < free.shape[1] + 2 * MARGIN:
        return []
    basis = np.linalg.qr(free)[0]
    most = np.abs(bend_products(t, y - basis @ (basis.T @ y))[places]).max()
    if most <= 1e-9 * max(np.abs(y).max(), 1e-300) * float((t - t[0]).sum() + 1):
        return []

    def cost(at: Sequence[int]) -> float:
        return _criterion(y, np.hstack([free, bend_columns(t, at)]))[0] + 2 * len(at) * np.log(n)

    tried: dict[tuple[int, ...], float] = {(): cost([])}
    used: dict[int, float] = {}
    for share in shares:
        used = bend_lasso(t, y, free, share * most, places, used)
        if len(used) > n // 4:
            break
        tried.setdefault(tuple(sorted(used)), cost(sorted(used)))
    # The lasso splits one bend over neighbours: every set it met is thinned out first.
    for at in sorted(tried, key=tried.get)[:4]:
        now = list(at)
        while now:
            fewer = [[k for k in now if k != j] for j in now]
            beside = [sorted({*(k for k in now if k != j), j + d}) for j in now for d in (-1, 1) if MARGIN - 1 <= j + d < n - MARGIN]
            moves = min(((cost(m), m) for m in fewer + beside), default=(np.inf, now))
            if moves[0] >= cost(now) - 1e-9:
                break
            now = moves[1]
        tried[tuple(now)] = cost(now)
    return list(min(tried, key=tried.get))


def season_columns(months: np.ndarray, seasonal: bool) -> np.ndarray:
    """One column for each month but the first that occurs."""
    kinds = np.unique(months)[1:] if seasonal else []
    return np.stack([(months == m).astype(float) for m in kinds], axis=1) if len(kinds) else np.zeros((len(months), 0))


def bent_trend_fit(
    df: DataFrame, keys: Sequence[str], y: str = "y", seasonal: bool = True, shares: Sequence[float] = SHARES, ds: str = "ds"
) -> DataFrame:
    """``(keys..., n, first_ds, last_ds, status, intercept, slope, bends, season, sigma)`` per series.

    ``bends`` holds (ds, change): from that month on the monthly slope is larger by ``change``.  The season
    is a map from month to its effect and sums to zero over the months that occur.  Series whose rows do
    not exceed the season's columns by six keep their level only, with status 'level'; one without
    known values has no row.  A series is bounded by its calendar, so it travels as one row.
    """
    names = [*keys, "n", "first_ds", "last_ds"]

    def fit_one(days: np.ndarray, months: np.ndarray, target: np.ndarray) -> dict:
        t = (months - months[0]).astype(float)
        n, month = len(t), months % 12 + 1
        season = season_columns(month, seasonal)
        out = {"status": "level", "intercept": float(target.mean()), "slope": 0.0, "bends": [], "season": {}, "sigma": float(target.std())}
        if n < season.shape[1] + 2 + 2 * MARGIN:
            return out
        free = np.hstack([np.ones((n, 1)), t[:, None], season])
        at = find_bends(t, target, free, shares)
        design = np.hstack([free, bend_columns(t, at)])
        beta = _criterion(target, design)[1]
        kinds = np.unique(month)
        effect = np.r_[0.0, beta[2 : 2 + season.shape[1]]] if seasonal else np.zeros(0)
        level = float(effect.mean()) if len(effect) else 0.0
        out.update(
            status="ok", intercept=float(beta[0]) + level, slope=float(beta[1]),
            bends=[{"day": int(days[j]), "change": float(c)} for j, c in zip(at, beta[2 + season.shape[1] :])],
            season={int(m): float(e - level) for m, e in zip(kinds, effect)} if seasonal else {},
            sigma=float((target - design @ beta).std()),
        )
        return out

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [fit_one(*map(np.asarray, row)) for row in zip(batch["_days"], batch["_months"], batch["_values"])]
            found = pd.DataFrame(fits, index=batch.index, columns=["status", "intercept", "slope", "bends", "season", "sigma"])
            yield pd.concat([batch[names], found], axis=1)

    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    point = F.struct(F.unix_date(ds).alias("d"), (month_number(ds) - 1).alias("m"), F.col(y).cast("double").alias("v"))
    series = df.filter(known).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(ds).alias("first_ds"), F.max(ds).alias("last_ds"),
        F.array_sort(F.collect_list(point)).alias("_points"),
    )
    arrays = series.filter("n > 0").select(
        *names, F.col("_points.d").alias("_days"), F.col("_points.m").alias("_months"), F.col("_points.v").alias("_values")
    )
    bend = T.StructType([T.StructField("day", T.IntegerType()), T.StructField("change", T.DoubleType())])
    schema = T.StructType([arrays.schema[c] for c in names] + [
        T.StructField("status", T.StringType()), T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType()),
        T.StructField("bends", T.ArrayType(bend)), T.StructField("season", T.MapType(T.IntegerType(), T.DoubleType())),
        T.StructField("sigma", T.DoubleType()),
    ])
    told = F.transform("bends", lambda b: F.struct(F.date_from_unix_date(b["day"]).alias("ds"), b["change"].alias("change")))
    return arrays.mapInPandas(fit, schema).withColumn("bends", told)


def change_dates(model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., ds, slope_before, slope_after)``: a row for each bend, slopes per month."""
    bends = model.select(*keys, "slope", "bends", F.posexplode("bends").alias("_at", "_bend"))
    before = F.col("slope") + F.aggregate(F.slice("bends", F.lit(1), F.col("_at")), F.lit(0.0), lambda acc, b: acc + b["change"])
    return bends.select(
        *keys, F.col("_bend.ds").alias("ds"), before.alias("slope_before"), (before + F.col("_bend.change")).alias("slope_after")
    )


def bent_trend_predict(model: DataFrame, keys: Sequence[str], horizon: int = 12, level: float = 0.95) -> DataFrame:
    """``(keys..., ds, yhat, lower, upper, trend, seasonal, is_future)``; the last slope goes on."""
    points = F.sequence(F.col("first_ds"), F.add_months("last_ds", horizon), F.expr("interval 1 month"))
    rows = model.withColumn("ds", F.explode(points))
    t = (month_number("ds") - month_number("first_ds")).cast("double")
    bent = F.aggregate("bends", F.lit(0.0), lambda acc, b: acc + b["change"] * F.greatest(
        (month_number("ds") - month_number(b["ds"])).cast("double"), F.lit(0.0)
    ))
    trend = F.col("intercept") + F.col("slope") * t + bent
    seasonal = F.coalesce(F.try_element_at("season", F.month("ds")), F.lit(0.0))
    out = rows.select(
        *keys, "ds", (trend + seasonal).alias("yhat"), "sigma", trend.alias("trend"), seasonal.alias("seasonal"),
        (F.col("ds") > F.col("last_ds")).alias("is_future"),
    )
    return interval(out, level).select(*keys, "ds", "yhat", "lower", "upper", "trend", "seasonal", "is_future")

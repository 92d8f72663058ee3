"""Cross-validated linear models from moments: every fold and every penalty from one aggregate.

Expanding folds of a series differ by whole blocks of ``test_size`` periods.  So the moments are
summed once per series and block; the train moments of a fold are those of its older blocks added up,
its test error follows from the moments of the block after them, and no fold reads rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelcast.operators.linear import _pairs, moments, solve_penalized
from panelcast.operators.windows import from_end

ALPHAS = (0.01, 0.1, 0.5, 1.0)


def fold_blocks(keys: Sequence[str], n_splits: int, test_size: int, ds: str = "ds") -> Column:
    """0 for the newest ``test_size`` rows of a series, 1 for those before, ..., ``n_splits`` for the rest.

    Fold k of S tests block S - k and trains on all higher blocks."""
    return F.least(F.floor((from_end(keys, ds) - 1) / test_size), F.lit(n_splits)).cast("int")


def block_moments(
    df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str],
    n_splits: int = 5, test_size: int = 12, ds: str = "ds", pooled: bool = False,
) -> DataFrame:
    """``(keys..., blocks)``: per series, or over all series, the moments of each block.

    The blocks' window and both aggregates are dealt by the series, so rows are shuffled once; pooled
    moments merge what is left of that, a row for each block and task.
    """
    cut = df.select(*keys, ds, y, *xs).withColumn("_block", fold_blocks(keys, n_splits, test_size, ds))
    group = [] if pooled else list(keys)
    per_block = moments(cut, [*group, "_block"], y, xs)
    parts = F.struct("_block", "n", "y_mean", "y_var", "x_mean", "cov", "cov_xy")
    told = per_block.groupBy(*group).agg(F.collect_list(parts).alias("blocks"))
    return told.filter(F.size("blocks") > 0)


def _merged(a: tuple, b: tuple) -> tuple:
    """Moments (n, mean, centred squares) of two sets of rows together, for many series at once."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    step = b[1] - a[1]
    both = a[0] * share
    return n, a[1] + step * share[:, None], a[2] + b[2] + both[:, None, None] * step[:, :, None] * step[:, None, :]


def fold_fits(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    xs: Sequence[str],
    alphas: Sequence[float] = ALPHAS,
    l1_ratio: float = 0.5,
    n_splits: int = 5,
    test_size: int = 12,
    ds: str = "ds",
    pooled: bool = False,
) -> DataFrame:
    """One penalised fit per series, fold and alpha, and the one on all rows as fold ``n_splits + 1``.

    Returns ``(keys..., fold, alpha, n, intercept, coef, x_mean, sigma, n_test, rmse, status)``; the fits
    are those that ``fit_linear`` makes from the fold's train rows.  ``rmse`` is the error on the
    fold's complete test rows, NULL without such.  A fold with fewer than p + 2 complete train rows is
    'short' and has NULLs.  ``pooled`` fits all series together, each series cut into its own blocks.
    """
    p = len(xs)
    upper = _pairs(p)
    at = {pair: i for i, pair in enumerate(upper)}
    square = [at[min(i, j), max(i, j)] for i in range(p) for j in range(p)]
    key_names = [] if pooled else list(keys)
    grid = sorted(set(map(float, alphas)), reverse=True)
    if not grid:
        raise ValueError("at least one alpha is needed")

    def told(blocks: pd.Series, number: int) -> tuple:
        """Moments of one block of every series; zeros where a series has none."""
        rows = [next((b for b in series if b["_block"] == number), None) for series in blocks]
        n = np.array([b["n"] if b is not None else 0 for b in rows], dtype=float)
        mean, spread = np.zeros((len(rows), p + 1)), np.zeros((len(rows), p + 1, p + 1))
        for i, b in enumerate(rows):
            if b is not None:
                mean[i] = [*b["x_mean"], b["y_mean"]]
                spread[i, :p, :p] = np.asarray(b["cov"])[square].reshape(p, p)
                spread[i, :p, p] = spread[i, p, :p] = b["cov_xy"]
                spread[i, p, p] = b["y_var"]
        return n, mean, spread * n[:, None, None]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            count = len(batch)
            train = (np.zeros(count), np.zeros((count, p + 1)), np.zeros((count, p + 1, p + 1)))
            for fold in range(1, n_splits + 2):
                train = _merged(train, told(batch["blocks"], n_splits - fold + 1))
                n, mean, spread = train
                ok = np.flatnonzero(n >= p + 2)
                m_test, test_mean, test_spread = (
                    told(batch["blocks"], n_splits - fold) if fold <= n_splits else (np.zeros(count), mean, spread)
                )
                start = None
                cov = spread[ok] / n[ok][:, None, None]
                sd = np.sqrt(np.einsum("sii->si", cov[:, :p, :p]))
                sd[sd == 0] = 1.0
                scaled = cov[:, :p, :p] / sd[:, :, None] / sd[:, None, :]
                for alpha in grid:
                    out = batch[key_names].copy()
                    out["fold"], out["alpha"] = fold, alpha
                    out["n"], out["n_test"], out["status"] = n.astype(np.int64), m_test.astype(np.int64), "short"
                    numbers = {c: np.full(count, np.nan) for c in ("intercept", "sigma", "rmse")}
                    lists: dict[str, list] = {"coef": [None] * count, "x_mean": [None] * count}
                    if len(ok):
                        start = solve_penalized(scaled, cov[:, :p, p] / sd, alpha, l1_ratio, start)
                        coef = start / sd
                        intercept = mean[ok, p] - np.einsum("si,si->s", coef, mean[ok, :p])
                        line = np.concatenate([-coef, np.ones((len(ok), 1))], axis=1)
                        left = np.einsum("si,sij,sj->s", line, cov, line)
                        squares = np.einsum("si,sij,sj->s", line, test_spread[ok], line)
                        bias = np.einsum("si,si->s", line, test_mean[ok]) - intercept
                        tested = m_test[ok]
                        error = np.divide(squares, tested, out=np.full(len(ok), np.nan), where=tested > 0) + bias * bias
                        numbers["intercept"][ok], numbers["sigma"][ok] = intercept, np.sqrt(np.maximum(left, 0))
                        numbers["rmse"][ok] = np.sqrt(np.maximum(error, 0))
                        out.iloc[ok, out.columns.get_loc("status")] = "ok"
                        for i, row in enumerate(ok):
                            lists["coef"][row], lists["x_mean"][row] = coef[i], mean[row, :p]
                    yield out.assign(**numbers, **lists)[[f.name for f in schema]]

    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[k] for k in key_names] + [
        T.StructField(name, kind) for name, kind in (
            ("fold", T.IntegerType()), ("alpha", T.DoubleType()), ("n", T.LongType()), ("intercept", T.DoubleType()),
            ("coef", doubles), ("x_mean", doubles), ("sigma", T.DoubleType()), ("n_test", T.LongType()),
            ("rmse", T.DoubleType()), ("status", T.StringType()),
        )
    ])
    fits = block_moments(df, keys, y, xs, n_splits, test_size, ds, pooled).mapInPandas(solve, schema)
    # Pandas has no NULL for doubles: what is missing comes back as NaN.
    return fits.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("intercept", "sigma", "rmse")})


def choose_alpha(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., alpha, rmse, n_folds)``: the alpha with the smallest error over all test rows.

    An alpha that scores fewer test rows than another loses to it; of equal ones the larger, simpler
    one wins.  A series without a scored fold has a NULL alpha.
    """
    squares = F.sum(F.col("rmse") * F.col("rmse") * F.col("n_test"))
    scored = F.sum(F.when(F.col("rmse").isNotNull(), F.col("n_test")))
    by_alpha = fits.groupBy(*keys, "alpha").agg(
        F.coalesce(scored, F.lit(0)).alias("_n"), F.sqrt(F.try_divide(squares, scored)).alias("rmse"),
        F.count("rmse").cast("int").alias("n_folds"),
    )
    told = F.struct(F.when(F.col("_n") > 0, F.col("alpha")).alias("alpha"), "rmse", "n_folds")
    rank = F.struct(-F.col("_n"), F.col("rmse"), -F.col("alpha"))
    return by_alpha.groupBy(*keys).agg(F.min_by(told, rank).alias("_best")).select(*keys, "_best.*")


def bridge_fit_cv(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The models on all rows at each series' chosen alpha, as ``bridge_predict`` takes them.

    A window over the few rows of a series finds alpha and model together; no join.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by_alpha = Window.partitionBy(*keys, "alpha") if keys else Window.partitionBy("alpha")
    tested = F.when(F.col("rmse").isNotNull(), F.col("n_test"))
    scored = fits.withColumns({
        "_n": F.coalesce(F.sum(tested).over(by_alpha), F.lit(0)),
        "_e": F.sum(F.col("rmse") * F.col("rmse") * tested).over(by_alpha),
        "_last": F.max("fold").over(w),
    })
    rank = F.struct(-F.col("_n"), F.try_divide(F.col("_e"), F.col("_n")), -F.col("alpha"))
    best = scored.filter(F.col("fold") == F.col("_last")).withColumn("_rank", rank)
    best = best.withColumn("_least", F.min("_rank").over(w)).filter(F.col("_rank") == F.col("_least"))
    return best.select(*keys, "alpha", "n", "intercept", "coef", "x_mean", "sigma", "status")

"""Row-wise arithmetic shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import Z_BY_LEVEL
from panelcast.functions.dates import as_col


def row_total(df: DataFrame, cols: Sequence[str], name: str = "total", digits: int = 2) -> DataFrame:
    """Sum over columns of a row; a missing part counts as zero."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    return df.withColumn(name, F.round(total, digits))


def clip(column: Column | str, low: float, high: float) -> Column:
    """Bound a value.  ``least``/``greatest`` skip NULLs, so NULL is kept by hand."""
    c = as_col(column)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def round_report(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


def residuals(df: DataFrame, y: str = "y", yhat: str = "yhat", name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(y) - F.col(yhat))


def interval(
    df: DataFrame, level: float = 0.95, yhat: str = "yhat", sigma: str = "sigma"
) -> DataFrame:
    """Adds ``lower``/``upper`` = prediction -/+ z * sigma."""
    if level not in Z_BY_LEVEL:
        raise ValueError(f"interval level must be one of {sorted(Z_BY_LEVEL)}, got {level}")
    margin = F.col(sigma) * Z_BY_LEVEL[level]
    return df.withColumns({"lower": F.col(yhat) - margin, "upper": F.col(yhat) + margin})

"""Data quality: nulls, duplicates, distribution, verdict."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

QUARTILES = (0.25, 0.5, 0.75)
#: Bins of an interval in one round of counting, and rounds after which something is wrong.
BINS = 512
MAX_ROUNDS = 200


def _missing(df: DataFrame, col: str) -> Column:
    is_float = df.schema[col].dataType.typeName() in ("double", "float")
    return F.col(col).isNull() | F.isnan(col) if is_float else F.col(col).isNull()


def null_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, column, n_null) from one aggregate; the unpivot runs on the aggregated rows."""
    counts = df.groupBy(*keys).agg(*[F.sum(_missing(df, c).cast("long")).alias(c) for c in cols])
    return counts.unpivot(list(keys), list(cols), "column", "n_null")


def duplicate_rows(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows whose values repeat an earlier row of the series; the date is not compared."""
    distinct = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_n"))
    return distinct.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("n_duplicates"))


def _moments(value: str) -> list[Column]:
    return [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(list(keys), list(cols), "column", "value")


def describe_panel(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles, max per column; quartiles are exact and interpolated.

    Per series the number of values is bounded by the calendar, so ``percentile`` may hold them.
    Over the whole table (no keys) it is not, see ``_whole_table_quartiles``.
    """
    long = _long(df, keys, cols)
    order = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    if keys:
        quartiles = [F.percentile("value", q).alias(f"p{int(q * 100)}") for q in QUARTILES]
        out = long.groupBy(*keys, "column").agg(*_moments("value"), *quartiles)
    else:
        out = _whole_table_quartiles(long)
    return out.select(*keys, "column", *order)


def _text(value: float) -> str:
    """A double as SQL text, digit for digit."""
    return f"CAST('{value!r}' AS DOUBLE)"


def _bin(low: float, high: float, by_size: bool) -> str:
    """SQL text for the bin of a value of low..high: even steps of the value, or of the logarithm of its
    size for values that span many magnitudes.  Both never fall with the value, so bins are in order."""
    if by_size:
        unit = max(abs(low), abs(high)) * 2.0**-60 or 5e-324

        def place(v: str) -> str:
            return f"signum({v}) * ln(1 + least(abs({v}) / {_text(unit)}, 1e300D))"
    else:
        # Halves, so that the span of two large numbers of different sign does not overflow.
        def place(v: str) -> str:
            return f"({v}) / 2"
    start, end = place(_text(low)), place(_text(high))
    # Ends too near each other for a step are one bin; the next round takes the other kind of steps.
    share = f"coalesce(try_divide({place('value')} - {start}, {end} - {start}), 0D)"
    return f"CAST(least(floor({share} * {BINS}), {BINS - 1}) AS INT)"


def ranked_values(long: DataFrame, ranks: Mapping[str, Sequence[int]], ends: Mapping[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The values at given ranks (0 is the smallest) of the finite values of each column of (column, value).

    Every rank has an interval that holds it, at first the column's ends.  A round counts the values in
    BINS bins of each interval by one aggregate with map-side combine; the bin that holds the rank,
    from its smallest to its largest value, is the next interval, until that is a single value.  A task
    sees sums only, however often a value occurs; the driver gets BINS sums for each open interval.
    """
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, r): (*ends[c], 0) for c, some in ranks.items() for r in some}
    for turn in range(MAX_ROUNDS):
        found.update({at: low for at, (low, high, _) in open_.items() if low == high})
        open_ = {at: x for at, x in open_.items() if at not in found}
        if not open_:
            return found
        intervals = list(dict.fromkeys((c, low, high) for (c, _), (low, high, _) in open_.items()))
        tests = []
        for i, (c, low, high) in enumerate(intervals):
            name = c.replace("\\", "\\\\").replace("'", "\\'")
            holds = f"column = '{name}' AND value BETWEEN {_text(low)} AND {_text(high)}"
            tests.append((f"WHEN {holds} THEN {i}", f"WHEN {holds} THEN {_bin(low, high, turn % 2 == 1)}"))
        which, place = (f"CASE {' '.join(t[k] for t in tests)} END" for k in (0, 1))
        sums = (
            long.selectExpr(f"{which} AS span", f"{place} AS bin", "value").filter("span IS NOT NULL")
            .groupBy("span", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .orderBy("span", "bin").collect()
        )
        bins: dict[int, list] = {}
        for r in sums:
            bins.setdefault(r["span"], []).append(r)
        number = {x: i for i, x in enumerate(intervals)}
        for (c, rank), (low, high, below) in list(open_.items()):
            for r in bins[number[c, low, high]]:
                if rank < below + r["n"]:
                    break
                below += r["n"]
            # Adding zero makes one of the two zeros.
            open_[c, rank] = (r["low"] + 0.0, r["high"] + 0.0, below)
    raise RuntimeError("ranks are not alone after the last round")


def _whole_table_quartiles(long: DataFrame) -> DataFrame:
    """Exact quartiles of columns of any length, by counted ranges; NaN counts as the largest value."""
    finite = (F.abs("value") < float("inf")) & ~F.isnan("value")
    stats = long.groupBy("column").agg(
        *_moments("value"), F.count(F.when(F.col("value") == float("-inf"), 1)).alias("_lowest"),
        F.count(F.when(finite, 1)).alias("_finite"), F.count(F.when(F.isnan("value"), 1)).alias("_nan"),
        F.min(F.when(finite, F.col("value"))).alias("_from"), F.max(F.when(finite, F.col("value"))).alias("_to"),
    ).collect()
    places = {r["column"]: [(r["count"] - 1) * q for q in QUARTILES] for r in stats if r["count"]}
    wanted, known = {}, {}
    for r in stats:
        for rank in {int(f(x)) for x in places.get(r["column"], ()) for f in (math.floor, math.ceil)}:
            inner = rank - r["_lowest"]
            if 0 <= inner < r["_finite"]:
                wanted.setdefault(r["column"], []).append(inner)
            else:
                infinite = r["count"] - r["_nan"]
                known[r["column"], rank] = -math.inf if inner < 0 else math.inf if rank < infinite else math.nan
    ends = {r["column"]: (r["_from"] + 0.0, r["_to"] + 0.0) for r in stats if r["_finite"]}
    lowest = {r["column"]: r["_lowest"] for r in stats}
    known.update({(c, r + lowest[c]): v for (c, r), v in ranked_values(long.filter(finite), wanted, ends).items()})
    rows = []
    for r in stats:
        quartiles = []
        for x in places.get(r["column"], [None] * len(QUARTILES)):
            if x is None:
                quartiles.append(None)
                continue
            below, above = known[r["column"], math.floor(x)], known[r["column"], math.ceil(x)]
            quartiles.append(below if below == above else below + (above - below) * (x - math.floor(x)))
        rows.append((r["column"], r["count"], r["mean"], r["std"], r["min"], r["max"], *quartiles))
    return long.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, max double, p25 double, p50 double, p75 double"
    )


def quality_verdict(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], min_rows: int = 36
) -> DataFrame:
    """Valid: no nulls, no duplicated value rows, more than ``min_rows`` rows.

    One pass: equal value rows are counted first, nulls and rows are weighted by that count.
    """
    distinct = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_n"))
    nulls = reduce(lambda a, b: a + b, [_missing(df, c).cast("long") for c in cols])
    out = distinct.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.sum(nulls * F.col("_n")).alias("n_null"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
    )
    valid = (F.col("n_null") == 0) & (F.col("n_duplicates") == 0) & (F.col("n_rows") > min_rows)
    return out.withColumn("n_cols", F.lit(len(cols))).withColumn("is_valid", valid)


def data_types(df: DataFrame) -> DataFrame:
    """(column, dtype) of the panel; metadata only."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def series_sigma(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.stddev_samp(c).alias(f"{c}_sigma") for c in cols])

"""What was known when: values with a date of publication, and joins with the last one before a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.functions.dates import month_floor


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    cols: Sequence[str],
    strict: bool = False,
    told_at: str | None = None,
) -> DataFrame:
    """Each left row with ``cols`` of the last right row of its keys at or before its time.

    Both sides are stacked and dealt by the keys once; one window carries the last right row forward.
    That is linear however many right rows a left row has before it, where a join on an inequality
    multiplies them.  ``strict`` leaves out right rows of the very time; ``told_at`` adds the right row's
    time under that name.  Right rows of the same keys and time: the one with the largest values, in
    the order of ``cols``.  Left rows without time or without a right row get NULLs; right rows
    without time are never found; NULL keys meet NULL keys.  No left row is lost or repeated.
    """
    time = left.schema[left_at].dataType
    carried = F.struct(F.col(right_at).cast(time).alias("_t"), *cols)
    rights = right.filter(F.col(right_at).isNotNull()).select(
        *keys, F.col(right_at).cast(time).alias("_at"), carried.alias("_right"), F.lit(None).cast(_struct_of(left)).alias("_left")
    )
    lefts = left.select(
        *keys, F.col(left_at).alias("_at"), F.lit(None).cast(rights.schema["_right"].dataType).alias("_right"),
        F.struct(*left.columns).alias("_left"),
    )
    # At one time right rows stand before left ones, or behind them if only earlier ones count.
    side = F.when(F.col("_left").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    stacked = rights.unionByName(lefts).withColumn("_side", side)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stacked.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_left is not null")
    told = F.when(F.col("_at").isNotNull(), F.col("_found"))
    extra = [told["_t"].alias(told_at)] if told_at else []
    return found.select("_left.*", *extra, *[told[c].alias(c) for c in cols])


def _struct_of(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("_")).schema["_"].dataType


def known_at(
    revisions: DataFrame, keys: Sequence[str], dates: Sequence, cols: Sequence[str], ds: str = "ds",
    published: str = "published_at", name: str = "asof",
) -> DataFrame:
    """``(keys..., asof, ds, published_at, cols...)``: each period's value as published by each date.

    Every row is repeated for the dates that know it, and the newest publication of a period wins by a
    mergeable aggregate, so partial winners are shuffled, once.  Of two publications of one time the
    larger values count.  A value that was published as NULL is NULL, not the one before it.
    """
    at = F.array(*[F.lit(d).cast(revisions.schema[published].dataType) for d in dates])
    rows = revisions.withColumn(name, F.explode(at)).filter(F.col(published) <= F.col(name))
    newest = F.max(F.struct(published, *cols)).alias("_new")
    return rows.groupBy(*keys, name, ds).agg(newest).select(*keys, name, ds, "_new.*")


def monthly_known_at(
    daily: DataFrame, keys: Sequence[str], day: int, cols: Sequence[str], ds: str = "ds",
    published: str | None = None,
) -> DataFrame:
    """``(keys..., ds, cols...)``: rows that were published by the given day of their own month.

    Without a column of publication a value is public on its day: then this is the cut-off day.
    Of several publications of one day the last one in time counts.
    """
    seen = daily.withColumn("_p", F.col(published or ds))
    limit = F.date_add(month_floor(ds), day - 1)
    seen = seen.filter((F.col("_p").cast("date") <= limit) & (F.col(ds) <= limit) & (month_floor(ds) == month_floor(limit)))
    newest = F.max(F.struct("_p", *cols)).alias("_new")
    return seen.groupBy(*keys, ds).agg(newest).select(*keys, ds, *[F.col("_new")[c].alias(c) for c in cols])

"""Panels built from the driver's test tables (roles as assigned in FIXTURES.md).

Every builder aggregates the raw rows to (series, period) in one pass.  The big table is shuffled
once: the small dimension is joined to ``orders`` first, then ``lineitem`` to the result, and only
the columns in use leave the scan.  A customer or order that holds a large share of the rows is
split by AQE's skew join; a segment that does is collapsed by the map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelcast.functions.dates import month_floor, week_label

SERIES = ["series"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(col: str) -> Column:
    """Two-decimal doubles as whole hundredths.

    Integer sums are exact in any order and stay in generated code, unlike decimals of this width.
    An overflow of the 63 bits raises an error (ANSI mode).
    """
    return F.rint(F.col(col) * 100).cast("bigint")


def _exact_sum(col: str) -> Column:
    return F.sum(_hundredths(col)) / F.lit(100.0)


def _orders_by_key(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col(key).cast("string").alias("series"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def _monthly_orders(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    rows = _orders_by_key(spark, sf_dir, key)
    month = month_floor(F.col("o_orderdate").cast("date"))
    return rows.groupBy("series", month.alias("ds")).agg(
        _exact_sum("o_totalprice").alias("y")
    )


def monthly_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MP: order value by market segment and month."""
    return _monthly_orders(spark, sf_dir, "c_mktsegment")


def monthly_wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NP: the same by nation, i.e. more series."""
    return _monthly_orders(spark, sf_dir, "c_nationkey")


def _shipped_rows(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    keyed = _orders_by_key(spark, sf_dir, "c_mktsegment").select("o_orderkey", "series")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", *cols)
    return lines.join(keyed, F.col("l_orderkey") == F.col("o_orderkey"))


def daily_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DP: shipped quantity, revenue and line count by segment and day."""
    rows = _shipped_rows(spark, sf_dir, "l_quantity", "l_extendedprice", "l_discount")
    revenue = _hundredths("l_extendedprice") * (100 - _hundredths("l_discount"))
    return rows.groupBy("series", F.col("l_shipdate").cast("date").alias("ds")).agg(
        _exact_sum("l_quantity").alias("qty"),
        (F.sum(revenue) / F.lit(10000.0)).alias("rev"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def weekly_indicator(daily: DataFrame) -> DataFrame:
    """WP: weekly activity scaled to 0-100 inside each series, labelled by its Sunday.

    Rolled up from the daily panel, so the line items are not read again.
    """
    from panelcast.operators.windows import minmax_scale

    weeks = daily.groupBy("series", week_label("ds").alias("ds")).agg(
        F.sum("n_lines").cast("double").alias("n_lines")
    )
    return minmax_scale(weeks, SERIES, "n_lines", name="idx").select("series", "ds", "idx")


def monthly_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XP: stand-ins for production, policy rate, unemployment, exchange rate and price index."""
    rows = _shipped_rows(
        spark, sf_dir, "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag"
    )
    month = month_floor(F.col("l_shipdate").cast("date"))
    return rows.groupBy("series", month.alias("ds")).agg(
        _exact_sum("l_extendedprice").alias("production"),
        F.avg("l_discount").alias("policy_rate"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("unemployment"),
        F.avg("l_tax").alias("fx"),
        F.avg(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))).alias("price_index"),
    )


def shipped_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP: value of each month's orders shipped so far, published at the end of every month in which more
    of them was shipped: a monthly series whose values are revised for some months."""
    orders = _orders_by_key(spark, sf_dir, "c_mktsegment").select(
        "o_orderkey", "series", month_floor(F.col("o_orderdate").cast("date")).alias("ds")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    published = F.last_day(F.col("l_shipdate").cast("date")).alias("published_at")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = rows.groupBy("series", "ds", published).agg(F.sum(_hundredths("l_extendedprice")).alias("_part"))
    so_far = F.sum("_part").over(Window.partitionBy("series", "ds").orderBy("published_at"))
    return parts.select("series", "ds", "published_at", (so_far / F.lit(100.0)).alias("shipped"))


def macro_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and drivers side by side, one row per series and month."""
    from panelcast.operators.shape import assemble_wide

    return assemble_wide(
        [monthly_target(spark, sf_dir), monthly_drivers(spark, sf_dir)], SERIES
    )


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP: events by type and day."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return events.groupBy(
        F.col("event_type").alias("series"), F.col("ts").cast("date").alias("ds")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
    )


def first_open_month(spark: SparkSession, sf_dir: str) -> Column:
    """Start of the first month whose orders are not complete: the month of the last order, or the
    next one if that order is from the month's last day.  A scalar subquery, no job of its own."""
    last = table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("d"))
    after = F.when(F.col("d") == F.last_day("d"), F.date_add("d", 1))
    return last.select(after.otherwise(F.trunc("d", "month")).alias("d")).scalar()


def known_until(df: DataFrame, until: Column, y: str = "y", ds: str = "ds") -> DataFrame:
    """Hide target values from a month on; the rows stay and are the ones to nowcast."""
    return df.withColumn(y, F.when(F.col(ds) < until, F.col(y)))

"""Panels kept as bucketed tables: series operators read them without a shuffle.

A stored panel is dealt into buckets by its keys and partitioned by month.  A window, an aggregate or a
join by the keys then finds every series whole in one task, and a month is replaced by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Name of the partition column.
MONTH = "month_of"
BUCKETS = 64


def _placed(df: DataFrame, keys: Sequence[str], ds: str, buckets: int) -> DataFrame:
    """Rows with their month last, one task for each bucket, so that a month gets one file a bucket."""
    if not keys:
        raise ValueError("a stored panel needs at least one key")
    values = [c for c in df.columns if c != MONTH]
    return df.select(*values, F.date_format(ds, "yyyy-MM").alias(MONTH)).repartition(buckets, *keys)


def create_store(
    df: DataFrame, name: str, keys: Sequence[str], ds: str = "ds", buckets: int = BUCKETS, path: str | None = None
) -> DataFrame:
    """Write a panel as the table ``name``, in place of an old one, and read it back.

    Buckets should grow with the panel (some 100 MB each, at least as many as cores).  ``path`` puts the
    files outside the warehouse.  Rows without a date are an error: they have no month.
    """
    dated = df.withColumn(ds, F.coalesce(F.col(ds), F.raise_error(F.lit("panel row without a date")).cast("date")))
    writer = (
        _placed(dated, keys, ds, buckets).write.mode("overwrite").format("parquet")
        .partitionBy(MONTH).bucketBy(buckets, *keys).sortBy(*keys, ds)
    )
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return read_store(df.sparkSession, name)


def read_store(spark: SparkSession, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored panel, or its months from ``first`` to ``last`` (``yyyy-MM``): others are not read."""
    rows = spark.table(name)
    if first is not None:
        rows = rows.filter(F.col(MONTH) >= first)
    if last is not None:
        rows = rows.filter(F.col(MONTH) <= last)
    return rows.drop(MONTH)


def layout(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """Keys and number of the table's buckets."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    keys = [k.strip(" `") for k in told.get("Bucket Columns", "[]").strip("[]").split(",") if k.strip()]
    return keys, int(told.get("Num Buckets", 0))


def replace_months(df: DataFrame, name: str, ds: str = "ds") -> None:
    """Replace the months that ``df`` has rows in; files of other months stay as they are.

    Writing the same rows again changes nothing, so a failed run is simply repeated.  ``df`` has the
    table's columns; their order does not matter.  A month to be emptied cannot be told this way.
    """
    spark = df.sparkSession
    keys, buckets = layout(spark, name)
    table = spark.table(name)
    placed = _placed(df, keys, ds, buckets).select(*table.columns)
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        placed.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(name)

"""Reading landed files into panels and writing reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def panel_schema(keys: Sequence[str], values: Sequence[str], ds: str = "ds") -> T.StructType:
    return T.StructType(
        [T.StructField(k, T.StringType()) for k in keys]
        + [T.StructField(ds, T.DateType())]
        + [T.StructField(v, T.DoubleType()) for v in values]
    )


def read_panel(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    ds: str,
    values: Sequence[str],
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Landed file -> ``(keys..., ds, values...)`` with settled types.

    Columnar files carry their own types, so the wanted columns are selected and cast.  Text files
    are read with an explicit schema: no inference pass over the data.  CSV files of one folder must
    agree in their header, else reading fails.  NaN, which some writers use for a missing value,
    becomes NULL.
    """
    reader = spark.read.options(**options)
    if fmt in ("csv", "json"):
        if fmt == "csv":
            # A CSV schema is positional: read the header names only, then type the wanted columns.
            header = reader.option("header", True).csv(path).columns
            wanted = {f.name: f for f in panel_schema(keys, values, ds)}
            fields = [wanted.get(c, T.StructField(c, T.StringType())) for c in header]
            # Without enforceSchema=false, files with other column orders would be read by position.
            reader = reader.option("header", True).option("enforceSchema", False)
            raw = reader.schema(T.StructType(fields)).csv(path)
        else:
            raw = reader.schema(panel_schema(keys, values, ds)).json(path)
    else:
        raw = reader.format(fmt).load(path)
    return raw.select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        F.col(ds).cast("date").alias("ds"),
        *[F.nullif(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in values],
    )


def time_slice(df: DataFrame, start: str, end: str, ds: str = "ds") -> DataFrame:
    """Rows of a closed date range; written on the raw column so the scan can skip row groups."""
    return df.filter(F.col(ds).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def merge_sources(
    primary: DataFrame,
    fallback: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    ds: str = "ds",
) -> DataFrame:
    """Complement a partial source by a second one, value by value.

    Tagged union and one aggregate: a single shuffle with map-side combine, where a full outer
    join would shuffle and sort both inputs.  ``origin`` says where the row came from.
    """
    def tag(df: DataFrame, rank: int) -> DataFrame:
        return df.select(*keys, ds, *values, F.lit(rank).alias("_rank"))

    both = tag(primary, 0).unionByName(tag(fallback, 1))
    picked = both.groupBy(*keys, ds).agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("_rank") == 0, F.col(v))),
                F.max(F.when(F.col("_rank") == 1, F.col(v))),
            ).alias(v)
            for v in values
        ],
        F.min("_rank").alias("_low"),
        F.max("_rank").alias("_high"),
    )
    origin = (
        F.when(F.col("_low") != F.col("_high"), "both")
        .when(F.col("_low") == 0, "primary")
        .otherwise("fallback")
    )
    return picked.withColumn("origin", origin).drop("_low", "_high")


def reject_duplicates(df: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """Enforce the panel contract: the job fails on a second row for the same series and date."""
    values = [c for c in df.columns if c not in (*keys, ds)]
    checked = df.groupBy(*keys, ds).agg(
        *[F.max(v).alias(v) for v in values], F.count(F.lit(1)).alias("_n")
    )
    fail = F.raise_error(F.concat_ws(" ", F.lit("duplicate panel row at"), *keys, F.col(ds).cast("string")))
    return checked.withColumn("_n", F.when(F.col("_n") > 1, fail).otherwise(F.col("_n").cast("string"))).filter(
        F.col("_n") == "1"
    ).drop("_n")


def dedupe_columns(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Keep the first of columns that share a name and drop status columns.  Metadata only."""
    first_at: dict[str, int] = {}
    for at, name in enumerate(df.columns):
        first_at.setdefault(name, at)
    placed = df.toDF(*[f"_{at}" for at in range(len(df.columns))])
    return placed.select(
        *[F.col(f"_{at}").alias(name) for name, at in first_at.items() if name not in drop]
    )


def write_report(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Write metrics or predictions; every task writes its own file."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)

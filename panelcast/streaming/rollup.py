"""Roll-up of a continuously arriving feed; batch and stream share the aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelcast.session import shared_dir


def read_feed(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """File stream with the schema of a batch table; no inference."""
    return spark.readStream.schema(like.schema).format(fmt).load(path)


def feed_aggregates(value: str, ts: str) -> list[Column]:
    """Mergeable aggregates: the state of a window is a few numbers, however many rows it has."""
    v = F.col(value)
    return [
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        # The value breaks ties of the time stamp, so a re-run gives the same row.
        F.max(F.when(v.isNotNull(), F.struct(F.col(ts).alias("t"), v.alias("v"))))["v"].alias("last"),
    ]


def wall_clock(ts: str) -> Column:
    """Event time whose UTC reading is the wall clock of the row, to the second.

    Watermarks need a zoned time stamp and day windows start at UTC midnight; this way the day of
    a zone-free row does not depend on the session's time zone.
    """
    t = F.col(ts)
    days = F.unix_date(t.cast("date")).cast("long")
    return F.timestamp_seconds(days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))


def stream_rollup(
    events: DataFrame,
    keys: Sequence[str],
    value: str,
    ts: str = "ts",
    width: str = "1 day",
    watermark: str = "7 days",
) -> DataFrame:
    """``(keys..., ds, n, total, mean, std, last)`` per window.  Works on batch and stream frames;
    on a stream the watermark bounds the state."""
    rows = events.withColumn("_ts", wall_clock(ts))
    if rows.isStreaming:
        rows = rows.withWatermark("_ts", watermark)
    windows = rows.groupBy(*keys, F.window("_ts", width).alias("_w")).agg(*feed_aggregates(value, ts))
    day = F.floor(F.unix_seconds(F.col("_w.start")) / F.lit(86400)).cast("int")
    return windows.select(*keys, F.date_from_unix_date(day).alias("ds"), "n", "total", "mean", "std", "last")


def late_rows(events: DataFrame, keys: Sequence[str], cutoff: int, ts: str = "ts") -> DataFrame:
    """Per series and month: rows inside the vintage and rows after its cut-off day."""
    day = F.dayofmonth(F.col(ts).cast("date"))
    month = F.trunc(F.col(ts).cast("date"), "month")
    return events.groupBy(*keys, month.alias("ds")).agg(
        F.sum((day <= cutoff).cast("long")).alias("n_in_time"),
        F.sum((day > cutoff).cast("long")).alias("n_late"),
    )


def run_to_table(stream: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Drain what is available now and return the newest state of each (keys, ds).

    Every micro-batch writes the windows it changed under its batch number (a re-run of a batch
    after a failure overwrites its own folder); readers keep the highest number.  Nothing passes
    through the driver.
    """
    spark = stream.sparkSession
    root = path or f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    saved = spark.read.parquet(f"{root}/data")
    values = [c for c in stream.columns if c not in (*keys, "ds")]
    newest = F.max_by(F.struct(*values), "batch").alias("_v")
    return saved.groupBy(*keys, "ds").agg(newest).select(*keys, "ds", "_v.*")

"""A feed's months as stream state: the nowcast's monthly indicators while their month goes on.

Each series keeps its open months, a few numbers a column.  Every batch tells the months it changed; a
timer at the cut-off day tells the month's final vintage, and one at the month's end lets the month go,
so the state holds no more months than the watermark reaches back.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelcast.functions.dates import month_floor
from panelcast.operators.shape import doubles
from panelcast.session import shared_dir
from panelcast.streaming.rollup import wall_clock

DAY_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = (
    "counts array<bigint>, means array<double>, squares array<double>, times array<bigint>, lasts array<double>, "
    "late bigint, closed boolean, version bigint, ends bigint"
)
STATS = ("mean", "std", "last")


class MonthState(StatefulProcessor):
    """Open months of one series; ``months`` maps a month's first day, in days, to its numbers."""

    def __init__(self, keys: Sequence[str], cols: Sequence[str], cutoff: int):
        self.keys, self.cols, self.cutoff = list(keys), list(cols), cutoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "month int", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[int, dict] = {}
        for part in rows:
            if part.empty:
                continue
            for month, block in part.groupby("feed_month"):
                month = int(month)
                state = changed.get(month) or self._read(month, int(block["feed_month_ends"].iloc[0]))
                self._add(state, block)
                changed[month] = state
        for month, state in changed.items():
            yield self._save(key, month, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        for (month,) in list(self.months.keys()):
            state = self._read(month, 0)
            if state["ends"] * DAY_MS <= due:
                self.months.removeKey((month,))
            elif not state["closed"] and (month + self.cutoff) * DAY_MS <= due:
                state["closed"] = True
                yield self._save(key, month, state)

    def close(self) -> None:
        pass

    def _read(self, month: int, ends: int) -> dict:
        if self.months.containsKey((month,)):
            return dict(zip((f.split()[0] for f in STATE.split(", ")), map(_plain, self.months.getValue((month,)))))
        for day in (month + self.cutoff, ends):
            self.handle.registerTimer(day * DAY_MS)
        n = len(self.cols)
        return {
            "counts": [0] * n, "means": [0.0] * n, "squares": [0.0] * n, "times": [0] * n, "lasts": [0.0] * n,
            "late": 0, "closed": False, "version": 0, "ends": ends,
        }

    def _add(self, state: dict, block: pd.DataFrame) -> None:
        """Rows up to the cut-off day count unless the vintage is closed; the others are late."""
        known = block[block["feed_in_time"]] if not state["closed"] else block[:0]
        state["late"] += len(block) - len(known)
        for i, c in enumerate(self.cols):
            some = known[known[c].notna()]
            if some.empty:
                continue
            n, mean = len(some), float(some[c].mean())
            have, step = state["counts"][i], mean - state["means"][i]
            total = have + n
            state["squares"][i] += float(((some[c] - mean) ** 2).sum()) + step * step * have * n / total
            state["means"][i] += step * n / total
            state["counts"][i] = total
            # Of equal times the larger value, so that a run again gives the same.
            newest = max(zip(some["feed_at"].tolist(), some[c].tolist()))
            if not have or newest > (state["times"][i], state["lasts"][i]):
                state["times"][i], state["lasts"][i] = int(newest[0]), float(newest[1])

    def _save(self, key, month: int, state: dict) -> pd.DataFrame:
        state["version"] += 1
        self.months.updateValue((month,), tuple(state.values()))
        out: dict = {name: [value] for name, value in zip(self.keys, key)}
        out["ds"] = [(pd.Timestamp(0) + pd.Timedelta(days=month)).date()]
        for i, c in enumerate(self.cols):
            n = state["counts"][i]
            out[f"{c}_mean"] = [state["means"][i] if n else None]
            out[f"{c}_std"] = [math.sqrt(state["squares"][i] / (n - 1)) if n > 1 else None]
            out[f"{c}_last"] = [state["lasts"][i] if n else None]
        out["n_late"], out["is_final"], out["version"] = [state["late"]], [state["closed"]], [state["version"]]
        return pd.DataFrame(out)


def _plain(value):
    return list(value) if hasattr(value, "__len__") and not isinstance(value, str) else value


def month_feed(
    feed: DataFrame, keys: Sequence[str], cols: Sequence[str], cutoff: int = 20, ts: str = "ds", watermark: str = "40 days"
) -> DataFrame:
    """``(keys..., ds, {col}_mean, {col}_std, {col}_last, n_late, is_final, version)`` of a stream of daily rows.

    A row of the result is a month as it stands; of the rows of a month the highest version holds.
    Rows after the cut-off day, or for a month whose vintage is told, are counted as late.  Rows that
    the watermark leaves behind are dropped by Spark before they come here.  NULL values are skipped.
    """
    day = F.col(ts).cast("date")
    month = month_floor(day)
    # No name may begin with an underscore: the batches come as named tuples.
    rows = feed.filter(F.col(ts).isNotNull()).select(
        *keys, wall_clock(ts).alias("feed_ts"), F.unix_date(month).alias("feed_month"),
        F.unix_date(F.add_months(month, 1)).alias("feed_month_ends"), (F.dayofmonth(day) <= cutoff).alias("feed_in_time"),
        F.unix_micros(wall_clock(ts)).alias("feed_at"), *doubles(feed, cols),
    ).withWatermark("feed_ts", watermark)
    schema = T.StructType([feed.schema[k] for k in keys] + [T.StructField("ds", T.DateType())] + [
        T.StructField(f"{c}_{s}", T.DoubleType()) for c in cols for s in STATS
    ] + [T.StructField("n_late", T.LongType()), T.StructField("is_final", T.BooleanType()), T.StructField("version", T.LongType())])
    return rows.groupBy(*keys).transformWithStateInPandas(MonthState(keys, cols, cutoff), schema, "Update", "EventTime")


def run_months(months: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Drain what is available now and return each month as it stands.

    ``path`` holds checkpoint and results; a run with the same path goes on where the last one ended.  A
    batch that is run again after a failure overwrites its own folder.
    """
    spark: SparkSession = months.sparkSession
    root = path or f"{shared_dir(spark)}/months-{uuid.uuid4().hex}"

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = (
            months.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
            .foreachBatch(save).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    saved = spark.read.schema(months.schema).parquet(f"{root}/data")
    values = [c for c in months.columns if c not in (*keys, "ds", "version")]
    newest = F.max_by(F.struct(*values), "version").alias("_v")
    return saved.groupBy(*keys, "ds").agg(newest).select(*keys, "ds", "_v.*")

"""Monthly indicators as stream state against the batch roll-up."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import align
from panelcast.streaming import months, rollup
from helpers import mixed_frequency, pandas_of, to_spark

COLS = ["load", "load_ind"]


@pytest.fixture(scope="module")
def daily(spark):
    _, frame, _ = mixed_frequency()
    frame = frame[frame["ds"] >= "2020-06-01"].reset_index(drop=True)
    frame.loc[frame.index % 9 == 0, "load"] = np.nan
    one = to_spark(spark, frame)
    two = one.withColumns({"k": F.lit("b"), "load": F.col("load") * 2})
    return one.unionByName(two).withColumn("load", F.when(~F.isnan("load"), F.col("load"))).cache()


def write(df, path, first, last, files=3):
    df.filter(F.col("ds").between(first, last)).repartition(files).write.mode("append").parquet(path)


def check(got, daily):
    want = pandas_of(align.daily_to_monthly(daily, ["k"], COLS, 20))
    late = pandas_of(rollup.late_rows(daily, ["k"], 20, "ds").withColumnRenamed("ds", "d").withColumnRenamed("d", "ds"))
    got = pandas_of(got)
    # A month whose only rows came after its cut-off day has no values, but late rows.
    assert len(got) == len(late) and got["n_late"].tolist() == late["n_late"].tolist()
    both = want.merge(got, on=["k", "ds"], suffixes=("", "_got"))
    assert len(both) == len(want)
    for c in COLS:
        for s in months.STATS:
            assert np.allclose(both[f"{c}_{s}"], both[f"{c}_{s}_got"], equal_nan=True), (c, s)
    return got


def test_state_equals_batch_and_goes_on_after_a_restart(spark, daily, tmp_path):
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    bounds = [("2020-06-01", "2020-09-15"), ("2020-09-16", "2020-12-20"), ("2020-12-21", "2021-04-19")]
    for first, last in bounds:
        write(daily, path, first, last)
        feed = months.month_feed(rollup.read_feed(spark, path, daily), ["k"], COLS, 20, watermark="200 days")
        got = check(months.run_months(feed, ["k"], out), daily.filter(F.col("ds") <= last))
    assert not got["is_final"].all()


def test_timers_close_vintages_and_let_months_go(spark, daily, tmp_path):
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    feed = lambda: months.month_feed(rollup.read_feed(spark, path, daily), ["k"], COLS, 20, watermark="2 days")
    for month in range(6, 12):
        write(daily, path, dt.date(2020, month, 1), dt.date(2020, month + 1, 1) - dt.timedelta(days=1), files=1)
        got = check(months.run_months(feed(), ["k"], out), daily.filter(F.col("ds") < dt.date(2020, month + 1, 1)))
    assert got.groupby("k")["is_final"].sum().tolist() == [6, 6]
    state = spark.read.format("statestore").option("stateVarName", "months").load(f"{out}/checkpoint")
    assert state.count() <= 4  # two series, the newest month and the one before


def test_late_and_empty(spark, daily, tmp_path):
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    late = daily.filter("day(ds) > 20 and ds < '2020-08-01'")
    late.coalesce(1).write.parquet(path)
    got = pandas_of(months.run_months(months.month_feed(rollup.read_feed(spark, path, daily), ["k"], COLS), ["k"], out))
    assert got["n_late"].sum() == late.count() and got["load_mean"].isna().all()

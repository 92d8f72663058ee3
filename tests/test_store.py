"""Bucketed panels: plans without a shuffle, months replaced by themselves."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from panelcast.operators import align, windows
from panelcast.sources import store
from helpers import mixed_frequency, noisy_panel, to_spark


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture()
def kept(spark, tmp_path):
    names = []

    def make(df, name, keys=("k",), buckets=4):
        names.append(name)
        return store.create_store(df, name, list(keys), buckets=buckets, path=f"{tmp_path}/{name}")

    yield make
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_series_operators_need_no_shuffle(spark, kept):
    df = noisy_panel(spark, keys=tuple("abcdef"))
    stored = kept(df, "panel_plain")
    assert rows(stored.select(df.columns)) == rows(df)
    lagged = windows.lags(stored, ["k"], "y")
    design = windows.ar_features(stored, ["k"], "y", ["x1", "x2"], ["x1"])
    assert shuffles(lagged) == 0 and shuffles(design) == 0
    assert shuffles(windows.lags(df, ["k"], "y")) == 1
    assert rows(lagged.select("k", "ds", "y_lag12")) == rows(windows.lags(df, ["k"], "y").select("k", "ds", "y_lag12"))
    want = windows.ar_features(df, ["k"], "y", ["x1", "x2"], ["x1"])
    assert rows(design.select(want.columns)) == rows(want)


def test_mixed_frequencies_need_no_shuffle(spark, kept):
    target, daily, weekly = (to_spark(spark, f) for f in mixed_frequency())
    stack = align.stack_frequencies(target, ["k"], "y", (daily, ["load"]), (weekly, ["idx"]))
    stored = align.features_of_stack(kept(stack, "panel_stack"), ["k"], "y", ["load"], ["idx"])
    plain = align.nowcast_features(target, ["k"], "y", (daily, ["load"]), (weekly, ["idx"]))
    assert shuffles(stored) == 0 and shuffles(plain) == 2
    got, want = stored.select(plain.columns).toPandas(), plain.toPandas()
    assert got.sort_values("ds").round(9).reset_index(drop=True).equals(want.sort_values("ds").round(9).reset_index(drop=True))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month_of=*/*.parquet")}


def test_a_month_is_replaced_alone(spark, kept, tmp_path):
    df = noisy_panel(spark, keys=tuple("abc"))
    kept(df, "panel_months")
    before = files(f"{tmp_path}/panel_months")
    new = df.filter("ds = '2021-03-01'").withColumn("y", F.lit(7.0)).select("y", "x2", "ds", "k", "x1")
    for _ in range(2):
        store.replace_months(new, "panel_months")
        now = files(f"{tmp_path}/panel_months")
        other = {f: t for f, t in now.items() if "2021-03" not in f}
        assert other == {f: t for f, t in before.items() if "2021-03" not in f}
        got = store.read_store(spark, "panel_months")
        want = df.withColumn("y", F.when(F.col("ds") == "2021-03-01", 7.0).otherwise(F.col("y")))
        assert rows(got.select(df.columns)) == rows(want)
        assert shuffles(windows.lags(got, ["k"], "y")) == 0
    # A month that was not there before, of a series that was not.
    late = df.filter("ds = '2021-03-01' and k = 'a'").withColumns({"ds": F.lit("2030-01-01").cast("date"), "k": F.lit("z")})
    store.replace_months(late, "panel_months")
    assert store.read_store(spark, "panel_months").count() == df.count() + 1
    assert store.layout(spark, "panel_months") == (["k"], 4)


def test_only_the_months_asked_for_are_read(spark, kept):
    df = noisy_panel(spark, keys=tuple("ab"))
    kept(df, "panel_some")
    some = store.read_store(spark, "panel_some", "2020-03", "2020-05")
    assert rows(some.select(df.columns)) == rows(df.filter("ds between '2020-03-01' and '2020-05-31'"))
    assert "PartitionFilters: [isnotnull(month_of" in some._jdf.queryExecution().executedPlan().toString()


def test_errors_and_empty(spark, kept):
    df = noisy_panel(spark, keys=("a",))
    with pytest.raises(ValueError):
        kept(df, "panel_no_key", keys=())
    with pytest.raises(Exception, match="without a date"):
        kept(df.withColumn("ds", F.lit(None).cast("date")), "panel_no_date")
    assert kept(df.filter("k = 'q'"), "panel_empty").count() == 0

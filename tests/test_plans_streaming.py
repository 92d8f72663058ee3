import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import mixed_frequency, month, noisy_panel, pandas_of, to_spark
from panelcast import BoostConfig, NowcastBoostConfig, NowcastConfig
from panelcast.config import ForecastConfig
from panelcast.operators.boosted import boosted_forecast_fit
from panelcast.plans import forecast as forecast_plan
from panelcast.plans.forecast import run_forecast
from panelcast.plans.nowcast import BASELINE, BOOSTED, BRIDGE, run_nowcast
from panelcast.sources.calendars import gap_fill
from panelcast.streaming import rollup


def test_nowcast_run(spark):
    target, daily, weekly = mixed_frequency()
    target = target[target["ds"] < "2021-03-01"]
    frames = []
    for key in ("a", "b"):
        frames.append([to_spark(spark, f, key) for f in (target, daily, weekly)])
    t, d, w = (a.unionByName(b) for a, b in zip(*frames))
    result = run_nowcast(
        t, ["k"], (d, ["load"]), (w, ["idx"]), config=NowcastConfig(test_size=6),
        boost=NowcastBoostConfig(n_estimators=3),
    )
    metrics = pandas_of(result.backtest.metrics, "k", "model")
    assert metrics["model"].tolist() == sorted([BASELINE, BRIDGE, BOOSTED]) * 2
    assert np.allclose(metrics[metrics["model"] == BASELINE]["gain_pct"], 0)
    assert result.backtest.predictions.groupBy("k", "model").count().filter("count != 6").count() == 0
    now = pandas_of(result.nowcast)
    assert now["ds"].tolist() == [dt.date(2021, 3, 1)] * 2
    assert (now["lower"] <= now["yhat"]).all() and (now["yhat"] <= now["upper"]).all()
    line = result.timeline.filter("k = 'a'").groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in line} == {"history": 46, "nowcast": 1, "forecast": 12}
    summary = result.summary.collect()
    assert len(summary) == 2 and all(r["best_model"] and r["last_ds"] == dt.date(2021, 2, 1) for r in summary)


def test_forecast_run(spark):
    df = noisy_panel(spark)
    result = run_forecast(
        gap_fill(df, ["k"]), ["k"], ["x1", "x2"], ["x1"], boost=BoostConfig(max_depth=3, n_estimators=3)
    )
    assert result.predictions.groupBy("k", "model").count().filter("count != 12").count() == 0
    path = pandas_of(result.forecast)
    assert path.groupby("k").size().tolist() == [12, 12] and path["ds"].min() == month(72)
    best = result.metrics.toPandas().sort_values("rmse").groupby("k")["model"].first()
    assert path.groupby("k")["model"].first().to_dict() == best.to_dict()
    scen = pandas_of(result.scenarios, "k", "ds", "scenario")
    base = scen[scen["scenario"] == "base"]["yhat"].to_numpy()
    assert np.allclose(scen[scen["scenario"] == "otimista"]["yhat"], base * 1.02)
    row = {r["k"]: r for r in result.summary.collect()}["a"]
    assert row["n_rows"] == 60 and len(row["top_features"]) == 5 and row["horizon"] == 12
    assert np.isclose(row["final_base"], base[11])


def test_forecast_run_reads_its_panel_once_and_fits_side_by_side(spark, monkeypatch):
    df = gap_fill(noisy_panel(spark), ["k"])
    seen, both = spark.sparkContext.accumulator(0), threading.Barrier(2)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    # Behind a shuffle, as a panel built from raw rows is.
    panel = df.mapInPandas(counted, df.schema).repartition(2, "k")

    def fit(*args):
        both.wait(90)
        return boosted_forecast_fit(*args)

    monkeypatch.setattr(forecast_plan, "boosted_forecast_fit", fit)
    result = run_forecast(panel, ["k"], ["x1", "x2"], ["x1"], boost=BoostConfig(max_depth=2, n_estimators=2))
    assert result.quality.count() > 0 and result.summary.count() == 2
    assert seen.value == df.count()


def test_single_series_run_without_keys(spark):
    target, daily, _ = mixed_frequency()
    target = target[target["ds"] < "2021-04-01"]
    t, d = (to_spark(spark, f).drop("k") for f in (target, daily))
    result = run_nowcast(t, [], (d, ["load"]), config=NowcastConfig(test_size=6), boost=NowcastBoostConfig(n_estimators=2))
    row = result.summary.collect()
    assert len(row) == 1 and row[0]["nowcast_ds"] == dt.date(2021, 4, 1)


@pytest.fixture()
def feed(spark, tmp_path):
    rng = np.random.default_rng(0)
    start = dt.datetime(2024, 1, 1)
    rows = [("ab"[i % 3 == 0], start + dt.timedelta(hours=int(h)), float(v))
            for i, (h, v) in enumerate(zip(rng.integers(0, 24 * 30, 400), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    path = str(tmp_path / "feed")
    df.repartition(5).write.parquet(path)
    return df, path


def test_stream_equals_batch(spark, feed, tmp_path):
    df, path = feed
    source = rollup.read_feed(spark, path, df)
    stream = rollup.stream_rollup(source, ["k"], "value", watermark="40 days")
    got = pandas_of(rollup.run_to_table(stream, ["k"], str(tmp_path / "out")))
    want = pandas_of(rollup.stream_rollup(df, ["k"], "value"))
    assert len(got) == len(want)
    for c in ("n", "total", "mean", "std", "last"):
        assert np.allclose(got[c], want[c], equal_nan=True)
    direct = pandas_of(df.groupBy("k", F.col("ts").cast("date").alias("ds")).agg(F.stddev_samp("value").alias("s")))
    assert np.allclose(want["std"], direct["s"], equal_nan=True) and want["std"].isna().any()


def test_late_rows(spark, feed):
    df, _ = feed
    out = rollup.late_rows(df, ["k"], 20).agg(F.sum("n_in_time"), F.sum("n_late")).first()
    assert out[0] + out[1] == 400 and out[1] == df.filter("day(ts) > 20").count()


def test_forecast_run_with_a_hole_and_piecewise_model(spark):
    """A driver's missing month drops feature rows, not the target: dates stay calendar dates."""
    df = gap_fill(noisy_panel(spark), ["k"])
    hole = df.withColumn("x1", F.when(F.col("ds") != month(66), F.col("x1")))
    result = run_forecast(
        hole, ["k"], ["x1", "x2"], config=ForecastConfig(structural="piecewise", mode="additive"),
        boost=BoostConfig(max_depth=2, n_estimators=2),
    )
    tests = pandas_of(result.predictions, "k", "model", "ds")
    assert tests["ds"].min() >= month(60) and tests["ds"].max() == month(71) and tests["yhat"].notna().all()
    path = pandas_of(result.forecast)
    assert path["ds"].min() == month(72) and path.groupby("k").size().tolist() == [12, 12]
    assert {"n_scored"} <= set(result.metrics.columns)

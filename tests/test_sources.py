import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import month, panel, pandas_of, series
from panelcast.sources import calendars, io


def test_gap_fill_completes_each_series_between_its_own_ends(spark):
    df = panel(spark, [("a", month(0), 1.0), ("a", month(3), 4.0), ("b", month(5), 2.0)])
    out = pandas_of(calendars.gap_fill(df, ["k"]))
    assert out["ds"].tolist() == [month(i) for i in range(4)] + [month(5)]
    assert out["y"].isna().tolist() == [False, True, True, False, False]
    missing = pandas_of(calendars.missing_periods(df, ["k"]))
    assert missing["ds"].tolist() == [month(1), month(2)]


def test_gap_fill_daily_and_weekly(spark):
    day = dt.date(2024, 2, 27)
    df = panel(spark, [("a", day, 1.0), ("a", day + dt.timedelta(4), 2.0)])
    assert calendars.gap_fill(df, ["k"], freq="D").count() == 5
    sunday = dt.date(2024, 12, 29)
    weeks = panel(spark, [("a", sunday, 1.0), ("a", sunday + dt.timedelta(21), 2.0)])
    out = pandas_of(calendars.gap_fill(weeks, ["k"], freq="W-SUN"))
    assert out["ds"].tolist() == [sunday + dt.timedelta(7 * i) for i in range(4)]


def test_unknown_frequency_is_rejected(spark):
    with pytest.raises(ValueError):
        calendars.gap_fill(series(spark, [1.0, 2.0]), ["k"], freq="Q")


def test_spine_starts_on_the_grid(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2015, 1, 15), dt.date(2015, 4, 2))], "k string, lo date, hi date"
    )
    months = calendars.calendar_spine(df, "lo", "hi", "MS", ["k"]).toPandas()["ds"].tolist()
    assert months == [dt.date(2015, 2, 1), dt.date(2015, 3, 1), dt.date(2015, 4, 1)]
    weeks = calendars.calendar_spine(df, "lo", "hi", "W-SUN", ["k"]).toPandas()["ds"].tolist()
    assert weeks[0] == dt.date(2015, 1, 18) and all(d.isoweekday() == 7 for d in weeks)


def test_spine_without_a_grid_point_is_empty(spark):
    df = spark.createDataFrame([("a", dt.date(2015, 1, 2), dt.date(2015, 1, 20))], "k string, lo date, hi date")
    assert calendars.calendar_spine(df, "lo", "hi", "MS", ["k"]).count() == 0


def test_future_spine_after_february_does_not_skip_march(spark):
    df = panel(spark, [("a", dt.date(2025, 2, 1), 1.0)])
    out = pandas_of(calendars.future_spine(df, ["k"], 3))
    assert out["ds"].tolist() == [dt.date(2025, 3, 1), dt.date(2025, 4, 1), dt.date(2025, 5, 1)]


def test_merge_sources_complements_value_by_value(spark):
    cols = "k string, ds date, u double, v double"
    first = panel(spark, [("a", month(0), 1.0, None), ("a", month(1), 2.0, 5.0)], cols)
    second = panel(spark, [("a", month(0), 9.0, 7.0), ("a", month(2), 3.0, 8.0)], cols)
    out = pandas_of(io.merge_sources(first, second, ["k"], ["u", "v"]))
    assert out["u"].tolist() == [1.0, 2.0, 3.0]
    assert out["v"].tolist() == [7.0, 5.0, 8.0]
    assert out["origin"].tolist() == ["both", "primary", "fallback"]


def test_duplicate_panel_rows_are_rejected(spark):
    good = series(spark, [1.0, 2.0])
    assert io.reject_duplicates(good, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate panel row"):
        io.reject_duplicates(good.unionByName(good), ["k"]).collect()


def test_dedupe_columns_keeps_the_first(spark):
    df = series(spark, [1.0]).select("k", "ds", "y", F.lit(9.0).alias("y"), F.lit(True).alias("isPartial"))
    out = io.dedupe_columns(df, ["isPartial"])
    assert out.columns == ["k", "ds", "y"] and out.first()["y"] == 1.0


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_report_round_trip(spark, tmp_path, fmt):
    df = series(spark, [1.5, None, 2.5])
    path = str(tmp_path / fmt)
    io.write_report(df, path, fmt)
    back = pandas_of(io.read_panel(spark, path, ["k"], "ds", ["y"], fmt))
    assert back["ds"].tolist() == [month(i) for i in range(3)]
    assert back["y"].fillna(-1).tolist() == [1.5, -1.0, 2.5]


def test_time_slice_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    series(spark, [1.0, 2.0, 3.0]).write.parquet(path)
    df = io.time_slice(spark.read.parquet(path), "2020-02-01", "2020-03-01")
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ds" in plan


def test_open_month_follows_the_orders(spark, tmp_path):
    from panelcast.sources import testdata as td

    for name, last, want in (("mid", "2003-05-09", "2003-05-01"), ("end", "2003-05-31", "2003-06-01")):
        spark.sql(f"SELECT timestamp'{last} 00:00:00' AS o_orderdate").write.parquet(str(tmp_path / name / "orders.parquet"))
        bound = td.first_open_month(spark, str(tmp_path / name))
        assert str(spark.range(1).select(bound.alias("d")).first()["d"]) == want


def test_reader_turns_nan_to_null_and_rejects_other_headers(spark, tmp_path):
    df = panel(spark, [("a", month(0), float("nan")), ("a", month(1), 2.0)])
    df.write.parquet(str(tmp_path / "p"))
    out = pandas_of(io.read_panel(spark, str(tmp_path / "p"), ["k"], "ds", ["y"]).filter("y is null"))
    assert out["ds"].tolist() == [month(0)]
    for name, head in (("1.csv", "k,ds,y,z\na,2020-01-01,1,2\n"), ("2.csv", "k,ds,z,y\na,2020-02-01,2,1\n")):
        (tmp_path / "c").mkdir(exist_ok=True)
        (tmp_path / "c" / name).write_text(head)
    with pytest.raises(Exception, match="header"):
        io.read_panel(spark, str(tmp_path / "c"), ["k"], "ds", ["y", "z"], "csv").collect()

"""As-of joins and vintages against loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators import align, vintages
from helpers import mixed_frequency, to_spark

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def plan_of(df):
    """The plan as it ran, without the first draft that is printed behind it."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(6)
    left = [(rng.choice(["a", "b", None]), rng.choice([day(rng.randint(0, 40)), None]), i) for i in range(120)]
    right = [
        (rng.choice(["a", "b", "c", None]), rng.choice([day(rng.randint(5, 35)), None]), rng.randint(0, 9), rng.choice([None, 1.5, 2.5]))
        for _ in range(90)
    ]
    left += left[:5]
    return left, right


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_equals_a_loop(spark, sides, strict):
    left, right = sides
    lefts = spark.createDataFrame(left, "k string, at date, id int").repartition(3)
    rights = spark.createDataFrame(right, "k string, seen date, n int, v double").repartition(3)
    got = vintages.asof_join(lefts, rights, ["k"], "at", "seen", ["n", "v"], strict, "seen_at")
    assert got.columns == ["k", "at", "id", "seen_at", "n", "v"]

    def found(k, at):
        some = [
            (t, n, v is not None, v or 0) for key, t, n, v in right
            if key == k and t is not None and at is not None and (t < at if strict else t <= at)
        ]
        if not some:
            return None, None, None
        t, n, known, v = max(some)
        return t, n, v if known else None

    want = sorted(((k, at, i, *found(k, at)) for k, at, i in left), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    # One shuffle, besides those that this test deals its tables with.
    plan = plan_of(got)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_known_at_equals_a_loop(spark, sides):
    rng = random.Random(2)
    rows = [("ab"[i % 2], day(rng.randint(0, 9)), rng.choice([day(rng.randint(0, 60)), None]), rng.choice([None, float(i)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ds date, published_at date, y double").repartition(3)
    dates = [day(-1), day(12), day(30), day(90)]
    got = vintages.known_at(df, ["k"], dates, ["y"])
    want: dict = {}
    for k, ds, at, y in rows:
        for asof in dates:
            if at is not None and at <= asof:
                new = (at, y is not None, y or 0)
                want[k, asof, ds] = max(want.get((k, asof, ds), new), new)
    assert {(r["k"], r["asof"], r["ds"]): (r["published_at"], r["y"]) for r in got.collect()} == {
        key: (at, y if known else None) for key, (at, known, y) in want.items()
    }
    assert plan_of(got).count("Exchange hashpartitioning") == 1


def test_the_cut_off_day_is_a_vintage(spark):
    _, daily, _ = mixed_frequency()
    df = to_spark(spark, daily)
    cut = align.cutoff_filter(df, 20)
    got = vintages.monthly_known_at(df, ["k"], 20, ["load", "load_ind"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cut.collect()))
    # Published two days later, the same cut-off knows two days less; a correction replaces the first value.
    late = df.withColumn("published_at", F.date_add("ds", 2))
    fixed = late.withColumns({"load": F.col("load") + 1, "published_at": F.date_add("published_at", 1)})
    both = vintages.monthly_known_at(late.unionByName(fixed), ["k"], 20, ["load"], published="published_at")
    want = {r["ds"]: r["load"] + (r["ds"].day <= 17) for r in df.collect() if r["ds"].day <= 18}
    assert {r["ds"]: r["load"] for r in both.collect()} == pytest.approx(want)


def test_empty_sides(spark):
    left = spark.createDataFrame([("a", day(1), 1)], "k string, at date, id int")
    right = spark.createDataFrame([], "k string, seen date, n int")
    assert vintages.asof_join(left, right, ["k"], "at", "seen", ["n"]).first()["n"] is None
    assert vintages.asof_join(left.filter("id = 9"), right, ["k"], "at", "seen", ["n"]).count() == 0
    none = spark.createDataFrame([], "k string, ds date, published_at date, y double")
    assert vintages.known_at(none, ["k"], [day(1)], ["y"]).count() == 0

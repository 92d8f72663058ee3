"""Small panels for the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def month(n: int, start: tuple[int, int] = (2020, 1)) -> dt.date:
    total = start[0] * 12 + start[1] - 1 + n
    return dt.date(total // 12, total % 12 + 1, 1)


def panel(spark, rows, cols="k string, ds date, y double"):
    return spark.createDataFrame(rows, cols)


def series(spark, values, key="a", start=(2020, 1)):
    return panel(spark, [(key, month(i, start), v) for i, v in enumerate(values)])


def pandas_of(df, *order):
    out = df.toPandas()
    return out.sort_values(list(order or ("k", "ds"))).reset_index(drop=True)


def noisy_panel(spark, keys=("a", "b"), n=72, seed=7):
    """Monthly target with trend, season and noise, and two drivers."""
    rng = np.random.default_rng(seed)
    rows = []
    for shift, key in enumerate(keys):
        x1, x2 = rng.normal(10, 2, n).cumsum() / 10, rng.normal(5, 1, n)
        for i in range(n):
            y = 100 + 20 * shift + 0.4 * i + 5 * np.sin(2 * np.pi * i / 12) + x2[i] + rng.normal(0, 0.5)
            rows.append((key, month(i), float(y), float(x1[i]), float(x2[i])))
    return panel(spark, rows, "k string, ds date, y double, x1 double, x2 double")


def mixed_frequency(seed=11):
    """Sixty months from May 2016: a target that follows a random walk with a yearly wave, a daily load
    with weekends, holes and a last month that stops on the 19th, and a weekly index around the wave."""
    rng = np.random.default_rng(seed)
    first, last = dt.date(2016, 5, 1), dt.date(2021, 4, 19)
    walk = np.cumsum(rng.gamma(2.0, 0.4, 60) - 0.6)
    wave = np.sin(np.arange(60) * np.pi / 6)
    target = pd.DataFrame({"ds": pd.to_datetime([month(i, (2016, 5)) for i in range(60)]), "y": 40 + walk + 3 * wave})
    days = pd.date_range(first, last)
    days = days[rng.random(len(days)) > 0.03]
    at = np.array([(d.year - 2016) * 12 + d.month - 5 for d in days])
    load = 7 + 0.2 * walk[at] + 1.5 * (days.dayofweek < 5) + rng.laplace(0, 0.3, len(days))
    daily = pd.DataFrame({"ds": days, "load": load, "load_ind": 2 * load + rng.laplace(0, 0.5, len(days))})
    weeks = pd.date_range(first, last, freq="W-SUN")
    at = np.array([(d.year - 2016) * 12 + d.month - 5 for d in weeks])
    weekly = pd.DataFrame({"ds": weeks, "idx": 30 + 9 * wave[at] + rng.exponential(4, len(weeks))})
    return target, daily, weekly


def to_spark(spark, frame, key="a"):
    frame = frame.copy()
    frame["ds"] = frame["ds"].dt.date
    frame.insert(0, "k", key)
    cols = "k string, ds date, " + ", ".join(f"{c} double" for c in frame.columns[2:])
    return spark.createDataFrame(frame, cols)

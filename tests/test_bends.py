"""Sparse trend changes: optimality against the dense matrix, planted bends, edge series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import bends
from helpers import month, pandas_of, panel, series


def planted(rng, n, changes, noise, season=0.0, slope=0.5):
    t = np.arange(n, dtype=float)
    y = 50 + slope * t + sum(c * np.maximum(t - j, 0) for j, c in changes.items())
    return t, y + season * np.sin(2 * np.pi * t / 12) + rng.normal(0, noise, n)


def test_products_equal_the_dense_matrix():
    rng = np.random.default_rng(0)
    t = np.cumsum(rng.integers(1, 3, 50)).astype(float)
    r = rng.normal(size=50)
    assert np.allclose(bends.bend_products(t, r), bends.bend_columns(t, range(50)).T @ r)


@pytest.mark.parametrize("seed", range(6))
def test_lasso_is_optimal(seed):
    rng = np.random.default_rng(seed)
    t, y = planted(rng, 60, {20: 1.0, 41: -1.5}, 2.0)
    t = t + (t > 30) * 3  # a hole
    free = np.stack([np.ones(60), t], axis=1)
    basis = np.linalg.qr(free)[0]
    clear = lambda v: v - basis @ (basis.T @ v)
    places = np.arange(2, 57)
    dense, target = clear(bends.bend_columns(t, places)), clear(y)
    most = np.abs(dense.T @ target).max()
    used: dict = {}
    for share in (0.6, 0.2, 0.05, 0.01):
        penalty = share * most
        used = bends.bend_lasso(t, y, free, penalty, places, used)
        beta = np.array([used.get(j, 0.0) for j in places.tolist()])
        # What a lasso solution is: active columns at the penalty, the others below it.
        pull = dense.T @ (target - dense @ beta)
        assert np.abs(pull).max() <= penalty * (1 + 1e-6)
        assert np.allclose(pull[beta != 0], penalty * np.sign(beta[beta != 0]), rtol=1e-5)
        # And a dense coordinate descent does not get lower.
        worth = lambda b: 0.5 * ((target - dense @ b) ** 2).sum() + penalty * np.abs(b).sum()
        other, squares = np.zeros(len(places)), (dense**2).sum(0)
        left = target.copy()
        for _ in range(400):
            for j in range(len(places)):
                left += dense[:, j] * other[j]
                product = dense[:, j] @ left
                other[j] = np.sign(product) * max(abs(product) - penalty, 0) / squares[j]
                left -= dense[:, j] * other[j]
        assert worth(beta) <= worth(other) + 1e-6 * worth(other)
    assert bends.bend_lasso(t, y, free, 1.01 * most, places) == {}


def test_planted_bends_are_found_within_a_month():
    rng = np.random.default_rng(11)
    hits = 0
    for _ in range(40):
        first, second = int(rng.integers(25, 50)), int(rng.integers(70, 95))
        changes = {first: float(rng.choice([-1, 1])) * 2.0, second: float(rng.choice([-1, 1])) * 2.5}
        t, y = planted(rng, 120, changes, 1.0)
        found = bends.find_bends(t, y, np.stack([np.ones(120), t], axis=1))
        hits += len(found) == 2 and all(abs(a - b) <= 1 for a, b in zip(found, sorted(changes)))
    assert hits >= 38
    none = 0
    for _ in range(40):
        t, y = planted(rng, 120, {}, 1.0)
        none += bends.find_bends(t, y, np.stack([np.ones(120), t], axis=1)) == []
    assert none >= 36


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, changes in (("a", {40: 3.0, 77: -5.0}), ("b", {}), ("c", {60: -2.0})):
        _, y = planted(rng, 108, changes, 0.8, season=6.0)
        rows += [(k, month(i), float(v)) for i, v in enumerate(y) if not (k == "c" and i % 10 == 3)]
    rows += [("one", month(5), 7.0), ("few", month(1), 1.0), ("few", month(2), 3.0), ("none", month(1), None), ("flat", month(0), 4.0)]
    rows += [("flat", month(i), 4.0) for i in range(1, 60)]
    return bends.bent_trend_fit(panel(spark, rows), ["k"])


def test_dates_slopes_and_path(spark, model):
    dates = pandas_of(bends.change_dates(model, ["k"]))
    assert dates["k"].tolist() == ["a", "a", "c"]
    wanted = [month(40), month(77), month(60)]
    assert all(abs((d - w).days) <= 31 for d, w in zip(dates["ds"], wanted))
    assert np.allclose(dates["slope_before"], [0.5, 3.5, 0.5], atol=0.1)
    assert np.allclose(dates["slope_after"], [3.5, -1.5, -1.5], atol=0.1)
    out = pandas_of(bends.bent_trend_predict(model, ["k"], 6)).set_index("k")
    ahead = out.loc["a"][out.loc["a"]["is_future"]]
    t = np.arange(108, 114)
    truth = 50 + 0.5 * t + 3 * (t - 40) - 5 * (t - 77) + 6 * np.sin(2 * np.pi * t / 12)
    assert len(ahead) == 6 and np.abs(ahead["yhat"] - truth).max() < 3
    season = model.filter("k = 'a'").first()["season"]
    assert len(season) == 12 and abs(sum(season.values())) < 1e-9


def test_short_series_have_a_status(spark, model):
    rows = {r["k"]: r for r in model.collect()}
    assert set(rows) == {"a", "b", "c", "one", "few", "flat"}
    assert rows["one"]["status"] == rows["few"]["status"] == "level" and rows["a"]["status"] == "ok"
    assert rows["one"]["intercept"] == 7.0 and rows["few"]["intercept"] == 2.0
    assert rows["flat"]["bends"] == [] and abs(rows["flat"]["slope"]) < 1e-9
    path = bends.bent_trend_predict(model.filter("k = 'one'"), ["k"], 3).collect()
    assert [r["yhat"] for r in path] == [7.0] * 4


def test_without_keys_and_empty(spark):
    df = series(spark, [float(i) for i in range(40)])
    one = bends.bent_trend_fit(df.drop("k"), [], seasonal=False).first()
    assert one["status"] == "ok" and np.isclose(one["slope"], 1.0) and one["first_ds"] == dt.date(2020, 1, 1)
    assert bends.bent_trend_fit(df.filter(F.lit(False)), ["k"]).count() == 0
    assert bends.bent_trend_fit(df.filter(F.lit(False)).drop("k"), []).count() == 0

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from helpers import month, noisy_panel, pandas_of, series
from panelcast.config import BoostConfig
from panelcast.functions.spec import FeatureSpec, names
from panelcast.operators import boosted, explain, forecast, linear, structural, windows


def descend(x, y, alpha, rho, sweeps=20_000):
    """Plain coordinate descent on the data matrix, z-scored columns, centred target."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z, yc = (x - mean) / sd, y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(sweeps):
        old = w.copy()
        for j in range(len(w)):
            rest = z[:, j] @ (yc - z @ w + z[:, j] * w[j]) / len(y)
            den = z[:, j] @ z[:, j] / len(y) + alpha * (1 - rho)
            w[j] = np.sign(rest) * max(abs(rest) - alpha * rho, 0) / den if den else 0.0
        if np.abs(w - old).max() < 1e-13:
            break
    coef = w / sd
    return y.mean() - coef @ mean, coef


def objective(x, y, intercept, coef, alpha, rho):
    w = coef * x.std(0)
    loss = ((y - intercept - x @ coef) ** 2).mean() / 2
    return loss + alpha * rho * np.abs(w).sum() + alpha * (1 - rho) / 2 * (w @ w)


def design(seed, n=80, p=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 3
    if p > 2:
        x[:, 2] = x[:, 1] + 0.1 * rng.normal(size=n)
        x[:, -1] = 4.0
    y = 50 + x @ rng.normal(size=p) + rng.normal(size=n)
    return x, y


def to_rows(spark, blocks):
    p = blocks[0][0].shape[1]
    rows = [(f"s{b}", month(i), float(y[i]), *map(float, x[i])) for b, (x, y) in enumerate(blocks) for i in range(len(y))]
    return spark.createDataFrame(rows, "k string, ds date, y double, " + ", ".join(f"x{i} double" for i in range(p)))


@pytest.mark.parametrize("p", [5, 15])
@pytest.mark.parametrize("alpha,rho", [(0.5, 0.5), (1.0, 0.0), (0.1, 1.0)])
def test_per_series_elastic_net(spark, p, alpha, rho):
    blocks = [design(s, p=p) for s in (1, 2)]
    xs = [f"x{i}" for i in range(p)]
    model = linear.fit_linear(to_rows(spark, blocks), ["k"], "y", xs, alpha, rho)
    got = pandas_of(model, "k")
    for b, (x, y) in enumerate(blocks):
        intercept, coef = descend(x, y, alpha, rho)
        if rho < 1:
            assert np.allclose(got["coef"][b], coef, atol=1e-7)
        # Nearly equal columns make the lasso optimum flat: compare what is minimised.
        found = got["intercept"][b], got["coef"][b]
        assert objective(x, y, *found, alpha, rho) <= objective(x, y, intercept, coef, alpha, rho) + 1e-8
        assert np.isclose(got["sigma"][b], (y - found[0] - x @ found[1]).std())


@pytest.mark.parametrize("alpha,rho", [(0.5, 0.5), (1.0, 0.0)])
def test_pooled_elastic_net(spark, alpha, rho):
    x, y = design(5, n=120, p=4)
    model = linear.bridge_fit_pooled(to_rows(spark, [(x, y)]), "y", [f"x{i}" for i in range(4)], alpha, rho)
    intercept, coef = descend(x, y, alpha, rho)
    assert np.allclose(model.coef, coef, atol=1e-6) and np.isclose(model.intercept, intercept, atol=1e-5)
    assert np.isclose(model.sigma, (y - intercept - x @ coef).std(), atol=1e-6)


def test_short_series_gets_a_status_and_no_forecast(spark):
    df = to_rows(spark, [design(1, n=40, p=3), design(2, n=4, p=3)])
    model = linear.fit_linear(df, ["k"], "y", ["x0", "x1", "x2"])
    got = {r["k"]: r for r in model.collect()}
    assert got["s0"]["status"] == "ok" and got["s1"]["status"] == "short" and got["s1"]["coef"] is None
    scored = linear.predict_with_interval(model, df, ["k"], ["x0", "x1", "x2"])
    assert scored.filter("k = 's1' and yhat is not null").count() == 0
    assert scored.filter("k = 's0' and not (lower <= yhat and yhat <= upper)").count() == 0
    with pytest.raises(ValueError):
        linear.bridge_predict(df, df, ["k"], ["x0"])


def test_linear_contributions_add_up(spark):
    df = to_rows(spark, [design(3, p=3)])
    xs = ["x0", "x1", "x2"]
    model = linear.fit_linear(df, ["k"], "y", xs)
    phi = pandas_of(explain.linear_contributions(model, df, ["k"], xs), "ds").groupby("ds")["phi"].sum()
    yhat = pandas_of(linear.bridge_predict(model, df, ["k"], xs)).set_index("ds")["yhat"]
    y_mean = df.toPandas()["y"].mean()
    assert np.allclose(phi + y_mean, yhat)


def test_recursive_linear_forecast_matches_a_loop(spark):
    df = noisy_panel(spark, keys=("a", "b"))
    specs = [FeatureSpec("x1", "driver", "x1")]
    specs += [FeatureSpec(f"y_lag{k}", "target_lag", "y", k) for k in (1, 12)]
    specs += [FeatureSpec("y_rolling_mean_3m", "target_rolling", "y", 3), FeatureSpec("month_sin", "season")]
    rows = windows.lags(df, ["k"], "y", [1, 12])
    rows = windows.rolling_mean(rows, ["k"], ["y"], [3], shift=1)
    rows = rows.withColumns(windows.season_exprs("ds"))
    model = linear.fit_linear(rows, ["k"], "y", names(specs), 0.1, 0.5)
    got = pandas_of(forecast.recursive_forecast_linear(model, rows, ["k"], specs, "y", 12))
    fits = {r["k"]: r for r in model.collect()}
    for key, block in pandas_of(df).groupby("k"):
        y, x1 = block["y"].tolist(), block["x1"].iloc[-1]
        for i in range(12):
            m = month(72 + i).month
            f = [x1, y[-1], y[-12], np.mean(y[-3:]), math.sin(2 * math.pi * m / 12)]
            y.append(fits[key]["intercept"] + np.dot(fits[key]["coef"], f))
        part = got[got["k"] == key]
        assert np.allclose(part["yhat"], y[72:]) and part["ds"].tolist() == [month(72 + i) for i in range(12)]


def test_direct_forecast_with_one_feature(spark):
    df = noisy_panel(spark, keys=("a",))
    got = pandas_of(forecast.direct_forecast(df, ["k"], "y", ["y"], 3, 0.0, 0.0), "step")
    want = pandas_of(forecast.direct_forecast_ar1(df, ["k"], "y", 3), "step")
    assert np.allclose(got["yhat"], want["yhat"]) and got["ds"].tolist() == want["ds"].tolist()


def test_growth_path_and_timeline(spark):
    now = spark.createDataFrame([("a", month(12), 110.0, 100.0)], "k string, ds date, nowcast double, base double")
    path = pandas_of(forecast.growth_path(now, ["k"]))
    assert np.isclose(path["yhat"].iloc[-1], 121.0) and path["ds"].iloc[0] == month(13)
    point = spark.createDataFrame([("a", month(12), 110.0, 105.0, 115.0)], "k string, ds date, yhat double, lower double, upper double")
    line = forecast.stitched_series(series(spark, [100.0] * 12), point, forecast.growth_path(now, ["k"]), ["k"])
    assert [r["count"] for r in line.groupBy("segment").count().orderBy("segment").collect()] == [12, 12, 1]


def test_structural_components(spark):
    n = 48
    wave = 10 * np.sin(2 * np.pi * np.arange(n) / 12)
    rows = series(spark, [float(v) for v in 100 + 2.0 * np.arange(n) + wave])
    model = structural.structural_fit(rows, ["k"])
    out = pandas_of(structural.structural_predict(model, ["k"], 12))
    assert len(out) == 60 and out["is_future"].sum() == 12
    assert np.allclose(out["yhat"], out["trend"] + out["seasonal"])
    assert (out["lower"] <= out["yhat"]).all() and (out["yhat"] <= out["upper"]).all()
    fitted = out["yhat"][:n].to_numpy()
    assert np.isclose(model.first()["sigma"], (rows.toPandas()["y"] - fitted).std(ddof=0))
    scaled = structural.structural_fit(rows, ["k"], mode="multiplicative")
    double = pandas_of(structural.structural_predict(scaled, ["k"], 12))
    assert np.isclose(scaled.first()["sigma"], (rows.toPandas()["y"] - double["yhat"][:n]).std(ddof=0))
    with pytest.raises(ValueError):
        structural.structural_fit(rows, ["k"], mode="other")


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_piecewise_follows_a_bend_and_a_season(spark, mode):
    n = 96
    t = np.arange(n)
    trend = 100 + t + np.maximum(t - 48, 0) * 2.0
    season = np.sin(2 * np.pi * t / 12)
    y = trend + 8 * season if mode == "additive" else trend * (1 + 0.05 * season)
    df = series(spark, [float(v) for v in y])
    model = structural.piecewise_fit(df, ["k"], knot_penalty=0.01, mode=mode)
    out = pandas_of(structural.piecewise_predict(model, ["k"], 12))
    fitted = out["yhat"][:n].to_numpy()
    assert np.abs(fitted - y).mean() < 0.03 * y.mean()
    assert np.isclose(model.first()["sigma"], (y - fitted).std(), rtol=1e-6)
    future = np.arange(n, n + 12)
    want = 100 + future + (future - 48) * 2.0
    assert np.abs(out["yhat"][n:].to_numpy() / want - 1).max() < 0.12


@pytest.fixture(scope="module")
def trees(spark):
    df = noisy_panel(spark)
    specs = windows.ar_feature_specs("y", ["x1", "x2"], ks=(1, 12), windows=(3,))
    rows = windows.ar_features(df, ["k"], "y", ["x1", "x2"], ks=(1, 12), windows=(3,)).cache()
    model = boosted.boosted_fit(rows, ["k"], "y", names(specs), BoostConfig(max_depth=3, n_estimators=5, learning_rate=0.3))
    return model, rows, specs


def test_boosted_beats_the_mean_and_reports_sigma(spark, trees):
    model, rows, _ = trees
    out = pandas_of(model.predict_with_interval(rows))
    for _, block in out.groupby("k"):
        assert (block["y"] - block["yhat"]).std(ddof=0) < 0.8 * block["y"].std(ddof=0)
        assert np.isclose(block["sigma"].iloc[0], (block["y"] - block["yhat"]).std(ddof=0))
    assert ((out["lower"] <= out["yhat"]) & (out["yhat"] <= out["upper"])).all()


def test_importances_cover_the_design(spark, trees):
    model, _, specs = trees
    gain = boosted.gain_importance(model).toPandas()
    assert sorted(gain["feature"]) == sorted(names(specs)) and np.isclose(gain["importance"].sum(), 1)
    counts = boosted.split_counts(model).toPandas()
    assert sorted(counts["feature"]) == sorted(names(specs))
    internal = sum((t.numNodes - 1) // 2 for t in model.trees.trees)
    assert counts["importance"].sum() == internal


def test_recursive_trees_match_a_loop(spark, trees):
    model, rows, specs = trees
    got = pandas_of(boosted.recursive_forecast_boosted(model, rows, specs, "y", 4))
    hist = pandas_of(rows)
    for key, block in hist.groupby("k"):
        y, last = block["y"].tolist(), block.iloc[-1]
        for i in range(4):
            d = pd.Timestamp(month(72 + i))
            f = {"y_lag1": y[-1], "y_lag12": y[-12], "month": d.month, "quarter": d.quarter, "day_of_year": d.dayofyear}
            for part, size in (("month", 12), ("quarter", 4)):
                f[f"{part}_sin"] = np.sin(2 * np.pi * f[part] / size)
                f[f"{part}_cos"] = np.cos(2 * np.pi * f[part] / size)
            row = {x: float(f.get(x, last[x])) for x in names(specs)}
            step = spark.createDataFrame([(key, *row.values())], "k string, " + ", ".join(f"{x} double" for x in row))
            y.append(model.predict(step).first()["yhat"])
        assert np.allclose(got[got["k"] == key]["yhat"], y[-4:])


def brute_shapley(x, leaves):
    """Shapley values by listing every coalition of the features in use."""
    feats = sorted({f for leaf in leaves for f in leaf.features})

    def worth(known):
        total = 0.0
        for leaf in leaves:
            part = leaf.value
            for f, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                part *= float(lo < x[f] <= hi) if f in known else share
            total += part
        return total

    phi = np.zeros(len(x))
    for f in feats:
        others = [g for g in feats if g != f]
        for size in range(len(others) + 1):
            weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(feats))
            for known in itertools.combinations(others, size):
                phi[f] += weight * (worth({*known, f}) - worth(set(known)))
    return phi


def test_tree_contributions_add_up_and_match_all_coalitions(spark, trees):
    model, rows, specs = trees
    long, base = explain.tree_contributions(model, rows)
    wide = pandas_of(long).pivot_table(index=["k", "ds"], columns="feature", values="phi")
    scored = pandas_of(model.predict(rows)).set_index(["k", "ds"])
    scales = {r["k"]: r for r in model.scales.collect()}
    ym = scored.index.get_level_values("k").map(lambda k: scales[k]["_ym"])
    ys = scored.index.get_level_values("k").map(lambda k: scales[k]["_ys"])
    assert np.allclose(wide.sum(axis=1) + ym + ys * base, scored["yhat"])

    nodes, weights = boosted.saved_nodes(model)
    flat = nodes.selectExpr(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction",
        "nodeData.split.featureIndex as feature", "get(nodeData.split.leftCategoriesOrThreshold, 0) as threshold",
        "double(nodeData.rawCount) as cover",
    ).toPandas()
    leaves, _ = explain._leaves(flat, weights)
    xs = names(specs)
    for at in (0, 57):
        row = scored.iloc[at]
        s = scales[scored.index[at][0]]
        z = (row[xs].to_numpy(dtype=float) - np.array(s["_xm"])) / np.array(s["_xs"])
        few = [leaf for leaf in leaves if len(leaf.features) <= 3][:12]
        assert np.allclose(explain.shapley_values(z[None, :], few)[0], brute_shapley(z, few))
    score = explain.global_attribution(long, ["k"])
    assert score.count() == 2 * len(xs)


def random_leaves(rng, depth, trees, features):
    """Leaves of full random trees: cut at random places, features drawn again and again."""
    out = []
    for _ in range(trees):
        def grow(level, path):
            if level == depth:
                feats = list(path)
                low, high, share = (np.array([path[f][i] for f in feats]) for i in range(3))
                out.append(explain._Leaf(float(rng.normal()), feats, low, high, share))
                return
            f = int(rng.integers(features))
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            cut = float(rng.normal()) if not (low < 0 < high) else 0.1 * float(rng.normal())
            cut = min(max(cut, low), high)
            kept = float(rng.uniform(0.02, 0.98))
            grow(level + 1, {**path, f: (low, cut, share * kept)})
            grow(level + 1, {**path, f: (cut, high, share * (1 - kept))})
        grow(0, {})
    return out


def table_shapley(x, leaves):
    """The same by a table of all inside-or-not patterns of a leaf, for every row apart."""
    phi = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        weights = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        inside = ((x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)).astype(float)
        for pattern in {tuple(p) for p in inside}:
            rows = (inside == pattern).all(1)
            for i, f in enumerate(leaf.features):
                poly = np.ones(1)
                for j in range(d):
                    if j != i:
                        poly = np.convolve(poly, [leaf.share[j], pattern[j]])
                phi[rows, f] += leaf.value * (pattern[i] - leaf.share[i]) * (poly @ weights)
    return phi


def test_path_attributions_equal_coalitions_and_tables():
    rng = np.random.default_rng(1)
    leaves = random_leaves(rng, 4, 3, 6)
    x = rng.normal(size=(7, 6))
    got = explain.shapley_values(x, leaves)
    for row, phi in zip(x, got):
        assert np.allclose(phi, brute_shapley(row, leaves))
    leaves = random_leaves(rng, 8, 2, 12)
    x = rng.normal(size=(40, 12))
    assert np.allclose(explain.shapley_values(x, leaves), table_shapley(x, leaves), atol=1e-12)
    # Some leaves and some rows at a time.
    assert np.allclose(explain.shapley_values(x, leaves, cells=100), table_shapley(x, leaves), atol=1e-12)


def test_deep_paths_add_up_in_flat_memory():
    import tracemalloc

    peaks = {}
    for depth in (6, 16):
        rng = np.random.default_rng(depth)
        leaves = [leaf for leaf in random_leaves(rng, depth, 1, 40) if len(leaf.features) >= depth - 3][:400]
        x = rng.normal(size=(600, 40))
        tracemalloc.start()
        phi = explain.shapley_values(x, leaves, cells=1 << 16)
        peaks[depth] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        worth = np.zeros(len(x))
        for leaf in leaves:
            z = x[:, leaf.features]
            worth += leaf.value * (((z > leaf.low) & (z <= leaf.high)).all(1) - np.prod(leaf.share))
        assert np.allclose(phi.sum(1), worth, atol=1e-9)
    assert peaks[16] < 2 * peaks[6]

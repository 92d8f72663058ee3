"""Cross-validation from moments against refits on rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate, foldfit, linear
from helpers import month, noisy_panel, panel

XS = ["x1", "x2"]
ALPHAS = (0.02, 0.3, 1.0)


@pytest.fixture(scope="module")
def rows(spark):
    df = noisy_panel(spark, keys=("a", "b", "c"))
    # Holes in target and design, and a series too short for its early folds.
    holes = F.when((F.col("k") == "b") & (F.month("ds") % 5 == 0), None).otherwise(F.col("x1"))
    df = df.withColumn("x1", holes).filter(~((F.col("k") == "c") & (F.col("ds") < month(46))))
    one = [("d", month(i), float(i), 1.0, 2.0) for i in range(3)]
    return df.unionByName(panel(spark, one, "k string, ds date, y double, x1 double, x2 double")).cache()


def loop(rows, keys, alpha, l1_ratio, pooled=False):
    folds = evaluate.expanding_folds(rows, ["k"], 4, 6)
    by = ["fold"] if pooled else ["k", "fold"]
    models = linear.fit_linear(folds.filter("split = 'train'"), by, "y", XS, alpha, l1_ratio)
    test = linear.bridge_predict(models, folds.filter("split = 'test'"), by, XS).filter("yhat is not null and y is not null")
    error = test.groupBy(*by).agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("rmse"), F.count("y").alias("n_test"))
    out = models.join(error, by, "left").collect()
    return {tuple(r[c] for c in by): r for r in out if r["status"] == "ok"}


@pytest.mark.parametrize("pooled", [False, True])
@pytest.mark.parametrize("l1_ratio", [0.0, 0.5, 1.0])
def test_equals_refits(spark, rows, l1_ratio, pooled):
    got = foldfit.fold_fits(rows, ["k"], "y", XS, ALPHAS, l1_ratio, 4, 6, pooled=pooled).collect()
    assert len(got) == (1 if pooled else 4) * 5 * 3
    for alpha in ALPHAS:
        want = loop(rows, ["k"], alpha, l1_ratio, pooled)
        mine = {((r["fold"],) if pooled else (r["k"], r["fold"])): r for r in got if r["alpha"] == alpha}
        assert {k for k, r in mine.items() if r["status"] == "ok" and k[-1] < 5} == set(want)
        for key, w in want.items():
            r = mine[key]
            assert r["n"] == w["n"]
            for c in ("intercept", "sigma", "rmse"):
                assert (r[c] is None) == (w[c] is None) and (r[c] is None or np.isclose(r[c], w[c], rtol=1e-6)), (key, c)
            assert np.allclose(r["coef"], w["coef"], rtol=1e-6, atol=1e-9)
            assert np.allclose(r["x_mean"], w["x_mean"]) and (w["rmse"] is None or r["n_test"] == w["n_test"])
    assert all(r["coef"] is None and r["rmse"] is None and r["intercept"] is None for r in got if r["status"] == "short")


def test_the_best_alpha_fits_all_rows(spark, rows):
    fits = foldfit.fold_fits(rows, ["k"], "y", XS, ALPHAS, 0.5, 4, 6).cache()
    chosen = {r["k"]: r for r in foldfit.choose_alpha(fits, ["k"]).collect()}
    model = {r["k"]: r for r in foldfit.bridge_fit_cv(fits, ["k"]).collect()}
    table: dict = {}
    for r in fits.collect():
        if r["rmse"] is not None:
            table.setdefault((r["k"], r["alpha"]), []).append((r["n_test"], r["rmse"]))
    for k in ("a", "b", "c"):
        scores = {a: np.sqrt(sum(n * e * e for n, e in v) / sum(n for n, _ in v)) for (s, a), v in table.items() if s == k}
        best = min(scores, key=scores.get)
        assert chosen[k]["alpha"] == best == model[k]["alpha"] and np.isclose(chosen[k]["rmse"], scores[best])
        whole = linear.fit_linear(rows.filter(F.col("k") == k), ["k"], "y", XS, best, 0.5).first()
        assert np.allclose(model[k]["coef"], whole["coef"], rtol=1e-6) and model[k]["n"] == whole["n"]
    assert chosen["d"]["alpha"] is None and model["d"]["status"] == "short"
    assert linear.bridge_predict(foldfit.bridge_fit_cv(fits, ["k"]), rows, ["k"], XS).filter("k = 'a'").count() == 72


def test_rows_are_shuffled_once(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    for pooled, shuffles in ((False, 1), (True, 3)):
        fits = foldfit.fold_fits(stored, ["k"], "y", XS, ALPHAS, 0.5, 4, 6, pooled=pooled)
        plan = fits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") == shuffles


def test_one_series_and_empty(spark, rows):
    one = foldfit.fold_fits(rows.filter("k = 'a'").drop("k"), [], "y", XS, (0.1,), 0.5, 3, 6).collect()
    assert [r["fold"] for r in one] == [1, 2, 3, 4] and {r["status"] for r in one} == {"ok"}
    none = foldfit.fold_fits(rows.filter("k = 'z'"), ["k"], "y", XS)
    assert none.count() == 0 and foldfit.choose_alpha(none, ["k"]).count() == 0
    with pytest.raises(ValueError):
        foldfit.fold_fits(rows, ["k"], "y", XS, ())

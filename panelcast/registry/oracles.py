"""Oracle SQL (DuckDB) of the registered queries."""

from __future__ import annotations

from panelcast.registry.common import DRIVERS, digits_of
from panelcast.registry.sqlparts import OPEN_MONTH, cte, r, with_ctes

ORACLES: dict[str, str] = {}


def oracle(name: str, final: str, *needs: str) -> None:
    ORACLES[name] = with_ctes(final, *needs)


MONTH = "CAST(date_trunc('month', {}) AS DATE)"
W = "OVER (PARTITION BY series ORDER BY ds)"
ALL = "OVER (PARTITION BY series)"

# ---- sources, sinks, calendars
oracle("a1_read_panel", "SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders")
oracle(
    "a2_time_slice",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders
WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate <= DATE '1998-06-30'""",
)
cte(
    "revm",
    f"""SELECT series, {MONTH.format('ds')} AS ds, CAST(sum(CAST(rev AS DECIMAL(28,4))) AS DOUBLE) AS y
FROM dp GROUP BY 1, 2""",
    "dp",
)
oracle(
    "a3_merge_sources",
    f"""SELECT coalesce(a.series, b.series) AS series, coalesce(a.ds, b.ds) AS ds,
  {r('coalesce(a.y, b.y)')} AS y,
  CASE WHEN a.series IS NULL THEN 'fallback' WHEN b.series IS NULL THEN 'primary' ELSE 'both' END AS origin
FROM mp a FULL OUTER JOIN revm b ON a.series = b.series AND a.ds = b.ds""",
    "mp", "revm",
)
cte(
    "obounds",
    """SELECT o_orderpriority, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi
FROM orders GROUP BY 1""",
)
oracle(
    "a4_calendar_spine",
    """SELECT o_orderpriority, CAST(ds AS DATE) AS ds, freq FROM (
  SELECT o_orderpriority, 'D' AS freq, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds FROM obounds
  UNION ALL SELECT o_orderpriority, 'W-SUN',
    unnest(generate_series(CAST(lo + CAST(7 - isodow(lo) AS INTEGER) AS DATE), hi, INTERVAL 7 DAY)) FROM obounds
  UNION ALL SELECT o_orderpriority, 'MS',
    unnest(generate_series(CASE WHEN day(lo) = 1 THEN lo
      ELSE CAST(date_trunc('month', lo) + INTERVAL 1 MONTH AS DATE) END, hi, INTERVAL 1 MONTH)) FROM obounds)""",
    "obounds",
)
oracle("a5_gap_fill", "SELECT series, ds, y FROM target", "target")
oracle(
    "a5_missing_periods",
    "SELECT t.series, t.ds FROM target t ANTI JOIN np ON np.series = t.series AND np.ds = t.ds",
    "target", "np",
)
oracle(
    "a5_gap_fill_daily",
    """SELECT s.series, CAST(s.ds AS DATE) AS ds, qty FROM
(SELECT series, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM dp GROUP BY series) s
LEFT JOIN dp ON dp.series = s.series AND dp.ds = CAST(s.ds AS DATE)""",
    "dp",
)
oracle(
    "a6_future_spine",
    """SELECT series, CAST(last + to_months(step) AS DATE) AS ds, step FROM
(SELECT series, max(ds) AS last FROM np GROUP BY 1), (SELECT CAST(range AS INTEGER) AS step FROM range(1, 13))""",
    "np",
)
oracle(
    "a7_assemble_wide",
    f"""SELECT series, ds, {r('y')} AS y, {r('production')} AS production,
{', '.join(f'{r(d, digits_of(d))} AS {d}' for d in DRIVERS[1:])} FROM macro0""",
    "macro0",
)
# The market segments of the test tables, which the pivots have a column for each.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
oracle(
    "a8_pivot_series",
    "SELECT ds, " + ", ".join(f"max(y) FILTER (WHERE series = '{s}') AS {s}" for s in SEGMENTS) + " FROM mp GROUP BY ds",
    "mp",
)
oracle(
    "a8_melt_series",
    """SELECT series, ds, 'qty' AS measure, qty AS value FROM dp
UNION ALL SELECT series, ds, 'rev', rev FROM dp""",
    "dp",
)
oracle("a9_dedupe_columns", "SELECT series, ds, idx FROM wp", "wp")
oracle("a10_write_report", "SELECT series, ds, y FROM np", "np")
oracle("a10_store_panel", "SELECT series, ds, y FROM np", "np")

# ---- projections, filters, scalar functions
oracle(
    "b1_date_parts",
    """SELECT series, ds, CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter,
CAST(dayofyear(ds) AS INTEGER) AS day_of_year FROM dp""",
    "dp",
)
CYCLE = {
    "month_sin": "sin(2 * pi() * month(ds) / 12)", "month_cos": "cos(2 * pi() * month(ds) / 12)",
    "quarter_sin": "sin(2 * pi() * quarter(ds) / 4)", "quarter_cos": "cos(2 * pi() * quarter(ds) / 4)",
}
CYCLE_SQL = ", ".join(f"{r(e, 6)} AS {n}" for n, e in CYCLE.items())
oracle("b2_cyclical", f"SELECT series, ds, {CYCLE_SQL} FROM dp", "dp")
oracle(
    "b3_month_dummies",
    "SELECT series, ds, y, "
    + ", ".join(f"CAST(month(ds) = {m} AS INTEGER) AS month_{m}" for m in range(1, 13)) + " FROM np",
    "np",
)
DRIVER_SQL = f"{r('production')} AS production, " + ", ".join(f"{r(d, digits_of(d))} AS {d}" for d in DRIVERS[1:])
oracle("b4_split_xy", f"SELECT series, ds, {DRIVER_SQL} FROM macro0", "macro0")
LAGS = (1, 3, 6, 12)
cte("lagged4", "SELECT series, ds, y, " + ", ".join(f"lag(y, {k}) {W} AS y_lag{k}" for k in LAGS) + " FROM target", "target")
COMPLETE4 = " AND ".join(f"{c} IS NOT NULL" for c in ["y"] + [f"y_lag{k}" for k in LAGS])
oracle("b5_drop_incomplete", f"SELECT * FROM lagged4 WHERE {COMPLETE4}", "lagged4")
oracle(
    "b5_incomplete_counts",
    f"""SELECT series, count(*) AS n_rows, count(*) FILTER (WHERE {COMPLETE4}) AS n_kept,
count(*) - count(*) FILTER (WHERE {COMPLETE4}) AS n_dropped FROM lagged4 GROUP BY 1""",
    "lagged4",
)
oracle("b6_cutoff_filter", "SELECT * FROM dp WHERE day(ds) <= 20", "dp")
oracle("b7_month_floor", f"SELECT {MONTH.format('l_shipdate')} AS ds, count(*) AS n FROM lineitem GROUP BY 1")
oracle(
    "b8_row_total",
    "SELECT ds, " + ", ".join(f"max(qty) FILTER (WHERE series = '{s}') AS {s}" for s in SEGMENTS)
    + ", round(coalesce(sum(qty) FILTER (WHERE series IS NOT NULL), 0.0), 2) AS total FROM dp GROUP BY ds",
    "dp",
)
oracle(
    "b9_clip",
    f"""SELECT series, ds, {r('CASE WHEN policy_rate IS NULL THEN NULL ELSE greatest(0.048::DOUBLE, least(0.052::DOUBLE, policy_rate)) END', 10)} AS policy_rate
FROM macro0""",
    "macro0",
)
FACTOR = "CASE isodow(ds) WHEN 6 THEN 0.75::DOUBLE WHEN 7 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END"
oracle(
    "b10_weekday_factor",
    f"SELECT series, ds, {r('qty')} AS qty, {r(FACTOR)} AS factor, {r(f'qty / ({FACTOR})')} AS adjusted FROM dp",
    "dp",
)
cte(
    "flat",
    """SELECT series, CAST(last + to_months(step) AS DATE) AS ds, yhat FROM
(SELECT series, max(ds) AS last, max_by(y, ds) FILTER (WHERE y IS NOT NULL) AS yhat FROM known GROUP BY 1),
(SELECT CAST(range AS INTEGER) AS step FROM range(1, 13))""",
    "known",
)
SCEN = "(VALUES ('pessimista', -1.0::DOUBLE), ('base', 0.0::DOUBLE), ('otimista', 1.0::DOUBLE)) s(scenario, shock)"
cte("paths", f"SELECT series, ds, scenario, yhat * (1 + shock * 0.02::DOUBLE) AS yhat FROM flat, {SCEN}", "flat")
oracle("b11_scenario_path", f"SELECT series, ds, scenario, {r('yhat')} AS yhat FROM paths", "paths")
oracle(
    "b12_scenario_inputs",
    f"""SELECT series, ds, scenario,
{r(f'production + coalesce(shock * sp * 0.5, 0)', 2)} AS production,
{r(f'unemployment + coalesce(shock * su * -0.5, 0)', 10)} AS unemployment,
{r(f'policy_rate + coalesce(shock * sr * 0.3, 0)', 10)} AS policy_rate
FROM (SELECT *, stddev_samp(production) {ALL} AS sp, stddev_samp(unemployment) {ALL} AS su,
      stddev_samp(policy_rate) {ALL} AS sr FROM macro), {SCEN}""",
    "macro",
)
oracle("b14_fill_zero", "SELECT series, ds, coalesce(y, 0) AS y FROM target", "target")
GAIN = "(base_rmse - rmse) / nullif(base_rmse, 0) * 100"
cte(
    "scored",
    "SELECT *, max(CASE WHEN model = 'naive' THEN rmse END) OVER (PARTITION BY series) AS base_rmse FROM metrics",
    "metrics",
)
oracle(
    "b15_round_report",
    f"""SELECT series, model, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape,
round({GAIN}, 2) AS gain_pct FROM scored""",
    "scored",
)
oracle(
    "b16_growth_path",
    f"""SELECT series, CAST(last + to_months(step) AS DATE) AS ds,
{r('nowcast * pow(1 + (pow(1 + (nowcast - base) / nullif(base, 0), 1.0 / 12) - 1), step)', 2)} AS yhat FROM
(SELECT series, max(ds) AS last, max_by(y, ds) FILTER (WHERE back = 1) AS nowcast,
        max(CASE WHEN back = 12 THEN y END) AS base
 FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back FROM known) GROUP BY 1
 HAVING count(*) >= 12),
(SELECT CAST(range AS INTEGER) AS step FROM range(1, 13))""",
    "known",
)
cte("sigmas", "SELECT series, model, stddev_pop(y - yhat) AS sigma FROM pred GROUP BY 1, 2", "pred")
oracle(
    "b17_interval",
    f"""SELECT series, model, ds, {r('y')} AS y, {r('yhat')} AS yhat, {r('sigma')} AS sigma,
{r('yhat - sigma * 1.96')} AS lower, {r('yhat + sigma * 1.96')} AS upper
FROM pred JOIN sigmas USING (series, model)""",
    "pred", "sigmas",
)
oracle(
    "b18_residuals",
    f"SELECT series, ds, model, {r('y')} AS y, {r('yhat')} AS yhat, {r('y - yhat')} AS residual FROM pred",
    "pred",
)

# ---- joins
cte(
    "daily20",
    f"""SELECT series, {MONTH.format('dp.ds')} AS ds, avg(qty) AS qty_mean, stddev_samp(qty) AS qty_std,
max_by(qty, dp.ds) AS qty_last, avg(rev) AS rev_mean, stddev_samp(rev) AS rev_std, max_by(rev, dp.ds) AS rev_last
FROM dp WHERE day(dp.ds) <= 20 GROUP BY series, {MONTH.format('dp.ds')}""",
    "dp",
)
cte(
    "weekly20",
    f"""SELECT series, {MONTH.format('wp.ds')} AS ds, avg(idx) AS idx_mean, max_by(idx, wp.ds) AS idx_last
FROM wp WHERE day(wp.ds) <= 20 GROUP BY series, {MONTH.format('wp.ds')}""",
    "wp",
)
oracle(
    "c1_join_frequencies",
    f"""SELECT coalesce(d.series, w.series) AS series, coalesce(d.ds, w.ds) AS ds,
{', '.join(f'{r(c)} AS {c}' for c in ('qty_mean', 'qty_std', 'qty_last', 'idx_mean', 'idx_last'))}
FROM daily20 d FULL OUTER JOIN weekly20 w ON d.series = w.series AND d.ds = w.ds""",
    "daily20", "weekly20",
)
oracle(
    "c2_join_target",
    f"""SELECT coalesce(d.series, t.series) AS series, coalesce(d.ds, t.ds) AS ds, {r('y')} AS y,
{', '.join(f'{r(c)} AS {c}' for c in ('qty_mean', 'qty_std', 'qty_last'))}
FROM daily20 d FULL OUTER JOIN mp t ON d.series = t.series AND d.ds = t.ds""",
    "daily20", "mp",
)
oracle(
    "c3_expand_folds",
    """SELECT series, ds, y, fold, CASE WHEN ds < test_start THEN 'train' ELSE 'test' END AS split
FROM known JOIN (SELECT CAST(range AS INTEGER) AS fold,
  CAST(m + to_months(CAST((range - 6) * 12 + 1 AS INTEGER)) AS DATE) AS test_start,
  CAST(m + to_months(CAST((range - 5) * 12 + 1 AS INTEGER)) AS DATE) AS test_end
  FROM (SELECT max(ds) AS m FROM known), range(1, 6)) f ON ds < test_end""",
    "known",
)
oracle(
    "c4_cross_params",
    "SELECT series, ds, y, CAST(unnest([10, 20, 30]) AS INTEGER) AS cutoff FROM np",
    "np",
)
oracle(
    "c5_align_eval",
    """SELECT k.series, k.ds, 'flat' AS model, yhat, y FROM known k JOIN (
  SELECT series, CAST(last + to_months(step) AS DATE) AS ds, yhat FROM
  (SELECT series, max(ds) AS last, max_by(y, ds) FILTER (WHERE y IS NOT NULL) AS yhat FROM
   (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back FROM known)
   WHERE back > 12 GROUP BY 1),
  (SELECT CAST(range AS INTEGER) AS step FROM range(1, 13))) p ON p.series = k.series AND p.ds = k.ds""",
    "known",
)
ERR = f"{r('rmse')} AS rmse, {r('mae')} AS mae, {r('mape', 8)} AS mape"
oracle("c6_attach_baseline", f"SELECT series, model, {ERR}, {r('base_rmse')} AS base_rmse FROM scored", "scored")

# ---- aggregations
oracle(
    "d1_daily_to_monthly",
    "SELECT series, ds, " + ", ".join(
        f"{r(f'{c}_{s}', digits_of(f'{c}_{s}'))} AS {c}_{s}" for c in ("qty", "rev") for s in ("mean", "std", "last")) + " FROM daily20",
    "daily20",
)
oracle("d2_weekly_to_monthly", f"SELECT series, ds, {r('idx_mean')} AS idx_mean, {r('idx_last')} AS idx_last FROM weekly20", "weekly20")
VALUES = ["y", *DRIVERS]
oracle(
    "d3_null_profile",
    " UNION ALL ".join(
        f"SELECT series, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM macro GROUP BY 1" for c in VALUES),
    "macro",
)
oracle(
    "d4_duplicate_rows",
    """SELECT series, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM
(SELECT series, qty, n_lines, count(*) AS n FROM dp GROUP BY 1, 2, 3) GROUP BY 1""",
    "dp",
)


def describe(source: str, col: str, keys: str, digits: int) -> str:
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    stats = {
        "mean": f"avg({col})", "std": f"stddev_samp({col})", "min": f"min({col})",
        "p25": f"quantile_cont({col}, 0.25)", "p50": f"quantile_cont({col}, 0.5)",
        "p75": f"quantile_cont({col}, 0.75)", "max": f"max({col})",
    }
    cols = ", ".join(f'{r(e, digits)} AS "{n}"' for n, e in stats.items())
    return f"SELECT {lead}'{col}' AS \"column\", count({col}) AS \"count\", {cols} FROM {source}{group}"


oracle("d5_describe_panel", " UNION ALL ".join(describe("dp", c, "series", 2) for c in ("qty", "rev")), "dp")
oracle(
    "d5_describe_whole_table",
    " UNION ALL ".join(describe("lineitem", c, "", 4) for c in ("l_quantity", "l_extendedprice", "l_tax")),
)
NULLS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in VALUES)
oracle(
    "d6_quality_verdict",
    f"""SELECT series, n_rows, n_null, n_rows - n_distinct AS n_duplicates, CAST({len(VALUES)} AS INTEGER) AS n_cols,
n_null = 0 AND n_rows = n_distinct AND n_rows > 36 AS is_valid FROM
(SELECT series, count(*) AS n_rows, CAST(sum({NULLS}) AS BIGINT) AS n_null,
 count(DISTINCT ({', '.join(VALUES)})) AS n_distinct FROM macro GROUP BY 1)""",
    "macro",
)
oracle(
    "d7_series_sigma",
    "SELECT series, " + ", ".join(
        f"{r(f'stddev_samp({d})', 2 if d == 'production' else digits_of(d))} AS {d}_sigma" for d in DRIVERS) + " FROM macro GROUP BY 1",
    "macro",
)
oracle("d8_error_metrics", f"SELECT series, model, {ERR} FROM metrics", "metrics")
oracle(
    "d8_predictions_wide",
    f"""SELECT series, ds, {r('max(y)')} AS y, {r("max(CASE WHEN model = 'naive' THEN yhat END)")} AS naive,
{r("max(CASE WHEN model = 'seasonal' THEN yhat END)")} AS seasonal FROM pred GROUP BY 1, 2""",
    "pred",
)
oracle(
    "d9_mase",
    f"SELECT series, model, {r('CASE WHEN naive_step > 0 THEN mae / naive_step ELSE 0 END', 8)} AS mase FROM metrics",
    "metrics",
)
cte(
    "split_known",
    "SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 12 THEN 'test' ELSE 'train' END AS split FROM known",
    "known",
)
oracle(
    "d9_mase_train_scale",
    f"""SELECT m.series, model, {r('CASE WHEN s > 0 THEN mae / s ELSE 0 END', 8)} AS mase FROM metrics m LEFT JOIN
(SELECT series, avg(step) AS s FROM (SELECT series, abs(y - lag(y) {W}) AS step FROM split_known WHERE split = 'train')
 GROUP BY 1) t ON t.series = m.series""",
    "metrics", "split_known",
)
oracle(
    "d10_gain_vs_baseline",
    f"""SELECT series, model, {ERR}, {r('CASE WHEN naive_step > 0 THEN mae / naive_step ELSE 0 END', 8)} AS mase,
{r(GAIN, 4)} AS gain_pct FROM scored""",
    "scored",
)
cte(
    "best",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rmse, model) AS place FROM metrics)
WHERE place = 1""",
    "metrics",
)
oracle("d11_best_model", f"SELECT series, model, {ERR} FROM best", "best")
oracle("d12_residual_sigma", f"SELECT series, model, {r('sigma')} AS sigma FROM sigmas", "sigmas")

# Ridge on three lags, alpha 1, in closed form: (C + I) w = corr(x, y) * sd(y), by Cramer's rule.
LX = ("y_lag1", "y_lag2", "y_lag12")
cte(
    "lagged3",
    f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 12 THEN 'test' ELSE 'train' END AS split
FROM (SELECT series, ds, y, lag(y, 1) {W} AS y_lag1, lag(y, 2) {W} AS y_lag2, lag(y, 12) {W} AS y_lag12 FROM known)""",
    "known",
)
HAVE = " AND ".join(f"{x} IS NOT NULL" for x in LX)
cte(
    "mom3",
    "SELECT series, count(*) AS n, avg(y) AS my, "
    + ", ".join(f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}, covar_pop({x}, y) / stddev_pop({x}) AS r{i}" for i, x in enumerate(LX, 1))
    + ", corr(y_lag1, y_lag2) AS c12, corr(y_lag1, y_lag12) AS c13, corr(y_lag2, y_lag12) AS c23"
    + f" FROM lagged3 WHERE split = 'train' AND y IS NOT NULL AND {HAVE} GROUP BY 1",
    "lagged3",
)
cte(
    "ridge",
    """SELECT series, n, m1, m2, m3, w1 / s1 AS b1, w2 / s2 AS b2, w3 / s3 AS b3,
my - w1 / s1 * m1 - w2 / s2 * m2 - w3 / s3 * m3 AS b0 FROM (
SELECT *,
 (r1 * (4 - c23 * c23) - c12 * (2 * r2 - c23 * r3) + c13 * (r2 * c23 - 2 * r3)) / det AS w1,
 (2 * (2 * r2 - c23 * r3) - r1 * (2 * c12 - c23 * c13) + c13 * (c12 * r3 - r2 * c13)) / det AS w2,
 (2 * (2 * r3 - r2 * c23) - c12 * (c12 * r3 - r2 * c13) + r1 * (c12 * c23 - 2 * c13)) / det AS w3
FROM (SELECT *, 2 * (4 - c23 * c23) - c12 * (2 * c12 - c23 * c13) + c13 * (c12 * c23 - 2 * c13) AS det
      FROM mom3 WHERE n >= 5))""",
    "mom3",
)
FIT3 = "b0 + b1 * y_lag1 + b2 * y_lag2 + b3 * y_lag12"
cte(
    "ridge_sigma",
    f"""SELECT series, stddev_pop(y - ({FIT3})) AS sigma FROM lagged3 JOIN ridge USING (series)
WHERE split = 'train' AND y IS NOT NULL AND {HAVE} GROUP BY 1""",
    "lagged3", "ridge",
)
oracle(
    "h3_ar_baseline_fit",
    f"""SELECT m.series, m.n, {r('b0', 2)} AS intercept, {r('b1')} AS c_y_lag1, {r('b2')} AS c_y_lag2,
{r('b3')} AS c_y_lag12, {r('sigma', 2)} AS sigma
FROM mom3 m LEFT JOIN ridge USING (series) LEFT JOIN ridge_sigma USING (series)""",
    "mom3", "ridge", "ridge_sigma",
)
oracle(
    "h4_bridge_predict",
    f"""SELECT series, ds, {r('y')} AS y, {r(FIT3, 2)} AS yhat FROM lagged3 LEFT JOIN ridge USING (series)
WHERE split = 'test'""",
    "lagged3", "ridge",
)
oracle(
    "h5_predict_with_interval",
    f"""SELECT series, ds, {r(FIT3, 2)} AS yhat, {r(f'{FIT3} - 1.645 * sigma', 2)} AS lower,
{r(f'{FIT3} + 1.645 * sigma', 2)} AS upper FROM lagged3 LEFT JOIN ridge USING (series)
LEFT JOIN ridge_sigma USING (series) WHERE split = 'test'""",
    "lagged3", "ridge", "ridge_sigma",
)
cte(
    "contrib",
    f"""SELECT series, ds, feature, phi FROM lagged3 LEFT JOIN ridge USING (series),
LATERAL (VALUES ('y_lag1', b1 * (y_lag1 - m1)), ('y_lag2', b2 * (y_lag2 - m2)), ('y_lag12', b3 * (y_lag12 - m3))) v(feature, phi)
WHERE {HAVE}""",
    "lagged3", "ridge",
)
cte("attribution", "SELECT series, feature, avg(abs(phi)) AS importance FROM contrib GROUP BY 1, 2", "contrib")
oracle("h12_contributions", f"SELECT series, ds, feature, {r('phi', 2)} AS phi FROM contrib", "contrib")
oracle("d13_global_attribution", f"SELECT series, feature, {r('importance', 2)} AS importance FROM attribution", "attribution")

cte(
    "folds",
    """SELECT series, ds, y, y_lag1, fold, CASE WHEN back > (5 - fold) * 12 + 12 THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, lag(y, 1) OVER (PARTITION BY series ORDER BY ds) AS y_lag1,
      row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back FROM known),
     (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 6))
WHERE back > (5 - fold) * 12""",
    "known",
)
cte(
    "cv",
    """SELECT series, fold, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS mape
FROM (SELECT f.series, f.fold, y, a + b * y_lag1 AS yhat FROM folds f LEFT JOIN
  (SELECT series, fold, regr_intercept(y, y_lag1) AS a, regr_slope(y, y_lag1) AS b FROM folds
   WHERE split = 'train' AND y IS NOT NULL AND y_lag1 IS NOT NULL GROUP BY 1, 2) m
  ON m.series = f.series AND m.fold = f.fold
  WHERE split = 'test' AND y IS NOT NULL) GROUP BY 1, 2""",
    "folds",
)
oracle("h15_rolling_cv", f"SELECT series, fold, 'ar1' AS model, {ERR} FROM cv", "cv")
cte(
    "moment_cv",
    """SELECT s.series, s.fold, s.alpha, coalesce(m.n, 0) AS n, coalesce(t.n_test, 0) AS n_test,
  CASE WHEN m.n >= 3 THEN ym - b * xm END AS intercept, CASE WHEN m.n >= 3 THEN b END AS coef,
  CASE WHEN m.n >= 3 THEN sqrt(greatest(0, yv - 2 * b * c + b * b * xv)) END AS sigma, t.rmse,
  CASE WHEN m.n >= 3 THEN 'ok' ELSE 'short' END AS status
FROM (SELECT DISTINCT series, fold, alpha FROM (SELECT series FROM folds WHERE y IS NOT NULL AND y_lag1 IS NOT NULL),
      (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 7)), (VALUES (0.01::DOUBLE), (0.1), (1.0)) g(alpha)) s
LEFT JOIN (
  SELECT series, fold, alpha, n, ym, xm, yv, xv, c, c / CASE WHEN xv = 0 THEN 1 ELSE xv END / (1 + alpha) AS b
  FROM (SELECT series, fold, count(*) AS n, avg(y) AS ym, avg(y_lag1) AS xm, var_pop(y) AS yv, var_pop(y_lag1) AS xv,
          covar_pop(y, y_lag1) AS c
        FROM (SELECT series, fold, y, y_lag1 FROM folds WHERE split = 'train'
              UNION ALL SELECT series, 6, y, y_lag1 FROM folds WHERE fold = 5)
        WHERE y IS NOT NULL AND y_lag1 IS NOT NULL GROUP BY 1, 2), (VALUES (0.01::DOUBLE), (0.1), (1.0)) g(alpha)) m
  ON m.series = s.series AND m.fold = s.fold AND m.alpha = s.alpha
LEFT JOIN (SELECT series, fold, count(*) AS n_test FROM folds
  WHERE split = 'test' AND y IS NOT NULL AND y_lag1 IS NOT NULL GROUP BY 1, 2) k
  ON k.series = s.series AND k.fold = s.fold
LEFT JOIN LATERAL (SELECT coalesce(k.n_test, 0) AS n_test, sqrt(avg((f.y - (ym - b * xm) - b * f.y_lag1) ^ 2)) AS rmse
  FROM folds f WHERE f.series = s.series AND f.fold = s.fold AND f.split = 'test' AND f.y IS NOT NULL
  AND f.y_lag1 IS NOT NULL AND m.n >= 3) t ON true""",
    "folds",
)
oracle(
    "h15_moment_cv",
    f"""SELECT series, fold, alpha, n, n_test, {r('intercept', 2)} AS intercept, {r('coef', 6)} AS coef,
{r('sigma', 2)} AS sigma, {r('rmse', 2)} AS rmse, status FROM moment_cv""",
    "moment_cv",
)
oracle(
    "h15_alpha_choice",
    f"""SELECT series, CASE WHEN scored > 0 THEN alpha END AS alpha, {r('rmse', 2)} AS rmse, n_folds FROM (
  SELECT series, alpha, coalesce(sum(n_test) FILTER (WHERE rmse IS NOT NULL), 0) AS scored,
    sqrt(sum(rmse * rmse * n_test) / nullif(sum(n_test) FILTER (WHERE rmse IS NOT NULL), 0)) AS rmse,
    CAST(count(rmse) AS INTEGER) AS n_folds
  FROM moment_cv GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY series ORDER BY scored DESC, rmse NULLS FIRST, alpha DESC) = 1""",
    "moment_cv",
)
oracle(
    "d14_fold_summary",
    f"""SELECT series, {r('avg(rmse)')} AS rmse_mean, {r('stddev_pop(rmse)')} AS rmse_std,
{r('avg(mape)', 8)} AS mape_mean, {r('stddev_pop(mape)', 8)} AS mape_std FROM cv GROUP BY 1""",
    "cv",
)
oracle(
    "d15_residual_histogram",
    f"""SELECT model, CAST(bin AS INTEGER) AS bin, {r('lo + bin * w')} AS bin_start, {r('lo + (bin + 1) * w')} AS bin_end, count(*) AS n
FROM (SELECT model, lo, w, least(29, coalesce(floor((v - lo) / nullif(w, 0)), 0)) AS bin FROM
 (SELECT model, y - yhat AS v, min(y - yhat) OVER (PARTITION BY model) AS lo,
  (max(y - yhat) OVER (PARTITION BY model) - min(y - yhat) OVER (PARTITION BY model)) / 30 AS w FROM pred))
GROUP BY model, bin, lo, w""",
    "pred",
)

# ---- windows
oracle("e1_lags", "SELECT * FROM lagged4", "lagged4")
oracle("e1_lags_stored", "SELECT * FROM lagged4", "lagged4")
for name, lead in (("e2_rolling_mean", 0), ("e2_rolling_mean_shifted", 1)):
    cols = ", ".join(
        r(f"avg(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN {n - 1 + lead} PRECEDING AND "
          + ("1 PRECEDING)" if lead else "CURRENT ROW)")) + f" AS y_rolling_mean_{n}m"
        for n in (3, 6)
    )
    oracle(name, f"SELECT series, ds, {r('y')} AS y, {cols} FROM target", "target")
CHANGE = f"policy_rate - lag(policy_rate, 12) {W}"
oracle(
    "e3_shock",
    f"""SELECT series, ds, {r('policy_rate', 10)} AS policy_rate, {r(CHANGE, 10)} AS policy_rate_12m_change,
{r(f'abs({CHANGE})', 10)} AS policy_rate_shock_magnitude FROM macro""",
    "macro",
)


def pad(col: str, last: str) -> str:
    return (f"last_value({col} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND {last})")


def mom(col: str) -> str:
    return f"{pad(col, 'CURRENT ROW')} / nullif({pad(col, '1 PRECEDING')}, 0) - 1"


oracle("e4_pct_change", f"SELECT series, ds, {r('y')} AS y, {r(mom('y'), 8)} AS y_mom FROM target", "target")
oracle(
    "e4_pct_change_nofill",
    f"SELECT series, ds, {r('y')} AS y, {r(f'y / nullif(lag(y) {W}, 0) - 1', 8)} AS y_mom FROM target",
    "target",
)


def impute(col: str) -> str:
    part = "PARTITION BY series, split ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return (f"coalesce(last_value({col} IGNORE NULLS) OVER ({part} CURRENT ROW), "
            f"first_value({col} IGNORE NULLS) OVER ({part} UNBOUNDED FOLLOWING), 0) AS {col}")


oracle(
    "e5_impute_edges",
    f"""SELECT series, ds, split, {', '.join(impute(c) for c in ('y', 'y_lag1', 'y_lag12'))}
FROM (SELECT *, lag(y, 1) {W} AS y_lag1, lag(y, 12) {W} AS y_lag12,
 CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 12 THEN 'test' ELSE 'train' END AS split FROM target)""",
    "target",
)
oracle(
    "e6_deflate",
    f"""SELECT series, ds, {r('y')} AS y, {r('price_index', 6)} AS price_index,
{r('y / nullif(price_index / nullif(p0, 0) * 100, 0) * 100', 2)} AS real_first,
{r('y / nullif(price_index / nullif(p98, 0) * 100, 0) * 100', 2)} AS real_1998
FROM (SELECT *, first_value(price_index) {W} AS p0,
 avg(CASE WHEN year(ds) = 1998 THEN price_index END) {ALL} AS p98 FROM macro)""",
    "macro",
)
oracle(
    "e7_chain_index",
    f"""SELECT series, ds, {r('rate', 10)} AS rate, {r('idx', 6)} AS index FROM
(SELECT series, ds, policy_rate / 12 AS rate,
 product(1 + policy_rate / 12) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100 AS idx
 FROM macro)""",
    "macro",
)
oracle("e8_minmax_scale", "SELECT series, ds, idx FROM wp", "wp")
oracle(
    "e9_holdout_split",
    "SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 12 THEN 'test' ELSE 'train' END AS split FROM target",
    "target",
)
oracle(
    "e10_drop_warmup",
    f"SELECT series, ds, y FROM (SELECT *, row_number() {W} AS place FROM target) WHERE place > 12",
    "target",
)
oracle("e11_expanding_folds", "SELECT series, ds, y, fold, split FROM folds", "folds")
oracle(
    "e11_fold_report",
    "SELECT series, fold, split, count(*) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds FROM folds GROUP BY 1, 2, 3",
    "folds",
)
oracle(
    "e12_latest_row",
    f"""SELECT series, ds, {r('y')} AS y, {DRIVER_SQL} FROM
(SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back FROM macro) WHERE back = 1""",
    "macro",
)
oracle(
    "e13_value_back",
    """SELECT series, ds, y AS value FROM
(SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back FROM target) WHERE back = 12""",
    "target",
)
oracle(
    "e14_naive_diff",
    f"SELECT series, ds, {r('y')} AS y, {r(f'abs(y - lag(y) {W})')} AS naive_diff FROM target",
    "target",
)


def ar_sql() -> str:
    cols = {c: c for c in ["y", *DRIVERS]}
    cols |= {f"y_lag{k}": f"lag(y, {k}) {W}" for k in LAGS}
    for d in DRIVERS:
        for n in (3, 6):
            frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
            cols[f"{d}_rolling_mean_{n}m"] = f"avg({d}) OVER (PARTITION BY series ORDER BY ds {frame})"
    for d in ("policy_rate", "fx"):
        change = f"{d} - lag({d}, 12) {W}"
        cols[f"{d}_12m_change"] = change
        cols[f"{d}_shock_magnitude"] = f"abs({change})"
    cols |= CYCLE
    inner = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    outer = ", ".join(f"{r(n, digits_of(n))} AS {n}" for n in cols)
    keep = " AND ".join(f"{n} IS NOT NULL" for n in cols)
    parts = ", ".join(
        f"CAST({f}(ds) AS INTEGER) AS {n}"
        for n, f in (("month", "month"), ("quarter", "quarter"), ("day_of_year", "dayofyear")))
    return f"SELECT series, ds, {parts}, {outer} FROM (SELECT series, ds, {inner} FROM macro) WHERE {keep}"


oracle("e15_ar_features", ar_sql(), "macro")

# ---- top-k
oracle(
    "f1_top_features",
    f"""SELECT feature, {r('importance', 2)} AS importance FROM
(SELECT feature, avg(abs(phi)) AS importance FROM contrib GROUP BY 1) ORDER BY importance DESC, feature LIMIT 10""",
    "contrib",
)
cte(
    "ranked",
    "SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM attribution",
    "attribution",
)
for name, n in (("f1_top_features_by_series", 2), ("f2_top15_table", 15)):
    oracle(name, f"SELECT series, feature, {r('importance', 2)} AS importance, rank FROM ranked WHERE rank <= {n}", "ranked")
oracle("f3_order_by_time", "SELECT series, ds, y FROM target", "target")

# ---- unions
oracle(
    "g1_append_forecast",
    "SELECT series, ds, y, NULL::DOUBLE AS yhat FROM known UNION ALL SELECT series, ds, NULL, yhat FROM flat",
    "known", "flat",
)
oracle(
    "g2_stitched_series",
    f"""SELECT series, ds, segment, {r('value')} AS value, {r('lower')} AS lower, {r('upper')} AS upper FROM (
SELECT series, ds, 'history' AS segment, y AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM known WHERE y IS NOT NULL
UNION ALL SELECT series, min(ds), 'nowcast', max(yhat), max(yhat) * 0.9, max(yhat) * 1.1 FROM flat GROUP BY series
UNION ALL SELECT series, CAST(ds + INTERVAL 1 MONTH AS DATE), 'forecast', yhat, NULL, NULL FROM flat)""",
    "known", "flat",
)
cte("finals", "SELECT series, scenario, max(ds) AS last_ds, max_by(yhat, ds) AS final_value FROM paths GROUP BY 1, 2", "paths")
oracle("g3_scenario_table", f"SELECT series, scenario, last_ds, {r('final_value')} AS final_value FROM finals", "finals")

# ---- models
Z = ", ".join(
    r(f"({d} - avg(CASE WHEN split = 'train' THEN {d} END) {ALL}) / "
      f"CASE WHEN stddev_pop(CASE WHEN split = 'train' THEN {d} END) {ALL} = 0 THEN 1 "
      f"ELSE stddev_pop(CASE WHEN split = 'train' THEN {d} END) {ALL} END", digits_of(d)) + f" AS {d}_z"
    for d in DRIVERS
)
oracle(
    "h1_standardize",
    f"""SELECT series, ds, split, {Z} FROM (SELECT *,
CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 12 THEN 'test' ELSE 'train' END AS split FROM macro)""",
    "macro",
)


def aligned(name: str, target: str, hf: list[str]) -> None:
    """Outer alignment of target and cut roll-ups, calendar completed, with presence flag."""
    daily = [c for c in hf if not c.startswith("idx")]
    weekly = [c for c in hf if c.startswith("idx")]
    cols = ", ".join([f"d.{c}" for c in daily] + [f"w.{c}" for c in weekly])
    sources = f"SELECT series, ds FROM {target} UNION SELECT series, ds FROM daily20"
    flag = "d.series IS NOT NULL"
    join = ""
    if weekly:
        sources += " UNION SELECT series, ds FROM weekly20"
        join = "LEFT JOIN weekly20 w ON w.series = s.series AND w.ds = s.ds"
        flag += " OR w.series IS NOT NULL"
    cte(
        name,
        f"""SELECT s.series, s.ds, t.y, {cols}, {flag} AS hf
FROM (SELECT series, CAST(ds AS DATE) AS ds FROM (SELECT series, unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds
      FROM ({sources}) GROUP BY series)) s
LEFT JOIN {target} t ON t.series = s.series AND t.ds = s.ds
LEFT JOIN daily20 d ON d.series = s.series AND d.ds = s.ds {join}""",
        target, "daily20", "weekly20",
    )


HF = [f"{c}_{s}" for c in ("qty", "rev") for s in ("mean", "std", "last")] + ["idx_mean", "idx_last"]
aligned("al_full", "mp", HF)
cte("mp_hidden", f"SELECT series, ds, CASE WHEN ds < {OPEN_MONTH} THEN y END AS y FROM mp", "mp")
aligned("al_rev", "mp_hidden", ["rev_mean"])
aligned("al_qty", "mp", ["qty_mean"])
MOMS = [c for c in HF if not c.endswith("_std")]
cte(
    "h18",
    f"""SELECT * FROM (SELECT series, ds, y, {', '.join(HF)},
{', '.join(f'CASE WHEN hf THEN {mom(c)} END AS {c}_mom' for c in MOMS)},
{', '.join(f'lag(y, {k}) {W} AS y_lag{k}' for k in (1, 2, 12))}, row_number() {W} AS place FROM al_full) WHERE place > 12""",
    "al_full",
)
oracle(
    "h18_nowcast_features",
    "SELECT series, ds, " + ", ".join(
        f"{r(c, digits_of(c))} AS {c}" for c in ["y", *HF, "y_lag1", "y_lag2", "y_lag12"] + [f"{c}_mom" for c in MOMS]) + " FROM h18",
    "h18",
)
oracle(
    "b13_select_by_kind",
    f"""SELECT series, ds, y_lag1, y_lag2, y_lag12 FROM (SELECT series, ds,
{', '.join(f'lag(y, {k}) {W} AS y_lag{k}' for k in (1, 2, 12))}, row_number() {W} AS place FROM al_qty) WHERE place > 12""",
    "al_qty",
)
# Elastic net with one feature: soft threshold at alpha*rho on the z-score scale, shrink by 1 + alpha*(1 - rho).
oracle(
    "h2_bridge_fit",
    f"""SELECT series, n, {r('my - w / s * m', 1)} AS intercept, {r('w / s')} AS coef,
{r('sqrt(vy - 2 * w / s * c + w / s * w / s * s * s)', 1)} AS sigma, 'ok' AS status
FROM (SELECT *, sign(c / s) * greatest(abs(c / s) - 0.25, 0) / 1.25 AS w FROM
 (SELECT series, count(*) AS n, avg(y) AS my, var_pop(y) AS vy, avg(rev_mean) AS m, stddev_pop(rev_mean) AS s,
  covar_pop(rev_mean, y) AS c FROM (SELECT *, row_number() {W} AS place FROM al_rev)
  WHERE place > 12 AND y IS NOT NULL AND rev_mean IS NOT NULL GROUP BY 1))""",
    "al_rev",
)
cte(
    "ar1",
    f"""SELECT series, regr_intercept(y, l) AS a, regr_slope(y, l) AS b, CAST(regr_count(y, l) AS BIGINT) AS n
FROM (SELECT series, y, lag(y) {W} AS l FROM known) GROUP BY 1""",
    "known",
)
oracle("h3_ar1_fit", f"SELECT series, {r('a', 2)} AS intercept, {r('b')} AS slope, n FROM ar1", "ar1")
cte(
    "walk",
    """SELECT series, last, 0 AS step, v, a, b FROM
  (SELECT series, max(ds) AS last, max_by(y, ds) AS v FROM known GROUP BY 1) JOIN ar1 USING (series)
UNION ALL SELECT series, last, step + 1, a + b * v, a, b FROM walk WHERE step < 12""",
    "known", "ar1",
)
oracle(
    "h8_recursive_forecast",
    f"SELECT series, CAST(last + to_months(step) AS DATE) AS ds, {r('v', 2)} AS yhat FROM walk WHERE step > 0",
    "walk",
)
LINE_SIGMA = (
    "CASE WHEN regr_count({y}, {x}) > 2 THEN sqrt(greatest(0, regr_syy({y}, {x}) - regr_sxy({y}, {x}) ^ 2"
    " / nullif(regr_sxx({y}, {x}), 0)) / (regr_count({y}, {x}) - 2)) END"
)
cte(
    "ar1_spread",
    f"""SELECT series, regr_slope(y, x) AS b, {LINE_SIGMA.format(y='y', x='x')} AS sigma
FROM (SELECT series, y, lag(y, 1) OVER (PARTITION BY series ORDER BY ds) AS x FROM known) GROUP BY 1""",
    "known",
)
oracle(
    "h8_ar1_band",
    f"""SELECT series, ds, {r('v', 2)} AS yhat, {r('v - 1.96 * s', 2)} AS lower, {r('v + 1.96 * s', 2)} AS upper
FROM (SELECT w.series, CAST(last + to_months(step) AS DATE) AS ds, v,
  sigma * sqrt(list_sum(list_transform(range(0, step), lambda j: pow(m.b, 2 * j)))) AS s
  FROM walk w LEFT JOIN ar1_spread m ON m.series = w.series WHERE step > 0)""",
    "walk", "ar1_spread",
)
oracle(
    "h9_direct_band",
    f"""SELECT series, CAST(last + to_months(step) AS DATE) AS ds, step, {r('a + b * v', 2)} AS yhat,
{r('a + b * v - 1.96 * s', 2)} AS lower, {r('a + b * v + 1.96 * s', 2)} AS upper FROM
(SELECT k.series, CAST(h AS INTEGER) AS step, regr_intercept(z.y, k.y) AS a, regr_slope(z.y, k.y) AS b, {LINE_SIGMA.format(y='z.y', x='k.y')} AS s
 FROM known k, range(1, 13) t(h) LEFT JOIN known z ON z.series = k.series AND z.ds = CAST(k.ds + to_months(CAST(h AS INTEGER)) AS DATE)
 GROUP BY 1, 2) JOIN (SELECT series, max(ds) AS last, max_by(y, ds) AS v FROM known GROUP BY 1) USING (series)""",
    "known",
)
oracle(
    "h9_direct_forecast",
    f"""SELECT series, CAST(last + to_months(step) AS DATE) AS ds, step, {r('a + b * v', 2)} AS yhat FROM
(SELECT k.series, CAST(h AS INTEGER) AS step, regr_intercept(z.y, k.y) AS a, regr_slope(z.y, k.y) AS b
 FROM known k, range(1, 13) t(h) LEFT JOIN known z ON z.series = k.series AND z.ds = CAST(k.ds + to_months(CAST(h AS INTEGER)) AS DATE)
 GROUP BY 1, 2) JOIN (SELECT series, max(ds) AS last, max_by(y, ds) AS v FROM known GROUP BY 1) USING (series)""",
    "known",
)
cte(
    "trend",
    """SELECT series, ds, y, t, a, b, first, last FROM
(SELECT *, CAST(datediff('month', first, ds) AS DOUBLE) AS t FROM
 (SELECT *, min(ds) OVER (PARTITION BY series) AS first, max(ds) OVER (PARTITION BY series) AS last FROM known WHERE y IS NOT NULL))
JOIN (SELECT series, regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM
 (SELECT series, y, datediff('month', min(ds) OVER (PARTITION BY series), ds) AS t FROM known WHERE y IS NOT NULL) GROUP BY 1) USING (series)""",
    "known",
)
for name, value, effect, rest in (
    ("add", "y - a - b * t", "s - level", "y - a - b * t - effect"),
    ("mul", "y / nullif(a + b * t, 0)", "s / nullif(level, 0)", "y - (a + b * t) * effect"),
):
    cte(
        f"season_{name}",
        f"""SELECT series, month, {effect} AS effect FROM (SELECT *, avg(s) OVER (PARTITION BY series) AS level FROM
(SELECT series, CAST(month(ds) AS INTEGER) AS month, avg({value}) AS s FROM trend GROUP BY 1, 2))""",
        "trend",
    )
    cte(
        f"model_{name}",
        f"""SELECT series, count(*) AS n, max(a) AS a, max(b) AS b, max(first) AS first, max(last) AS last,
stddev_pop({rest}) AS sigma FROM trend JOIN season_{name} s USING (series) WHERE month(trend.ds) = s.month GROUP BY 1""",
        "trend", f"season_{name}",
    )
for query, name, digits in (("h10_structural_fit", "add", 2), ("h10_structural_multiplicative", "mul", 4)):
    oracle(
        query,
        f"""SELECT series, n, {r('a', 2)} AS intercept, {r('b', 2)} AS slope, {r('sigma', 2)} AS sigma, month,
{r('effect', digits)} AS effect FROM model_{name} JOIN season_{name} USING (series)""",
        f"model_{name}", f"season_{name}",
    )
oracle(
    "h11_structural_predict",
    f"""SELECT m.series, ds, {r('tr + e', 2)} AS yhat, {r('tr + e - 1.96 * sigma', 2)} AS lower,
{r('tr + e + 1.96 * sigma', 2)} AS upper, {r('tr', 2)} AS trend, {r('e', 2)} AS seasonal, ds > last AS is_future
FROM (SELECT m.*, s.ds, a + b * datediff('month', first, s.ds) AS tr, coalesce(effect, 0) AS e FROM model_add m JOIN
 (SELECT series, CAST(unnest(generate_series(first, last + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ds FROM model_add) s
 ON s.series = m.series LEFT JOIN season_add e ON e.series = m.series AND e.month = month(s.ds)) m""",
    "model_add", "season_add",
)
oracle("h16_persistence_forecast", "SELECT series, ds, yhat FROM flat", "flat")
cte(
    "revisions",
    """SELECT series, ds, published_at, sum(part) OVER (PARTITION BY series, ds ORDER BY published_at) / 100.0 AS shipped
FROM (SELECT seg AS series, CAST(date_trunc('month', od) AS DATE) AS ds, last_day(CAST(l_shipdate AS DATE)) AS published_at,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS part
      FROM lineitem JOIN keyed ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)""",
    "keyed",
)
# The publication wanted for each series, day and period is the newest one: an ASOF join finds it.
oracle(
    "h17_known_at",
    f"""SELECT p.series, p.known_on, p.ds, v.published_at, {r('v.shipped', 2)} AS shipped
FROM (SELECT DISTINCT series, ds, known_on FROM revisions,
      (VALUES (DATE '1995-06-30'), (DATE '1997-01-15'), (DATE '1998-08-31')) d(known_on)) p
ASOF JOIN revisions v ON v.series = p.series AND v.ds = p.ds AND p.known_on >= v.published_at""",
    "revisions",
)
oracle(
    "h17_asof_join",
    f"""SELECT t.series, t.ds, t.y, t.origin, v.published_at, v.period, {r('v.shipped')} AS shipped
FROM (SELECT *, last_day(ds) AS origin FROM mp) t
ASOF LEFT JOIN (SELECT series, published_at, max(ds) AS period, max_by(shipped, ds) AS shipped FROM revisions GROUP BY 1, 2) v
ON v.series = t.series AND t.origin > v.published_at""",
    "mp", "revisions",
)
oracle("h17_cutoff_vintage", "SELECT series, ds, qty, rev, n_lines FROM dp WHERE day(ds) <= 20", "dp")
oracle(
    "h17_vintage_curve",
    f"""SELECT series, cutoff, m AS ds, {', '.join(
        f"{r(e.format(c=c), digits_of(f'{c}_{s}'))} AS {c}_{s}" for c in ('qty', 'rev')
        for s, e in (('mean', 'avg({c})'), ('std', 'stddev_samp({c})'), ('last', 'max_by({c}, ds)')))}
FROM (SELECT *, {MONTH.format('ds')} AS m FROM dp), (SELECT CAST(unnest([10, 20, 30]) AS INTEGER) AS cutoff)
WHERE day(ds) <= cutoff GROUP BY 1, 2, 3""",
    "dp",
)
oracle(
    "h19_run_summary",
    f"""SELECT k.series, first_ds, last_ds, n_rows, b.model AS best_model, {ERR},
{', '.join(f"{r(f'final_{s}')} AS final_{s}" for s in ('pessimista', 'base', 'otimista'))}, top_features,
CAST(12 AS INTEGER) AS horizon
FROM (SELECT series, min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS n_rows FROM known GROUP BY 1) k
LEFT JOIN best b USING (series)
LEFT JOIN (SELECT series, {', '.join(f"max(CASE WHEN scenario = '{s}' THEN final_value END) AS final_{s}" for s in ('pessimista', 'base', 'otimista'))}
  FROM finals GROUP BY 1) f USING (series)
LEFT JOIN (SELECT series, string_agg(feature, ',' ORDER BY rank) AS top_features FROM ranked WHERE rank <= 5 GROUP BY 1) t USING (series)""",
    "known", "best", "finals", "ranked",
)

# ---- feed
oracle(
    "s1_stream_rollup",
    f"""SELECT event_type, CAST(ts AS DATE) AS ds, count(value) AS n, {r('sum(value)')} AS total,
{r('max_by(value, ts)')} AS last, {r('avg(value)', 6)} AS mean, {r('stddev_samp(value)')} AS std FROM events GROUP BY event_type, CAST(ts AS DATE)""",
)
EARLY = "FILTER (WHERE day(ts) <= 20)"
oracle(
    "s1_month_stream",
    f"""SELECT event_type, {MONTH.format('ts')} AS ds, {r(f'avg(value) {EARLY}', 6)} AS value_mean,
{r(f'stddev_samp(value) {EARLY}')} AS value_std,
{r("(max({'t': date_trunc('second', ts), 'v': value}) FILTER (WHERE day(ts) <= 20 AND value IS NOT NULL)).v")} AS value_last,
count(*) FILTER (WHERE day(ts) > 20) AS n_late FROM events GROUP BY event_type, {MONTH.format('ts')}""",
)
oracle(
    "s2_late_rows",
    f"""SELECT event_type, {MONTH.format('ts')} AS ds, count(*) FILTER (WHERE day(ts) <= 20) AS n_in_time,
count(*) FILTER (WHERE day(ts) > 20) AS n_late FROM events GROUP BY event_type, {MONTH.format('ts')}""",
)

# ---- other weightings of the days of a month
cte(
    "recent",
    f"""SELECT series, {MONTH.format('ds')} AS m, qty, rev,
row_number() OVER (PARTITION BY series, {MONTH.format('ds')} ORDER BY ds DESC) AS j FROM dp WHERE day(ds) <= 20""",
    "dp",
)
WEIGHT = "(1 - 0.02::DOUBLE * j + 0.0001::DOUBLE * j * j)"
cte(
    "almon_rows",
    """SELECT series, ds, max(y) AS y, sum(qty) AS p0, sum(j / 10.0::DOUBLE * qty) AS p1 FROM (
  SELECT t.series, t.ds, t.y, d.qty, row_number() OVER (PARTITION BY t.series, t.ds ORDER BY d.ds DESC) AS j
  FROM mp_known t JOIN dp d ON d.series = t.series AND d.ds <= t.ds + 19 AND d.qty IS NOT NULL) WHERE j <= 10
GROUP BY 1, 2 HAVING count(*) = 10""",
    "mp_known", "dp",
)
oracle(
    "x1_almon_fit",
    f"""SELECT series, n, {r('my - b0 * m0 - b1 * m1', 0)} AS intercept, {r('b0', 1)} AS theta0, {r('b1', 1)} AS theta1,
{r('sqrt(greatest(0, vy - b0 * c0 - b1 * c1))', 0)} AS sigma, 'ok' AS status
FROM (SELECT *, (c0 * v1 - c1 * v01) / (v0 * v1 - v01 * v01) AS b0, (c1 * v0 - c0 * v01) / (v0 * v1 - v01 * v01) AS b1
  FROM (SELECT series, count(*) AS n, avg(y) AS my, avg(p0) AS m0, avg(p1) AS m1, var_pop(y) AS vy, var_pop(p0) AS v0,
    var_pop(p1) AS v1, covar_pop(p0, p1) AS v01, covar_pop(p0, y) AS c0, covar_pop(p1, y) AS c1
    FROM almon_rows GROUP BY 1))""",
    "almon_rows",
)
oracle(
    "x1_almon_mean",
    f"SELECT series, m AS ds, {r(f'sum(qty * {WEIGHT}) / sum({WEIGHT})')} AS qty_almon FROM recent GROUP BY 1, 2",
    "recent",
)
oracle(
    "x2_umidas_features",
    "SELECT series, m AS ds, " + ", ".join(f"{r(f'max(CASE WHEN j = {j} THEN rev END)')} AS rev_d{j}" for j in range(1, 6))
    + " FROM recent GROUP BY 1, 2",
    "recent",
)

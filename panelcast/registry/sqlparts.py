"""Named CTEs of the oracle SQL (DuckDB) and their dependencies."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body.strip())


def with_ctes(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return final.strip()
    parts = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    return f"WITH RECURSIVE {parts}\n{final.strip()}"


def r(expr: str, digits: int = 4) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def filled(name: str, source: str, values: list[str]) -> None:
    """Calendar-completed form of a monthly panel CTE."""
    cols = ", ".join(f"p.{v}" for v in values)
    cte(
        name,
        f"""
SELECT s.series, CAST(s.ds AS DATE) AS ds, {cols}
FROM (SELECT series, unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds
      FROM {source} GROUP BY series) s
LEFT JOIN {source} p ON p.series = s.series AND p.ds = CAST(s.ds AS DATE)""",
        source,
    )


cte(
    "keyed",
    """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od, o_totalprice,
       c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nat
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
for panel, key in (("mp", "seg"), ("np", "nat")):
    cte(
        panel,
        f"""
SELECT {key} AS series, CAST(date_trunc('month', od) AS DATE) AS ds,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
FROM keyed GROUP BY 1, 2""",
        "keyed",
    )
cte(
    "ship",
    """
SELECT seg AS series, CAST(l_shipdate AS DATE) AS d, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag
FROM lineitem JOIN keyed ON l_orderkey = o_orderkey""",
    "keyed",
)
cte(
    "dp",
    """
SELECT series, d AS ds,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS rev,
       count(*) AS n_lines
FROM ship GROUP BY 1, 2""",
    "ship",
)
cte(
    "wk",
    """
SELECT series, CAST(d + CAST(7 - isodow(d) AS INTEGER) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS n_lines
FROM ship GROUP BY 1, 2""",
    "ship",
)
cte(
    "wp",
    """
SELECT series, ds,
       round((n_lines - min(n_lines) OVER (PARTITION BY series))
             / (max(n_lines) OVER (PARTITION BY series) - min(n_lines) OVER (PARTITION BY series) + 1e-8) * 100, 2) AS idx
FROM wk""",
    "wk",
)
cte(
    "xp",
    """
SELECT series, CAST(date_trunc('month', d) AS DATE) AS ds,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS production,
       avg(l_discount) AS policy_rate,
       avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unemployment,
       avg(l_tax) AS fx,
       avg(l_extendedprice / nullif(l_quantity, 0)) AS price_index
FROM ship GROUP BY 1, 2""",
    "ship",
)
cte(
    "macro0",
    """
SELECT coalesce(mp.series, xp.series) AS series, coalesce(mp.ds, xp.ds) AS ds, y,
       production, policy_rate, unemployment, fx, price_index
FROM mp FULL OUTER JOIN xp ON mp.series = xp.series AND mp.ds = xp.ds""",
    "mp",
    "xp",
)
cte(
    "ep",
    """
SELECT event_type AS series, CAST(ts AS DATE) AS ds, count(*) AS n, sum(value) AS total, avg(value) AS mean
FROM events GROUP BY 1, 2""",
)
filled("target", "np", ["y"])
#: Start of the first month whose orders are not complete.
OPEN_MONTH = """(SELECT CASE WHEN d = last_day(d) THEN d + 1 ELSE CAST(date_trunc('month', d) AS DATE) END
FROM (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders))"""
cte("np_known", f"SELECT * FROM np WHERE ds < {OPEN_MONTH}", "np")
filled("known", "np_known", ["y"])
cte("mp_known", f"SELECT * FROM mp WHERE ds < {OPEN_MONTH}", "mp")
filled("mknown", "mp_known", ["y"])
filled("macro", "macro0", ["y", "production", "policy_rate", "unemployment", "fx", "price_index"])
cte(
    "pred",
    """
SELECT series, ds, model, y, yhat FROM (
  SELECT series, ds, y, lag(y, 1) OVER w AS naive, lag(y, 12) OVER w AS seasonal,
         row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back
  FROM known WINDOW w AS (PARTITION BY series ORDER BY ds)) t,
  LATERAL (VALUES ('naive', naive), ('seasonal', seasonal)) v(model, yhat)
WHERE back <= 12 AND y IS NOT NULL AND yhat IS NOT NULL""",
    "known",
)
cte(
    "metrics",
    """
SELECT series, model, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
       avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS mape, avg(step) AS naive_step
FROM (SELECT *, abs(y - lag(y) OVER (PARTITION BY series, model ORDER BY ds)) AS step FROM pred)
GROUP BY 1, 2""",
    "pred",
)

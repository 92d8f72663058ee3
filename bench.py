"""Wall time of the headline queries.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelcast import build_session  # noqa: E402
from panelcast.registry.queries import QUERIES  # noqa: E402

HEADLINE = [
    "a3_merge_sources",
    "a5_gap_fill",
    "a7_assemble_wide",
    "d1_daily_to_monthly",
    "d5_describe_whole_table",
    "d6_quality_verdict",
    "d10_gain_vs_baseline",
    "e15_ar_features",
    "h2_bridge_fit_full",
    "h3_ar_baseline_fit",
    "h8_recursive_ridge",
    "h10_piecewise_fit",
    "h11_structural_predict",
    "h15_rolling_cv",
    "h17_vintage_curve",
    "h18_nowcast_features",
    "h7_boosted_forecast_fit",
    "h14_nowcast_backtest",
    "s1_stream_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed pass over a small query: session and Python worker start-up are not the queries'.
    QUERIES["h3_ar_baseline_fit"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

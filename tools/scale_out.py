"""Wall time of panel operators on the nation panel with the series multiplied.

    python tools/scale_out.py SF_DIR [copies ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from panelcast import build_session  # noqa: E402
from panelcast.operators import evaluate, forecast, linear, structural, windows  # noqa: E402
from panelcast.registry.common import known_target  # noqa: E402
from panelcast.session import cut_lineage  # noqa: E402

KEYS = ["series", "copy"]
XS = ["y_lag1", "y_lag2", "y_lag12"]


def ridge(panel):
    rows = windows.holdout_split(windows.lags(panel, KEYS, "y", [1, 2, 12]), KEYS)
    model = linear.ar_baseline_fit(rows.filter("split = 'train'"), KEYS, "y", XS)
    return linear.bridge_predict(model, rows.filter("split = 'test'"), KEYS, XS)


OPERATORS = {
    "lags + rolling": lambda p: windows.rolling_mean(windows.lags(p, KEYS, "y"), KEYS, ["y"]),
    "expanding folds report": lambda p: evaluate.fold_report(evaluate.expanding_folds(p, KEYS), KEYS),
    "ridge backtest": ridge,
    "structural fit + predict": lambda p: structural.structural_predict(structural.structural_fit(p, KEYS), KEYS),
    "piecewise fit": lambda p: structural.piecewise_fit(p, KEYS),
    "direct AR, 12 horizons": lambda p: forecast.direct_forecast_ar1(p, KEYS),
}


ONLY = os.environ.get("ONLY", "")


def main(sf: str, copies: list[int]) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("scale", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(4 * int(cpus)), "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    base = cut_lineage(known_target(spark, sf))
    for n in copies:
        copy = F.explode(F.sequence(F.lit(1), F.lit(n)))
        panel = cut_lineage(base.repartition(int(cpus)).withColumn("copy", copy))
        rows = panel.count()
        for name, op in OPERATORS.items():
            if not name.startswith(ONLY):
                continue
            started = time.perf_counter()
            op(panel).write.format("noop").mode("overwrite").save()
            print(f"x{n} ({rows} rows) {name}: {time.perf_counter() - started:.1f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], [int(a) for a in sys.argv[2:]] or [1, 100, 1000])

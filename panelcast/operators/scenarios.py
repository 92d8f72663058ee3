"""Scenario paths and scenario inputs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import SCENARIO_SHOCKS
from panelcast.operators.windows import whole


def _scenario_array(scenarios: Mapping[str, float]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), F.lit(float(shock)).alias("shock"))
            for name, shock in scenarios.items()
        ]
    )


def scenario_path(
    df: DataFrame,
    scenarios: Mapping[str, float] = SCENARIO_SHOCKS,
    pct: float = 0.02,
    yhat: str = "yhat",
) -> DataFrame:
    """Forecast times (1 + shock * pct), one row per scenario; the scenarios are literals."""
    crossed = df.withColumn("_s", F.explode(_scenario_array(scenarios)))
    return crossed.withColumns(
        {"scenario": F.col("_s.scenario"), yhat: F.col(yhat) * (1 + F.col("_s.shock") * pct)}
    ).drop("_s")


def scenario_inputs(
    df: DataFrame,
    keys: Sequence[str],
    k_by_col: Mapping[str, float],
    scenarios: Sequence[str] = tuple(SCENARIO_SHOCKS),
    magnitude: float = 1.0,
    ds: str = "ds",
) -> DataFrame:
    """Drivers moved by shock * sigma * k, with sigma of the series."""
    wanted = {}
    for name in scenarios:
        if name not in SCENARIO_SHOCKS:
            warnings.warn(f"unknown scenario {name!r}, using 'base'", stacklevel=2)
            name = "base"
        wanted[name] = SCENARIO_SHOCKS[name] * magnitude
    w = whole(keys, ds)
    sigma = df.withColumns({f"_sd_{c}": F.stddev_samp(c).over(w) for c in k_by_col})
    crossed = sigma.withColumn("_s", F.explode(_scenario_array(wanted)))
    moved = {
        c: F.col(c) + F.coalesce(F.col("_s.shock") * F.col(f"_sd_{c}") * k, F.lit(0.0))
        for c, k in k_by_col.items()
    }
    return crossed.withColumns({"scenario": F.col("_s.scenario"), **moved}).drop(
        "_s", *[f"_sd_{c}" for c in k_by_col]
    )


def scenario_table(paths: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """Last value of each scenario path."""
    return paths.groupBy(*keys, "scenario").agg(
        F.max(ds).alias("last_ds"), F.max_by("yhat", ds).alias("final_value")
    )

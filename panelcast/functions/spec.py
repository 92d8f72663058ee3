"""The feature list: what each column is, so that no code has to parse names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeatureSpec:
    """``kind``: target_lag, target_rolling, season, driver, rolling, shock, or high_freq."""

    name: str
    kind: str
    source: str | None = None
    k: int | None = None


def lag_name(col: str, k: int) -> str:
    return f"{col}_lag{k}"


def rolling_name(col: str, window: int) -> str:
    return f"{col}_rolling_mean_{window}m"


def names(specs: Iterable[FeatureSpec]) -> list[str]:
    return [s.name for s in specs]


def of_kind(specs: Iterable[FeatureSpec], *kinds: str) -> list[FeatureSpec]:
    return [s for s in specs if s.kind in kinds]


def select_by_kind(
    df: DataFrame, specs: Iterable[FeatureSpec], kinds: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Columns of the given kinds, e.g. the lags-only design of the baseline."""
    return df.select(*keep, *names(of_kind(specs, *kinds)))

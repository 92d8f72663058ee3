"""Run parameters.  Plain dataclasses that live on the driver only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


# The three scenarios and their shock in standard deviations.
SCENARIO_SHOCKS = {"pessimista": -1.0, "base": 0.0, "otimista": 1.0}

# Z multipliers of the supported interval levels.
Z_BY_LEVEL = {0.90: 1.645, 0.95: 1.96}


@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 3, 6, 12)
    rolling: tuple[int, ...] = (3, 6)
    shock_lag: int = 12
    #: False, "cyclical" (or True), or "categorical": month dummies.
    seasonal: bool | str = True


@dataclass(frozen=True)
class BoostConfig:
    """Boosted trees of the twelve-month forecast."""

    max_depth: int = 6
    learning_rate: float = 0.05
    n_estimators: int = 200
    subsample: float = 0.8
    colsample: float = 0.8
    seed: int = 42


@dataclass(frozen=True)
class NowcastBoostConfig(BoostConfig):
    """Smaller trees for the mixed-frequency design."""

    max_depth: int = 4
    learning_rate: float = 0.03
    n_estimators: int = 150


@dataclass(frozen=True)
class ForecastConfig:
    horizon: int = 12
    test_size: int = 12
    min_rows: int = 36
    scenario_pct: float = 0.02
    #: Scenario names and their shocks; the summary has a final value of each.
    scenarios: Mapping[str, float] = field(default_factory=lambda: dict(SCENARIO_SHOCKS))
    interval: float = 0.95
    #: The structural model of the contest: "straight" (month means) or "piecewise" (waves).
    structural: str = "straight"
    mode: str = "additive"
    features: FeatureConfig = field(default_factory=FeatureConfig)
    boost: BoostConfig = field(default_factory=BoostConfig)


@dataclass(frozen=True)
class NowcastConfig:
    cutoff_day: int = 20
    target_lags: tuple[int, ...] = (1, 2, 12)
    test_size: int = 12
    horizon: int = 12
    interval: float = 0.95
    bridge_alpha: float = 0.5
    bridge_l1_ratio: float = 0.5
    baseline_alpha: float = 1.0
    boost: NowcastBoostConfig = field(default_factory=NowcastBoostConfig)

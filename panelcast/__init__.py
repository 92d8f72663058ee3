"""Mixed-frequency panels on Spark: features, nowcasts, forecasts, backtests."""

from panelcast.config import (
    BoostConfig,
    FeatureConfig,
    ForecastConfig,
    NowcastBoostConfig,
    NowcastConfig,
    SCENARIO_SHOCKS,
)
from panelcast.session import build_session, cut_lineage

__all__ = [
    "BoostConfig",
    "FeatureConfig",
    "ForecastConfig",
    "NowcastBoostConfig",
    "NowcastConfig",
    "SCENARIO_SHOCKS",
    "build_session",
    "cut_lineage",
]

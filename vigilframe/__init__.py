"""vigilframe: log-anomaly scoring and link-graph analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames.  See README.md for a tour.
"""

from vigilframe.config import (
    ActionPolicy,
    AnalysisConfig,
    BaselineConfig,
    GraphConfig,
    QuietRule,
    DEFAULT_QUIET_RULES,
    DEFAULT_HIDE_PREFIXES,
)

__all__ = [
    "ActionPolicy",
    "AnalysisConfig",
    "BaselineConfig",
    "GraphConfig",
    "QuietRule",
    "DEFAULT_QUIET_RULES",
    "DEFAULT_HIDE_PREFIXES",
]

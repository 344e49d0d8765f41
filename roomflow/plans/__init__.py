"""Named queries over the driver tables (Spark) with their DuckDB oracles."""

from . import (  # noqa: F401  (importing registers the queries)
    forecast_plans,
    profile_plans,
    recommend_plans,
    report_plans,
    summary_plans,
    utilization_plans,
)
from .catalog import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]

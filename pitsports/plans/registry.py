"""Every registered query of the library and, where SQL can express it, the same query for DuckDB."""

from __future__ import annotations

from pitsports.plans import aggregate_queries, asof_queries, composite_queries, domain_queries, game_queries, inference_queries, landing_queries, leak_queries, pitching_queries, scalar_queries, table_queries, team_queries  # noqa: F401
from pitsports.plans.base import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
FLAGSHIP = "survey_op1_decayed_shrunk_rate"

"""All registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from palimpsest.plans import conversation_queries, facts_queries, parsing_queries, phase_queries, resume_queries, source_queries
from palimpsest.plans.registry import ORACLES, QUERIES

FLAGSHIP = "retention_by_type"
MODULES = (conversation_queries, facts_queries, parsing_queries, phase_queries, resume_queries, source_queries)
__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]

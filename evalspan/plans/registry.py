"""All queries of the core with their SQL; the keys are the names of the driver's checks."""

from __future__ import annotations

from evalspan.plans import aggregate_queries, analysis_queries, core_problems, extended_queries, join_queries, row_queries, scoring_queries, source_queries

QUERIES = {**core_problems.QUERIES, **aggregate_queries.QUERIES, **join_queries.QUERIES, **analysis_queries.QUERIES, **row_queries.QUERIES, **scoring_queries.QUERIES, **extended_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict[str, str] = {**core_problems.ORACLES, **aggregate_queries.ORACLES, **join_queries.ORACLES, **analysis_queries.ORACLES, **row_queries.ORACLES, **scoring_queries.ORACLES, **extended_queries.ORACLES, **source_queries.ORACLES}

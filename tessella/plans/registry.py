"""All registered queries and their SQL."""

from __future__ import annotations

from tessella.plans import cohort_queries, crossfit_queries, descriptor_queries, dialect_queries, file_queries, ladder_queries, model_queries, relational_queries, report_queries, structure_queries

_MODULES = [descriptor_queries, structure_queries, crossfit_queries, relational_queries, model_queries, ladder_queries, cohort_queries, dialect_queries, file_queries, report_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

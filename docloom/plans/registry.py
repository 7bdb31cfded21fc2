"""All queries of the library and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from docloom.operators import aggregates, chart_checks, charts, documents, evidence, extraction, fragments, library, page_tables, paper_texts, plan_evidence, postings, property_run, relational, retrieval, shaping, structure, vector_index, views
from docloom.sources import exports, files
from docloom.streaming import events, keyed, progress, progress

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (aggregates, relational, retrieval, documents, extraction, shaping, views, files, events, keyed, progress, evidence, charts, exports, fragments, property_run, library, structure, page_tables, plan_evidence, postings, vector_index, chart_checks, paper_texts):
    QUERIES |= module.BOOK.queries
    ORACLE_SQL |= module.BOOK.sql

"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from codeloom.llm import document_queries, source_queries, vector_queries

MODULES = (source_queries, vector_queries, document_queries)

QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}

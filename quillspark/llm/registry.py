"""Queries of the corpus operators and their DuckDB statements."""

from __future__ import annotations

from quillspark.llm import queries as _queries

QUERIES = _queries.R.queries
ORACLES = _queries.R.oracles

"""Name -> query, and name -> the equal DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import files, graphs, mining, models, relational, retail, reviews, statistics, streams, texts, timeseries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (relational, timeseries, retail, statistics, mining, graphs, texts, streams, files, models, reviews):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

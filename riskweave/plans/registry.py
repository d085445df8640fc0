"""Query registry: name → Spark plan builder, and name → DuckDB oracle SQL.

A query builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the driver tables.
Queries registered without SQL are checked rows-only (non-SQL operators: ML, streaming, MMR).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        fn.query_name = name
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``@register`` calls run."""
    from riskweave.plans import (  # noqa: F401
        q_text, q_relational, q_lexicon, q_tagging, q_rank, q_stats, q_html, q_filings, q_utterances, q_ml, q_io,
    )

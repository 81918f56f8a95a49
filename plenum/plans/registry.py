"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plenum.plans import indexes, modelled, searches, spans, texts, updates, written

FLAGSHIP = "hybrid_rrf"
MODULES = (searches, indexes, modelled, texts, spans, updates, written)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

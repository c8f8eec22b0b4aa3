"""All queries over the governed model, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import access, consolidation, directory, ingestion, operations, recall, resolution, streams, temporal, upkeep

_FAMILIES = (recall, temporal, access, resolution, operations, consolidation, directory, ingestion, streams, upkeep)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _FAMILIES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _FAMILIES for k, s in m.ORACLE_SQL.items()}

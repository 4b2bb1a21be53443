"""Names of the core queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pramana.plans import answering, building, dataset, experiments, pipeline, retrieval, textual

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "bm25_topk"
FAMILIES = [textual, retrieval, answering, pipeline, building, dataset, experiments]


def queries() -> dict[str, Query]:
    return {f.__name__: f for family in FAMILIES for f in family.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()} | answering._late() | dataset._late() | pipeline._late()

"""All registered queries of the scene operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placeloom.plans import catalog, catalog2  # noqa: F401  catalog2 registers more


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planning query: the best areas for a query vector and the walk between them."""
    return catalog.e8_plan_route(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)

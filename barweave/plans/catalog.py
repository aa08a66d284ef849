"""All named queries: importing the catalog modules fills the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from . import catalog_bars, catalog_basics, catalog_reports, catalog_research, catalog_select  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return registry.QUERIES["x00_momentum_top1"](spark, folder)

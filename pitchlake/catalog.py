"""All registered queries of the library, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchlake.plans import evaluation, forecasts, readiness, research, status, storage, tickets

REGISTRIES = [forecasts.R, evaluation.R, tickets.R, storage.R, readiness.R, research.R, status.R]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.binary_quality_by_group(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for r in REGISTRIES for name, f in r.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}

"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import feed, macro, macro_sql, news, problems, reports


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.latest_states(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | macro.QUERIES | news.QUERIES | feed.QUERIES | reports.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems.SQL | macro_sql.SQL | news.SQL | feed.SQL | reports.SQL

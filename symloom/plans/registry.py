"""All queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.plans import basic, corpus, functions, named


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return basic.query.queries | functions.query.queries | named.query.queries | corpus.QUERIES


def oracle_sql() -> dict[str, str]:
    return basic.query.oracle | functions.query.oracle | named.query.oracle | corpus.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named.dependencies(spark, sf_dir)

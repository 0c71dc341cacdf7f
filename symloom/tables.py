"""Reading input tables, and one record per id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_key(df: DataFrame, keys: Sequence[str], columns: Sequence[str], newest: str | None = None) -> DataFrame:
    """One row for each value of `keys`; rows with a null key are left out.

    Of several rows the one with the latest `newest` wins (null counts as oldest), then the greatest
    values of `columns` in order, nulls last of all, so that the result does not depend on row order.
    It is one aggregate over a struct: partial results are combined before the shuffle and no group is ever
    held as a whole. As strings are no fixed-size state, Spark sorts for it, and spills when it must.
    """
    rank = [F.col(newest)] if newest and newest not in columns else []
    lead = [F.col(newest).alias("_newest")] if newest else []
    value = F.struct(*lead, *[F.col(c) for c in columns])
    kept = df
    for key in keys:
        kept = kept.filter(F.col(key).isNotNull())
    best = kept.select(*keys, *rank, *[c for c in columns if c not in keys]).groupBy(*keys).agg(F.max(value).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns if c not in keys])


def newest_sql(name: str, columns: Sequence[str], newest: str) -> str:
    """The same record per id in SQL: SELECT id, <columns> of a table."""
    order = ", ".join(f"{c} DESC NULLS LAST" for c in (newest, *columns))
    return f"SELECT id, {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS _k FROM {name} WHERE id IS NOT NULL) WHERE _k = 1"

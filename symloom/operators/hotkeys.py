"""Per-key results when a few keys hold most of the rows (problem 2).

Every result is made of mergeable states: each task folds its rows into a hash table of partial states
(Spark's partial hash aggregate, which spills when it is full), and only those states are shuffled. A
key that holds a third of the table therefore arrives as one small row per map task, and no task is
longer than another. Distinct counts get a first aggregate on (key, value), whose groups are spread over
all tasks although the key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.session import Cuts
from symloom.tables import one_per_key


def records(df: DataFrame, id_col: str, columns: Sequence[str], newest: str | None) -> DataFrame:
    """Repeated rows of an id as one record; a null id is no record. The ids are spread evenly."""
    return one_per_key(df, [id_col], columns, newest)


def per_key(df: DataFrame, key: str, states: Mapping[str, Column], distinct: Sequence[str] = ()) -> DataFrame:
    """One row per non-null `key` with the algebraic aggregates in `states` and exact distinct counts.

    `states` must be algebraic (count, sum, min, max, avg, bool_or, max_by ...), so that partial states
    stay of constant size. Each column in `distinct` adds `n_distinct_<column>`, nulls not counted.
    An empty table gives an empty result. Other columns of `df`, whatever their names, do not matter.
    """
    keyed = df.filter(F.col(key).isNotNull())
    result = keyed.groupBy(key).agg(*[agg.alias(name) for name, agg in states.items()])
    for column in distinct:
        pairs = keyed.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.lit(1).alias("_one"))
        counts = pairs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(f"n_distinct_{column}"))
        result = result.join(counts, F.col(key) == F.col("_key"), "left").drop("_key")
        result = result.withColumn(f"n_distinct_{column}", F.coalesce(f"n_distinct_{column}", F.lit(0).cast("long")))
    return result


def heavy_keys(df: DataFrame, id_col: str, key: str, share: float, field_name: str, newest: str | None = None) -> DataFrame:
    """(field_name, key_value) of every key that at least `share` of all distinct ids carry.

    Ids whose key is null count in the total; null is never a key. The per-key counts are made and written
    once; their sum, the total, is taken on the way, and the filter on the count reaches the scan. Nothing per
    key is collected.
    """
    counts = records(df, id_col, [key], newest).groupBy(F.col(key).alias("key_value")).agg(F.count("*").alias("_n"))
    held, seen = Cuts(df.sparkSession, "hotkeys").measured(counts, total=F.sum("_n"))
    least = math.ceil((seen["total"] or 0) * share - 1e-9)
    return held.filter((F.col("_n") >= least) & F.col("key_value").isNotNull()).select(F.lit(field_name).alias("field_name"), "key_value")

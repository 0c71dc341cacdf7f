"""Graph patterns as joins: expand, optional, anti, product, and theta joins on substrings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand(start: DataFrame, edges: DataFrame, start_col: str, end_col: str, direction: str = "out", keep: Sequence[str] = ()) -> DataFrame:
    """One hop: a row per edge at `start_col`, with the other end in `end_col`; parallel edges multiply rows.

    `edges` is already restricted to its type. `keep` are edge columns that the result needs. Null ends
    never match. Catalyst picks the join; AQE splits hub nodes.
    """
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    hop = edges.select(F.col(here).alias("_here"), F.col(there).alias(end_col), *keep)
    return start.join(hop, F.col(start_col) == F.col("_here"), "inner").drop("_here")


def attach(rows: DataFrame, nodes: DataFrame, at: str, columns: dict[str, str | Column], how: str = "inner") -> DataFrame:
    """Properties of the node whose id stands in `at`, under new names."""
    named = nodes.select(F.col("id").alias("_id"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    return rows.join(named, F.col(at) == F.col("_id"), how).drop("_id")


def optional(rows: DataFrame, pattern: DataFrame, on: str) -> DataFrame:
    """OPTIONAL MATCH: the whole pattern, already joined, matches or is null."""
    return rows.join(pattern, on, "left")


def without(rows: DataFrame, edges: DataFrame, at: str, far: DataFrame | None = None, direction: str = "out") -> DataFrame:
    """Rows whose node has no such edge; with `far`, none that leads to one of those nodes."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    hop = edges.select(F.col(here).alias("_here"), F.col(there).alias("_there"))
    if far is not None:
        hop = hop.join(far.select(F.col("id").alias("_there")), "_there", "left_semi")
    return rows.join(hop, F.col(at) == F.col("_here"), "left_anti")


def first_of(rows: DataFrame, key: str, order: Sequence, limit: int) -> DataFrame:
    """The first `limit` rows of each key. Spark limits each task's rows by rank before the shuffle, so a hot key sends
    no more than that many rows from each task."""
    from pyspark.sql import Window as W

    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")


def product_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of two tables of a known few rows each (one-row aggregates): pre-aggregate, then cross."""
    return left.crossJoin(F.broadcast(right))


def mentions(tokens: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Tokens joined to names that contain them, the first `limit` names (by name, then id) for each.

    tokens (token), names (id, text, alt): a name matches when text or alt contains the token. A
    substring join as an equi-join: both sides are cut into overlapping character trigrams, the token's
    rarest trigram is looked up, and the full test follows. No pair is made that does not share the trigram.
    """
    from pyspark.sql import Window as W

    distinct = tokens.filter("token is not null and token <> ''").select("token").distinct()
    # Short tokens have no trigram; they are looked up by their own one or two characters.
    size = F.least(F.length("token"), F.lit(3))
    sized = distinct.withColumn("_size", size)
    parts = []
    for n in (1, 2, 3):
        wanted = sized.filter(F.col("_size") == n).select("token", F.explode(_grams("token", n)).alias("_gram"))
        texts = names.select("id", "text", "alt", F.explode(F.array_distinct(F.flatten(F.array(_grams("text", n), _grams("alt", n))))).alias("_gram"))
        if n == 3:
            counts = texts.groupBy("_gram").agg(F.count("*").alias("_n"))
            rarest = wanted.join(counts, "_gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), F.col("_gram"))).alias("_r"))
            wanted = rarest.select("token", F.col("_r._gram").alias("_gram"))
        else:  # no names are cut for sizes that no token has
            texts = texts.join(wanted.select("_gram").distinct(), "_gram", "left_semi")
        parts.append(wanted.join(texts, "_gram"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    hit = every.filter(F.coalesce(F.contains("text", "token"), F.lit(False)) | F.coalesce(F.contains("alt", "token"), F.lit(False)))
    first = W.partitionBy("token").orderBy(F.col("text").asc_nulls_last(), "id")
    # Spark limits each task's rows by rank before the shuffle, so a token that nearly all names hold is no hot task.
    return hit.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= limit).select("token", "id", "text")


def _grams(column: str, n: int) -> Column:
    size = F.coalesce(F.length(column), F.lit(0))
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(F.col(column), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

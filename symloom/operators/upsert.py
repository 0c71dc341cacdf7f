"""Keyed upserts and deletes as joins: create, merge, batch merge, edges, detach-delete.

`present` columns tell a property that a batch does not mention from one that it sets to null: the first
survives, the second is removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, keys: Sequence[str], order: str, properties: Sequence[str]) -> DataFrame:
    """One row per key: of each property the last value that a row of the batch mentions (has_<property>)."""
    aggregates = []
    for p in properties:
        said = F.when(F.col(f"has_{p}"), F.struct(F.col(order).alias("o"), F.col(p).alias("v")))
        aggregates += [F.max(said)["v"].alias(p), F.coalesce(F.max(F.col(f"has_{p}").cast("int")) > 0, F.lit(False)).alias(f"has_{p}")]
    return batch.groupBy(*keys).agg(*aggregates)


def merge(nodes: DataFrame, batch: DataFrame, keys: Sequence[str], order: str, properties: Sequence[str], on_create_only: bool = False) -> DataFrame:
    """MERGE on `keys`, then set: keys that exist get the batch's mentioned properties, others are created.

    All nodes that share a key are updated. Null keys match nothing: such nodes stay, and the rows of the batch
    with the same null key are one new node, as those of any other key are. With on_create_only existing nodes are
    left as they are.
    """
    new = last_of_batch(batch, keys, order, properties)
    renamed = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(p).alias(f"_n_{p}") for p in properties], *[F.col(f"has_{p}").alias(f"_h_{p}") for p in properties], F.lit(True).alias("_new"))
    held = nodes.select(*keys, *properties).withColumn("_old", F.lit(True))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    both = held.join(renamed, on, "full_outer")
    out = [F.coalesce(F.col(k), F.col(f"_k_{k}")).alias(k) for k in keys]
    for p in properties:
        take = F.col("_h_" + p) & (F.col("_old").isNull() if on_create_only else F.lit(True))
        out.append(F.when(F.coalesce(take, F.lit(False)), F.col(f"_n_{p}")).otherwise(F.col(p)).alias(p))
    return both.select(*out)


def replace(nodes: DataFrame, batch: DataFrame, keys: Sequence[str], order: str, properties: Sequence[str]) -> DataFrame:
    """MERGE on `keys`, then replace: the last row of the batch is all that a node has afterwards.

    Properties that it does not mention (has_<property> is false) or sets to null are gone; nodes without a row in
    the batch stay as they are, all nodes that share a key are replaced, new keys are created.
    """
    value = F.struct(*[F.when(F.col(f"has_{p}"), F.col(p)).alias(p) for p in properties])
    last = batch.groupBy(*keys).agg(F.max_by(value, order).alias("_v"))
    renamed = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_v", F.lit(True).alias("_new"))
    both = nodes.select(*keys, *properties).join(renamed, [F.col(k) == F.col(f"_k_{k}") for k in keys], "full_outer")
    return both.select(*[F.coalesce(k, f"_k_{k}").alias(k) for k in keys], *[F.when(F.col("_new"), F.col(f"_v.{p}")).otherwise(F.col(p)).alias(p) for p in properties])


def create_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends both exist, the others): the second is what a single create reports as an error and
    a batch leaves out silently."""
    ids = nodes.select("id").distinct()
    good = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    missing_src = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    missing_dst = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return good, missing_src.unionByName(missing_dst)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (type, src, dst): the sane reading of repeated indexing."""
    return edges.withColumn("_k", F.row_number().over(W.partitionBy("type", "src", "dst").orderBy("id"))).filter("_k = 1").drop("_k")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in `gone` (id) and all edges at them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left

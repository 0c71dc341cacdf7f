"""Parent-child links to full hierarchies by pointer doubling (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import Cuts


#: Lookups in one round.
JUMPS = 3


def parent_links(df: DataFrame, parent: str, child: str, order: str | None = None) -> DataFrame:
    """(node, parent, ord, inner): every id that stands in either column, once, with its one parent or null, and
    whether it is a parent itself.

    A null parent says that there is none, a null child says nothing of a child (its parent is still a
    node). A link delivered twice counts once. Should a node have several parents, the one with the
    smallest `order` (nulls last), then the smallest id, is taken. A node that is its own parent is a
    circle of one.
    """
    rank = F.col(order).cast("long") if order else F.lit(None).cast("long")
    link = F.struct(F.col(child).alias("node"), F.col(parent).alias("parent"), rank.alias("ord"), F.lit(False).alias("inner"))
    # The parent is a node too: both facts come from one scan and meet in one aggregate, so the ids shuffle once.
    above = F.struct(F.col(parent).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("ord"), F.col(child).isNotNull().alias("inner"))
    facts = df.select(F.inline(F.array(link, above))).filter("node is not null")
    best = F.min(F.when(F.col("parent").isNotNull(), F.struct(F.coalesce("ord", F.lit(2**62)).alias("o"), F.col("parent").alias("p"), F.col("ord").alias("ord"))))
    return facts.groupBy("node").agg(best.alias("_best"), F.max("inner").alias("inner")).select("node", F.col("_best.p").alias("parent"), F.col("_best.ord").alias("ord"), "inner")


def resolve(links: DataFrame, with_path: bool = False, max_rounds: int = 40) -> DataFrame:
    """(node, root_id, depth[, path]) of every node in `links` (node, parent, inner), as parent_links() makes them.

    Pointer doubling: each node keeps a pointer to an ancestor and its distance; a lookup adds the pointer
    found there. A round of JUMPS lookups in the same table multiplies distances by JUMPS + 1 (two doublings), so a
    tree of depth d takes log4(d) rounds. A round that ends no chain proves that the open ones run in circles: with
    depths in (4^k, 4^(k+1)] empty, no greater depth can occur. Nodes on a circle or below one get root_id '' and
    depth -1 (and a null path; a path is the array of ids from the root down to the node).

    Only inner nodes take part in the rounds; leaves are attached with one join at the end. A round is one job: it
    reads the open rows and writes them again, those whose chain ended into a part of their own that no later round
    writes again. The looked-up side is unique by node and shuffled once a round; a hot ancestor loads the other side
    only, which AQE splits, and few open rows are broadcast by their known size. `max_rounds` is no bound on the
    data: 4^40 levels.
    """
    cuts = Cuts(links.sparkSession, "hierarchy")
    links = cuts.cut(links.select("node", "parent", "inner"))
    path = ["path"] if with_path else []
    # far: the ancestor reached; hops: how far off it is; path: the ids below it.
    roots = links.filter("inner and parent is null").select("node", F.col("node").alias("root_id"), F.lit(0).cast("long").alias("hops"), *[F.array("node").alias(p) for p in path])
    opened = links.filter("inner and parent is not null").select("node", F.col("parent").alias("far"), F.lit(1).cast("long").alias("hops"), *[F.array("node").alias(p) for p in path])
    null = F.lit(None).cast("string")
    ended = roots
    for _ in range(max_rounds):
        there = ended.select(F.col("node").alias("_at"), null.alias("_far"), F.col("root_id").alias("_root"), F.col("hops").alias("_hops"), *[F.col(p).alias("_path") for p in path])
        there = there.unionByName(opened.select(F.col("node").alias("_at"), F.col("far").alias("_far"), null.alias("_root"), F.col("hops").alias("_hops"), *[F.col(p).alias("_path") for p in path]))
        moved = opened.withColumn("root_id", null)
        for _ in range(JUMPS):
            # Ended rows look up an id of their own that there is not, so that they do not meet in one task.
            key = F.coalesce("far", F.concat(F.lit("\0"), "node"))
            moved = moved.withColumn("_key", key).join(there, F.col("_key") == F.col("_at"), "left").select(
                "node", F.col("_far").alias("far"), F.coalesce("root_id", "_root").alias("root_id"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), *[F.when(F.col("_path").isNull(), F.col(p)).otherwise(F.concat("_path", p)).alias(p) for p in path]
            )
        (done, still), (more, rest) = cuts.split(moved.withColumn("ended", F.col("root_id").isNotNull()), "ended", "rounds")
        if done:
            ended = roots.unionByName(more.select("node", "root_id", "hops", *path))
        opened = rest.select("node", "far", "hops", *path) if still else None
        if not still or not done:
            break
    leaves = links.filter("not inner")
    lone = leaves.filter("parent is null").select("node", F.col("node").alias("root_id"), F.lit(0).cast("long").alias("hops"), *[F.array("node").alias(p) for p in path])
    known = ended.select(F.col("node").alias("parent"), "root_id", "hops", *path)
    attached = leaves.filter("parent is not null").join(known, "parent", "left").select("node", "root_id", (F.col("hops") + 1).alias("hops"), *[F.concat(p, F.array("node")).alias(p) for p in path])
    both = ended.unionByName(lone).unionByName(attached)
    if opened is not None:  # on a circle, or below one
        both = both.unionByName(opened.select("node", F.lit(None).cast("string").alias("root_id"), "hops", *path))
    lost = F.col("root_id").isNull()
    return both.select(F.col("node").alias("node_id"), F.coalesce("root_id", F.lit("")).alias("root_id"), F.when(lost, F.lit(-1)).otherwise(F.col("hops")).cast("long").alias("depth"), *[F.when(~lost, F.col(p)).alias(p) for p in path])


def descendants(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance): all descendants of every node that has a root.

    Read off the paths: a node of depth d stands below d ancestors, so the result has as many rows as
    the depths add up to, made without a join. Nodes on or below a circle have none.
    """
    rooted = resolved.filter(F.col("depth") > 0)
    above = rooted.select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_at", "node_id"))
    return above.select("node_id", "descendant_id", (F.col("depth") - F.col("_at")).cast("long").alias("distance"))


def subtree_sizes(resolved: DataFrame) -> DataFrame:
    """(node_id, n_descendants, height) of every node with a root; mergeable counts, so a root above a
    third of all nodes is no hot task."""
    way = resolved.filter(F.col("depth") >= 0).select("depth", F.posexplode("path").alias("_at", "node_id"))
    return way.groupBy("node_id").agg((F.count("*") - 1).alias("n_descendants"), F.max(F.col("depth") - F.col("_at")).cast("long").alias("height"))

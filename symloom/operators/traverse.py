"""Variable-length traversal: reachability by levels, and edge-unique trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import Cuts


def reachable(edges: DataFrame, seeds: DataFrame, min_hops: int = 1, max_hops: int | None = None, direction: str = "out") -> DataFrame:
    """(seed, node, depth): every node in min_hops..max_hops hops of a seed, with its least depth of at least 1.

    seeds (seed). A seed itself is returned only when it lies on a circle. Each level joins the frontier
    with the edges, leaves out what was seen, and is written, so a lost executor costs one level. Rows
    are distinct (seed, node) pairs: the result, not the trails, bounds the work. Null ends never match;
    a label is tested on the result, as inner nodes may carry any.
    """
    cuts = Cuts(edges.sparkSession, "reach")
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    hop = cuts.cut(edges.select(F.col(here).alias("_at"), F.col(there).alias("node")).distinct())
    frontier = seeds.filter("seed is not null").select("seed", F.col("seed").alias("_at")).distinct()
    seen: DataFrame | None = None
    levels: list[DataFrame] = []
    depth = 0
    while max_hops is None or depth < max_hops:
        depth += 1
        new = frontier.join(hop, "_at").select("seed", "node").distinct()
        if seen is not None:
            new = new.join(seen, ["seed", "node"], "left_anti")
        level, told = cuts.measured(new, n=F.count(F.lit(1)))
        if not told["n"]:
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
        seen = level if seen is None else seen.unionByName(level)
        frontier = level.withColumnRenamed("node", "_at")
    if not levels:
        return seeds.sparkSession.createDataFrame([], "seed string, node string, depth int")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter(F.col("depth") >= min_hops)


def call_edges(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(seed, src, dst, recursive): the edges of the graph within max_hops of each seed, each once.

    recursive is true where the edge lies on a circle of that graph: from its end its start is reached again. An edge
    to itself is one. The circle is looked for among the edges of the same seed only.
    """
    cuts = Cuts(edges.sparkSession, "calls")
    far = reachable(edges, seeds, 1, max_hops - 1) if max_hops > 1 else None
    inner = seeds.filter("seed is not null").select("seed", F.col("seed").alias("src")).distinct()
    if far is not None:
        inner = inner.unionByName(far.select("seed", F.col("node").alias("src"))).distinct()
    own = cuts.cut(inner.join(edges.select("src", "dst").distinct(), "src").select("seed", "src", "dst"))
    # Ids are made of seed and node, so that circles of different seeds stay apart.
    tag = lambda c: F.concat_ws("\0", "seed", c)
    tagged = own.select(tag("src").alias("src"), tag("dst").alias("dst"))
    again = reachable(tagged, tagged.select(F.col("dst").alias("seed")).distinct(), 1, None).select(F.col("seed").alias("_end"), F.col("node").alias("_start"))
    itself = tagged.select(F.col("dst").alias("_end"), F.col("dst").alias("_start"))
    back = again.unionByName(itself).distinct().withColumn("_back", F.lit(True))
    joined = own.join(back, (tag("dst") == F.col("_end")) & (tag("src") == F.col("_start")), "left")
    return joined.select("seed", "src", "dst", F.coalesce("_back", F.lit(False)).alias("recursive"))


def trails(edges: DataFrame, seeds: DataFrame, min_hops: int = 1, max_hops: int | None = None, direction: str = "out", max_rows: int | None = None) -> DataFrame:
    """(seed, edge_ids, node_ids, depth): every walk from a seed that uses no edge twice.

    Nodes may repeat, edges may not; parallel edges make separate trails. The number of trails can grow
    with every level: without max_hops the edges should be of a tree-shaped type. `max_rows` raises
    rather than truncates when a level has more.
    """
    cuts = Cuts(edges.sparkSession, "trails")
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    hop = cuts.cut(edges.select(F.col("id").alias("_edge"), F.col(here).alias("_at"), F.col(there).alias("_to")))
    nothing = F.array().cast("array<string>")
    front = seeds.filter("seed is not null").select("seed", F.col("seed").alias("_at"), nothing.alias("edge_ids"), F.array("seed").alias("node_ids")).distinct()
    levels: list[DataFrame] = []
    depth = 0
    while max_hops is None or depth < max_hops:
        depth += 1
        joined = front.join(hop, "_at").filter(~F.array_contains("edge_ids", F.col("_edge")))
        level, told = cuts.measured(joined.select("seed", F.col("_to").alias("_at"), F.array_append("edge_ids", F.col("_edge")).alias("edge_ids"), F.array_append("node_ids", F.col("_to")).alias("node_ids")), n=F.count(F.lit(1)))
        if max_rows and told["n"] > max_rows:
            raise ValueError(f"more than {max_rows} trails of length {depth}")
        if not told["n"]:
            break
        levels.append(level.select("seed", "edge_ids", "node_ids").withColumn("depth", F.lit(depth)))
        front = level
    if not levels:
        return seeds.sparkSession.createDataFrame([], "seed string, edge_ids array<string>, node_ids array<string>, depth int")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter(F.col("depth") >= min_hops)

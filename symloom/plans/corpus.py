"""Queries of the general corpus problems: hot keys (2) and hierarchies (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import hierarchy, hotkeys
from symloom.tables import table

#: A key is heavy from this share of all distinct ids.
HEAVY_SHARE = 0.02


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = hotkeys.heavy_keys(table(spark, sf_dir, "references_rel"), "id", "end_id", HEAVY_SHARE, "references_rel.end_id", "ingested_at")
    symbols = hotkeys.heavy_keys(table(spark, sf_dir, "code_symbols"), "id", "symbol", HEAVY_SHARE, "code_symbols.symbol", "created_at")
    return references.unionByName(symbols)


def p2_reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct callers and line range per referenced symbol, over one record per id."""
    columns = ["end_id", "start_id", "line_no", "is_definition", "created_at"]
    rows = hotkeys.records(table(spark, sf_dir, "references_rel"), "id", columns, "ingested_at")
    states = {
        "n_refs": F.count("*"),
        "n_definitions": F.coalesce(F.sum(F.col("is_definition").cast("long")), F.lit(0)),
        "first_line": F.min("line_no"),
        "last_line": F.max("line_no"),
        "first_seen": F.min("created_at"),
        "last_seen": F.max("created_at"),
    }
    return hotkeys.per_key(rows, "end_id", states, ["start_id"])


def p2_symbol_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and kinds per symbol string, over one record per id."""
    rows = hotkeys.records(table(spark, sf_dir, "code_symbols"), "id", ["symbol", "kind", "display_name", "documentation"], "created_at")
    states = {
        "n_symbols": F.count("*"),
        "n_documented": F.coalesce(F.sum((F.length("documentation") > 0).cast("long")), F.lit(0)),
        "first_kind": F.min("kind"),
    }
    return hotkeys.per_key(rows, "symbol", states, ["kind", "display_name"])


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.parent_links(table(spark, sf_dir, "contains_rel"), "start_id", "end_id", "child_order")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, sf_dir)).select("node_id", "root_id", "depth")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root, number of descendants and height of every node; nodes without a root as in p5_found."""
    resolved = hierarchy.resolve(_links(spark, sf_dir), with_path=True)
    sizes = hierarchy.subtree_sizes(resolved).withColumnRenamed("node_id", "_id")
    return resolved.join(sizes, F.col("node_id") == F.col("_id"), "left").select(
        "node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.coalesce("height", F.lit(0)).alias("height")
    )


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant, distance) of the forest."""
    links = _links(spark, sf_dir)
    return hierarchy.descendants(links, hierarchy.resolve(links, with_path=True))


QUERIES = {f.__name__: f for f in (p2_found, p2_reference_stats, p2_symbol_stats, p5_found, p5_hierarchy, p5_descendants)}

_REF = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, end_id DESC NULLS LAST, start_id DESC NULLS LAST,
  line_no DESC NULLS LAST, is_definition DESC NULLS LAST, created_at DESC NULLS LAST) AS k FROM references_rel WHERE id IS NOT NULL) WHERE k = 1)"""
_SYM = """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, symbol DESC NULLS LAST, kind DESC NULLS LAST,
  display_name DESC NULLS LAST, documentation DESC NULLS LAST) AS k FROM code_symbols WHERE id IS NOT NULL) WHERE k = 1)"""
_TREE = """best AS (SELECT end_id AS node, min(struct_pack(o := coalesce(child_order, 4611686018427387904), p := start_id)) AS b
  FROM contains_rel WHERE end_id IS NOT NULL AND start_id IS NOT NULL GROUP BY end_id),
ids AS (SELECT start_id AS node FROM contains_rel WHERE start_id IS NOT NULL UNION SELECT end_id FROM contains_rel WHERE end_id IS NOT NULL),
links AS (SELECT ids.node, b.p AS parent FROM ids LEFT JOIN best ON ids.node = best.node),
t AS (SELECT node, node AS root, 0::BIGINT AS depth, [node] AS way FROM links WHERE parent IS NULL
  UNION ALL SELECT l.node, t.root, t.depth + 1, list_append(t.way, l.node) FROM t JOIN links l ON l.parent = t.node)"""

ORACLE = {
    "p2_found": f"""WITH {_REF}, {_SYM},
rc AS (SELECT end_id AS key_value, count(*) AS n, sum(count(*)) OVER () AS total FROM r GROUP BY end_id),
sc AS (SELECT symbol AS key_value, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY symbol)
SELECT 'references_rel.end_id' AS field_name, key_value FROM rc WHERE key_value IS NOT NULL AND n >= total * {HEAVY_SHARE}
UNION ALL SELECT 'code_symbols.symbol', key_value FROM sc WHERE key_value IS NOT NULL AND n >= total * {HEAVY_SHARE}""",
    "p2_reference_stats": f"""WITH {_REF} SELECT end_id, count(*) AS n_refs, coalesce(sum(is_definition::BIGINT), 0)::BIGINT AS n_definitions, min(line_no) AS first_line,
max(line_no) AS last_line, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT start_id) AS n_distinct_start_id FROM r WHERE end_id IS NOT NULL GROUP BY end_id""",
    "p2_symbol_stats": f"""WITH {_SYM} SELECT symbol, count(*) AS n_symbols, coalesce(sum((length(documentation) > 0)::BIGINT), 0)::BIGINT AS n_documented, min(kind) AS first_kind,
count(DISTINCT kind) AS n_distinct_kind, count(DISTINCT display_name) AS n_distinct_display_name FROM s WHERE symbol IS NOT NULL GROUP BY symbol""",
    "p5_found": f"""WITH RECURSIVE {_TREE} SELECT l.node AS node_id, coalesce(t.root, '') AS root_id, coalesce(t.depth, -1) AS depth FROM links l LEFT JOIN t ON l.node = t.node""",
    "p5_hierarchy": f"""WITH RECURSIVE {_TREE}, below AS (SELECT unnest(way) AS node, unnest(range(len(way))) AS pos, depth FROM t),
size AS (SELECT node, count(*) - 1 AS n, max(depth - pos) AS h FROM below GROUP BY node)
SELECT l.node AS node_id, coalesce(t.root, '') AS root_id, coalesce(t.depth, -1) AS depth, array_to_string(t.way, ' > ') AS path,
coalesce(size.n, 0) AS n_descendants, coalesce(size.h, 0)::BIGINT AS height FROM links l LEFT JOIN t ON l.node = t.node LEFT JOIN size ON size.node = l.node""",
    "p5_descendants": f"""WITH RECURSIVE {_TREE}, above AS (SELECT node, depth, unnest(way) AS anc, unnest(range(len(way))) AS pos FROM t)
SELECT anc AS node_id, node AS descendant_id, (depth - pos)::BIGINT AS distance FROM above WHERE pos < depth""",
}

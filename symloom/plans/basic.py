"""Scans, projections, predicates, joins, aggregates and top-k over the graph (inventory A to F, S)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import model
from symloom.functions import symbols as sym
from symloom.operators import pattern, scan, upsert
from symloom.plans.base import Registry
from symloom.plans.star import EDGES_SQL, NODES_SQL, Star
from symloom.session import shared_dir
from symloom.tables import newest_sql, one_per_key, table

query = Registry()
_G = f"WITH {NODES_SQL}, {EDGES_SQL} "
_N = f"WITH {NODES_SQL} "
ALL_LABELS = ("Service", "File", "Class", "Interface", "Method", "Function", "Symbol", "APIRoute", "Parameter", "Variable", "Reference", "Document")


@query(f"{_N} SELECT id, name, signature FROM nodes WHERE label = 'Function'")
def a1_label_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.label_scan(Star(spark, sf).nodes("Function"), "Function").select("id", "name", "signature")


@query(f"{_N} SELECT id, name FROM nodes WHERE label = 'Function' ORDER BY id LIMIT 10")
def f6_limited_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with a limit, over a total order, so that it is repeatable."""
    return scan.label_scan(Star(spark, sf).nodes("Function"), "Function", 10).select("id", "name")


@query(f"{_N} SELECT id, fqn FROM nodes WHERE label = 'Class' AND name = 'Customer#000000007'")
def a2_property_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return scan.by_property(Star(spark, sf).nodes("Class"), "Class", "name", "Customer#000000007").select("id", "fqn")


@query(f"{_N} SELECT id, label FROM nodes")
def a3_all_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes().select("id", "label")


@query(f"{_G} SELECT a.label AS from_label, type, b.label AS to_label, count(*) AS n FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id GROUP BY ALL")
def a4_all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All edges with the labels of their ends; edges that lead nowhere are left out."""
    return Star(spark, sf).labelled_edges().groupBy("from_label", "type", "to_label").agg(F.count("*").alias("n"))


_SKIPPED = ", ".join(f"'{folder}'" for folder in sym.SKIPPED_FOLDERS)


@query(f"SELECT DISTINCT path FROM code_sources WHERE ends_with(path, '.go') AND NOT ends_with(path, '_test.go') AND NOT list_has_any(string_split(path, '/')[1:-2], [{_SKIPPED}])")
def a5_go_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_sources").select("path").filter(sym.is_go_source(F.col("path"))).distinct()


@query()
def a6_go_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations of all Go files."""
    from symloom.sources import gosrc

    return gosrc.extract(table(spark, sf, "code_sources").filter(sym.is_go_source(F.col("path"))))


_GO = f"ends_with({{c}}, '.go') AND NOT ends_with({{c}}, '_test.go') AND NOT list_has_any(string_split({{c}}, '/')[1:-2], [{_SKIPPED}])"


@query(
    "WITH f AS (" + newest_sql("code_functions", ("name", "file_path", "start_line", "end_line", "start_byte", "end_byte"), "updated_at") + f"), src AS (SELECT path, max(octet_length(content)) AS size FROM code_sources WHERE {_GO.format(c='path')} GROUP BY path) "
    "SELECT f.id AS function_id, end_line, CASE WHEN end_byte <= size THEN start_byte END AS start_byte, CASE WHEN end_byte <= size THEN end_byte END AS end_byte FROM f JOIN src ON src.path = f.file_path WHERE start_line IS NOT NULL"
)
def a6_known_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The functions and methods of the given table in Go files, with the last line and the bytes that the declarations
    of the files give for them; bytes only where the table's own fit the file."""
    from symloom.sources import gosrc

    sources = table(spark, sf, "code_sources").filter(sym.is_go_source(F.col("path")))
    columns = ["name", "file_path", "start_line", "start_byte", "end_byte"]
    given = one_per_key(table(spark, sf, "code_functions").select("id", *columns, "updated_at"), ["id"], columns, "updated_at").filter("start_line is not null")
    found = gosrc.extract(sources).filter("label in ('Function', 'Method')").select("file_path", "name", "start_line", "end_line", F.col("start_byte").alias("_a"), F.col("end_byte").alias("_b"))
    sizes = sources.groupBy(F.col("path").alias("file_path")).agg(F.max(F.octet_length("content")).alias("_size"))
    joined = given.join(found, ["file_path", "name", "start_line"]).join(sizes, "file_path")
    fits = F.col("end_byte") <= F.col("_size")
    return joined.select(F.col("id").alias("function_id"), "end_line", F.when(fits, F.col("_a")).alias("start_byte"), F.when(fits, F.col("_b")).alias("end_byte"))


@query("SELECT DISTINCT path, CASE WHEN path LIKE '%.go' THEN 'Go' WHEN path LIKE '%.java' THEN 'Java' WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.ts' OR path LIKE '%.js' THEN 'TypeScript' ELSE 'unknown' END AS code_language FROM code_sources")
def a9_file_languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_sources").select("path", sym.language(F.col("path")).alias("code_language")).distinct()


_REFS = "refs AS (SELECT id, end_id, start_id, line_no, is_definition AS def FROM (" + newest_sql("references_rel", ("end_id", "start_id", "line_no", "is_definition"), "ingested_at") + ") WHERE end_id IS NOT NULL)"


@query(f"WITH {_REFS} SELECT end_id AS symbol_id, arg_min(start_id, (CASE WHEN def THEN 0 ELSE 1 END, id)) AS defined_in, min(id) AS first_occurrence, count(*) AS n_occurrences, count(*) FILTER (WHERE NOT def) AS n_usages FROM refs GROUP BY end_id")
def a10_symbol_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences grouped by symbol: the definition (else the first occurrence) and the usages, all algebraic."""
    one = one_per_key(table(spark, sf, "references_rel"), ["id"], ["end_id", "start_id", "line_no", "is_definition"], "ingested_at").filter("end_id is not null").withColumnRenamed("is_definition", "def")
    place = F.struct(F.when(F.col("def"), 0).otherwise(1), F.col("id"))
    return one.groupBy(F.col("end_id").alias("symbol_id")).agg(F.min_by("start_id", place).alias("defined_in"), F.min("id").alias("first_occurrence"), F.count("*").alias("n_occurrences"), F.count_if(~F.col("def")).alias("n_usages"))


@query("SELECT DISTINCT path, octet_length(content) > 0 AND ord(chr(('0x' || substr(hex(content), 1, 2))::INTEGER)) < 32 AS is_index, ('0x' || substr(hex(content), 1, 2))::INTEGER AS first_byte FROM code_sources WHERE octet_length(content) > 0")
def a12_binary_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """The first byte of each file, and whether it is below 32, as that of a protobuf file is."""
    first = F.conv(F.hex(F.substring("content", 1, 1)), 16, 10).cast("int")
    return table(spark, sf, "code_sources").filter(F.octet_length("content") > 0).select("path", (first < 32).alias("is_index"), first.alias("first_byte")).distinct()


@query("SELECT doc_id, source_url FROM documents WHERE lower(regexp_extract(source_url, '\\.[^./]*$')) IN ('.md', '.txt', '.rst', '.adoc')")
def a13_document_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(sym.is_document(F.col("source_url"))).select("doc_id", "source_url")


@query()
def a15_server_info(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.lit("spark").alias("name"), F.lit(spark.version).alias("version"), F.lit(spark.catalog.currentDatabase()).alias("database"))


_DECLARED = ", ".join([f"('{n}', 'UNIQUE', '{label}', '{p}')" for n, label, p in model.UNIQUE_KEYS] + [f"('{n}', 'BTREE', '{label}', '{','.join(p)}')" for n, label, p in model.INDEXES])


@query(f"SELECT * FROM (VALUES {_DECLARED}) v(name, kind, label, properties)")
def a16_schema_catalog(spark: SparkSession, sf: str) -> DataFrame:
    catalog = model.Catalog(spark)
    catalog.create_all()
    return catalog.show().withColumn("properties", F.array_join("properties", ","))


@query("SELECT 'connected' AS status")
def a17_constant(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.lit("connected").alias("status"))


# ------------------------------------------------------------------------------------ predicates (B), joins (C)


@query(f"{_N} SELECT id, name AS function_name, file_path AS location FROM nodes WHERE label = 'Function'")
def b1_projection(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes("Function").select("id", F.col("name").alias("function_name"), F.col("file_path").alias("location"))


@query(f"{_N} SELECT id, label AS first_label FROM nodes WHERE label IN ('Class', 'Interface')")
def b2_labels(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes("Class", "Interface").select("id", F.element_at("labels", 1).alias("first_label"))


@query(f"{_N} SELECT id, 'end_line=' || end_line || '|file_path=' || file_path || '|name=' || name || '|signature=' || signature || '|start_line=' || start_line AS properties FROM nodes WHERE label = 'Function'")
def b3_properties(spark: SparkSession, sf: str) -> DataFrame:
    """The bag of a node's properties, keys in order, without those that are not set."""
    columns = ("name", "signature", "symbol", "file_path", "start_line", "end_line", "title")
    bag = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns]), lambda e: e["v"].isNotNull()))
    pairs = F.array_sort(F.transform(F.map_entries("bag"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return Star(spark, sf).nodes("Function").select("id", bag.alias("bag")).select("id", F.array_join(pairs, "|").alias("properties"))


@query(f"{_G} SELECT src, type FROM edges WHERE type IN ('DEFINES', 'EXPOSES_API')")
def b4_edge_type(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).edges("DEFINES", "EXPOSES_API").select("src", "type")


@query(f"{_N} SELECT id, name FROM nodes WHERE id = 'fn:7'")
def b5_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes("Function").filter("id = 'fn:7'").select("id", "name")


@query(f"{_N} SELECT id FROM nodes WHERE label IN ('Class', 'Interface', 'APIRoute')")
def b6_label_union(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes().filter(scan.any_label("Class", "Interface", "APIRoute")).select("id")


@query(f"{_N} SELECT id, symbol FROM nodes WHERE label = 'Symbol' AND contains(symbol, 'PROMO') AND NOT contains(symbol, 'Brand#1')")
def b8_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Case-sensitive substring, and its negation."""
    return Star(spark, sf).nodes("Symbol").filter(F.contains("symbol", F.lit("PROMO")) & ~F.contains("symbol", F.lit("Brand#1"))).select("id", "symbol")


_MATCH = "(contains(lower(name), lower('{t}')) OR contains(lower(display_name), lower('{t}')) OR contains(lower(signature), lower('{t}')) OR contains(lower(symbol), lower('{t}')) OR contains(lower(path), lower('{t}')))"


@query(f"{_N} SELECT id, label FROM nodes WHERE {_MATCH.format(t='RING')}")
def b10_search_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Any of five nullable properties contains the term, whatever its case."""
    return Star(spark, sf).nodes().filter(scan.matches("RING")).select("id", "label")


@query(f"{_N} SELECT label, count(*) AS n FROM nodes WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND name IS NOT NULL GROUP BY label")
def b12_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes().filter("start_line is not null and end_line is not null and name is not null").groupBy("label").agg(F.count("*").alias("n"))


_RANK = "CASE WHEN label IN ('Function', 'Method') THEN 1 WHEN label IN ('Class', 'Interface') THEN 2 WHEN label IN ('Variable', 'Parameter') THEN 3 WHEN label IN ('File', 'Feature', 'Document') THEN 4 WHEN label = 'Symbol' THEN 5 ELSE 6 END"


@query(f"{_N} SELECT label, {_RANK} AS rank, count(*) AS n FROM nodes GROUP BY ALL")
def b14_rank(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes().groupBy("label", scan.rank().alias("rank")).agg(F.count("*").alias("n"))


@query(f"{_N} SELECT id FROM nodes WHERE label = 'Function' AND complexity = 7")
def b15_parameter(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT id FROM {nodes} WHERE label = :label AND complexity = :complexity", args={"label": "Function", "complexity": 7}, nodes=Star(spark, sf).nodes("Function"))


@query("WITH s AS (SELECT DISTINCT symbol FROM code_symbols WHERE symbol IS NOT NULL), p AS (SELECT symbol, string_split(symbol, ' ') AS a FROM s) SELECT symbol, a[3] AS third FROM p")
def b17_split_index(spark: SparkSession, sf: str) -> DataFrame:
    """An intermediate projection (B16), then one part of a split; null where there are fewer."""
    parts = table(spark, sf, "code_symbols").filter("symbol is not null").select("symbol").distinct().withColumn("parts", F.split("symbol", " "))
    return parts.select("symbol", F.try_element_at("parts", F.lit(3)).alias("third"))


@query(f"{_N} SELECT id, coalesce(file_path, '') AS file_path, coalesce(start_line, 0) AS start_line FROM nodes WHERE label IN ('Function', 'Method')")
def b18_coerced(spark: SparkSession, sf: str) -> DataFrame:
    return scan.coerced(Star(spark, sf).nodes("Function", "Method").select("id", "file_path", "start_line"), ("file_path",), ("start_line",))


@query(f"{_N} SELECT id, CASE label WHEN 'File' THEN path WHEN 'Symbol' THEN symbol WHEN 'Document' THEN title ELSE name END AS shown_name, concat_ws(';', file_path, signature) AS details FROM nodes WHERE label IN ('File', 'Symbol', 'Document', 'Function')")
def b20_shown(spark: SparkSession, sf: str) -> DataFrame:
    return scan.shown(Star(spark, sf).nodes("File", "Symbol", "Document", "Function")).select("id", "shown_name", F.array_join("details", ";").alias("details"))


@query(f"{_G} SELECT a.name AS service, b.path FROM nodes a JOIN edges ON src = a.id AND type = 'CONTAINS' JOIN nodes b ON dst = b.id AND b.label = 'File' WHERE a.label = 'Service'")
def c1_expand_out(spark: SparkSession, sf: str) -> DataFrame:
    s = Star(spark, sf)
    hop = pattern.expand(s.nodes("Service").select("id", F.col("name").alias("service")), s.edge_part("CONTAINS", 0), "id", "far")
    return pattern.attach(hop, s.nodes("File"), "far", {"path": "path"}).select("service", "path")


@query(f"{_G} SELECT b.id AS symbol_id, count(*) AS n FROM nodes b JOIN edges ON dst = b.id AND type = 'REFERENCES' WHERE b.label = 'Symbol' GROUP BY b.id")
def c2_expand_in(spark: SparkSession, sf: str) -> DataFrame:
    s = Star(spark, sf)
    hop = pattern.expand(s.nodes("Symbol").select(F.col("id").alias("symbol_id")), s.edges("REFERENCES"), "symbol_id", "ref", "in")
    return hop.groupBy("symbol_id").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) SELECT 'mth:' || l_orderkey AS method, 'scip-go go ' || p_brand || ' v' || p_size || ' ' || p_type || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '().' AS symbol FROM c JOIN part ON p_partkey = l_partkey")
def c3_chain(spark: SparkSession, sf: str) -> DataFrame:
    s = Star(spark, sf)
    one = pattern.expand(s.nodes("Method").select(F.col("id").alias("method")), s.edge_part("CALLS", 0), "method", "fn")
    two = pattern.expand(one, s.edges("DEFINES"), "fn", "sym")
    return pattern.attach(two, s.nodes("Symbol"), "sym", {"symbol": "symbol"}).select("method", "symbol")


@query(f"{_G} SELECT id FROM nodes n WHERE label = 'Function' AND NOT EXISTS (SELECT 1 FROM edges WHERE src = n.id AND type = 'EXPOSES_API')")
def c7_without_route(spark: SparkSession, sf: str) -> DataFrame:
    s = Star(spark, sf)
    return pattern.without(s.nodes("Function").select("id"), s.edges("EXPOSES_API"), "id", s.nodes("APIRoute"))


@query("SELECT id FROM (SELECT DISTINCT id FROM code_functions WHERE id IS NOT NULL) f WHERE NOT EXISTS (SELECT 1 FROM defines_rel d JOIN code_symbols s ON s.id = d.end_id WHERE d.start_id = f.id)")
def c7_functions_without_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that define no symbol there is; the far label is tested inside the anti side."""
    edges = table(spark, sf, "defines_rel").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"))
    return pattern.without(table(spark, sf, "code_functions").filter("id is not null").select("id").distinct(), edges, "id", table(spark, sf, "code_symbols").select("id"))


@query(f"{_G}, p AS (SELECT e.src, r.path, r.method FROM edges e JOIN (SELECT id, path, 1 AS method FROM nodes WHERE label = 'APIRoute') r ON r.id = e.dst WHERE e.type = 'EXPOSES_API') SELECT n.id, p.path FROM nodes n LEFT JOIN p ON p.src = n.id WHERE n.label = 'Function'")
def c8_optional(spark: SparkSession, sf: str) -> DataFrame:
    """OPTIONAL: the pattern is joined first, then matches as a whole or is null."""
    s = Star(spark, sf)
    routes = pattern.attach(s.edges("EXPOSES_API").select(F.col("src").alias("id"), "dst"), s.nodes("APIRoute"), "dst", {"path": "path"}).select("id", "path")
    return pattern.optional(s.nodes("Function").select("id"), routes, "id")


@query("SELECT (SELECT count(DISTINCT r_regionkey) FROM region) AS services, (SELECT count(DISTINCT doc_type) FROM documents) AS doc_types, (SELECT count(*) FROM region) * (SELECT count(*) FROM documents) AS pairs")
def c9_product(spark: SparkSession, sf: str) -> DataFrame:
    """A product whose result is an aggregate: each side is aggregated first (C9, D7), so no pair is made."""
    left = table(spark, sf, "region").agg(F.count_distinct("r_regionkey").alias("services"), F.count("*").alias("_l"))
    right = table(spark, sf, "documents").agg(F.count_distinct("doc_type").alias("doc_types"), F.count("*").alias("_r"))
    return pattern.product_counts(left, right).select("services", "doc_types", (F.col("_l") * F.col("_r")).alias("pairs"))


@query("SELECT f.id AS function_id, s.path IS NOT NULL AS has_source FROM (SELECT DISTINCT id, file_path FROM code_functions WHERE id IS NOT NULL) f LEFT JOIN (SELECT DISTINCT path FROM code_sources) s ON s.path = f.file_path")
def c11_path_join(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "code_functions").filter("id is not null").select(F.col("id").alias("function_id"), "file_path").distinct()
    s = table(spark, sf, "code_sources").select("path").distinct()
    return f.join(s, f.file_path == s.path, "left").select("function_id", F.col("path").isNotNull().alias("has_source"))


_NAMES12 = "names AS (SELECT id, min(symbol) AS text, min(display_name) AS alt FROM code_symbols WHERE id IS NOT NULL GROUP BY id)"
_TOKENS12 = "tokens AS (SELECT DISTINCT t AS token FROM (SELECT unnest(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*(?:\\(\\))?)`', 1)) AS t FROM documents) WHERE regexp_matches(t, '[A-Z_]') AND lower(t) NOT IN ({}))"


def _common() -> str:
    from symloom.functions.text import COMMON_WORDS

    return ", ".join(f"'{w}'" for w in COMMON_WORDS)


@query(f"WITH {_NAMES12}, {_TOKENS12.format(_common())}, h AS (SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY text NULLS LAST, id) AS k FROM tokens JOIN names ON contains(text, token) OR contains(alt, token)) SELECT token, id FROM h WHERE k <= 5")
def c12_token_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Code tokens of all documents joined to the symbols that contain them, the first five for each."""
    from symloom.functions import text

    tokens = table(spark, sf, "documents").filter("text is not null").select(F.explode(text.code_tokens(F.col("text"))).alias("token"))
    names = table(spark, sf, "code_symbols").filter("id is not null").groupBy("id").agg(F.min("symbol").alias("text"), F.min("display_name").alias("alt"))
    return pattern.mentions(tokens, names, 5).select("token", "id")


# ------------------------------------------------------------------------------------ aggregates (D), order (F)


@query(f"{_N} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def d2_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by the label array."""
    return Star(spark, sf).nodes().groupBy("labels").agg(F.count("*").alias("n")).select(F.element_at("labels", 1).alias("label"), "n")


@query(f"{_N} SELECT label, count(*) AS n FROM nodes GROUP BY label ORDER BY n DESC, label LIMIT 5")
def d3_top_labels(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes().groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(5)


@query(f"{_G} SELECT type, count(*) AS n FROM edges GROUP BY type ORDER BY n DESC, type LIMIT 5")
def d4_top_types(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).edges().groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type").limit(5)


@query("SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT title) AS titles, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT doc_type) FILTER (WHERE doc_type IS NOT NULL)), ',') AS types FROM documents")
def d5_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("title").alias("titles"), F.count_distinct("source").alias("sources"), F.array_join(F.sort_array(F.collect_set("doc_type")), ",").alias("types"))


@query(f"{_G} SELECT s.name AS service, count(e.dst) AS files FROM nodes s LEFT JOIN edges e ON e.src = s.id AND e.type = 'CONTAINS' WHERE s.label = 'Service' GROUP BY s.name")
def d6_optional_count(spark: SparkSession, sf: str) -> DataFrame:
    s = Star(spark, sf)
    files = s.edge_part("CONTAINS", 0).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_n"))
    return s.nodes("Service").join(files, "id", "left").select(F.col("name").alias("service"), F.coalesce("_n", F.lit(0)).alias("files"))


@query(f"{_N} SELECT count(DISTINCT label) AS labels, count(*) AS nodes FROM nodes")
def d8_health(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes().agg(F.count_distinct(F.element_at("labels", 1)).alias("labels"), F.count("*").alias("nodes"))


@query(f"{_G} SELECT DISTINCT n.method FROM (SELECT CASE WHEN length(p_type) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM part WHERE p_size < 5) n")
def d9_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return Star(spark, sf).nodes("APIRoute").select("method").distinct()


@query(f"{_N} SELECT id, name, label, {_RANK} AS rank FROM nodes WHERE label IN ('Function', 'Symbol', 'Class') AND {_MATCH.format(t='wid')} ORDER BY rank, name NULLS LAST, id LIMIT 50")
def f3_ranked_top(spark: SparkSession, sf: str) -> DataFrame:
    """Top 50 by rank, then name with nulls last, then id."""
    return scan.search(Star(spark, sf).nodes("Function", "Symbol", "Class"), "wid", (), 50).select("id", "name", "label", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5")
def f8_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(5).limit(10)


# ------------------------------------------------------------------------------------ writes (S, K)

_BATCH = "b AS (SELECT p_partkey + 1000 AS k, o AS o, has_name, has_size, name, size FROM (SELECT p_partkey, 1 AS o, true AS has_name, p_size % 3 = 0 AS has_size, 'new ' || p_name AS name, p_size + 1 AS size FROM part UNION ALL SELECT p_partkey, 2, p_size % 2 = 0, true, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'newer ' || p_name END, p_size + 2 FROM part WHERE p_partkey % 5 = 0))"
_LAST = "l AS (SELECT k, arg_max_null(name, o) FILTER (WHERE has_name) AS name, coalesce(bool_or(has_name), false) AS hn, arg_max_null(size, o) FILTER (WHERE has_size) AS size, coalesce(bool_or(has_size), false) AS hs FROM b GROUP BY k)"


def _merge_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size"))
    key = (F.col("p_partkey") + 1000).alias("k")
    first = part.select(key, F.lit(1).alias("o"), F.lit(True).alias("has_name"), (F.col("p_size") % 3 == 0).alias("has_size"), F.concat(F.lit("new "), "p_name").alias("name"), (F.col("p_size") + 1).cast("int").alias("size"))
    second = part.filter("p_partkey % 5 = 0").select(key, F.lit(2).alias("o"), (F.col("p_size") % 2 == 0).alias("has_name"), F.lit(True).alias("has_size"), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("newer "), "p_name")).alias("name"), (F.col("p_size") + 2).cast("int").alias("size"))
    return nodes, first.unionByName(second)


@query(f"WITH {_BATCH}, {_LAST} SELECT coalesce(p_partkey, k) AS k, CASE WHEN hn THEN l.name ELSE p_name END AS name, CASE WHEN hs THEN l.size ELSE p_size END::INTEGER AS size FROM part FULL JOIN l ON p_partkey = k")
def s2_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed upsert: last mention wins per property, null removes, what is not mentioned survives."""
    nodes, batch = _merge_inputs(spark, sf)
    return upsert.merge(nodes, batch, ["k"], "o", ["name", "size"])


@query(f"WITH {_BATCH}, {_LAST} SELECT coalesce(p_partkey, k) AS k, CASE WHEN p_partkey IS NULL AND hn THEN l.name ELSE p_name END AS name, CASE WHEN p_partkey IS NULL AND hs THEN l.size ELSE p_size END::INTEGER AS size FROM part FULL JOIN l ON p_partkey = k")
def s5_merge_on_create(spark: SparkSession, sf: str) -> DataFrame:
    nodes, batch = _merge_inputs(spark, sf)
    return upsert.merge(nodes, batch, ["k"], "o", ["name", "size"], on_create_only=True)


@query(f"WITH {_BATCH}, r AS (SELECT k, arg_max_null(name, o) AS name, arg_max_null(size, o) AS size FROM (SELECT k, o, CASE WHEN has_name THEN name END AS name, CASE WHEN has_size THEN size END AS size FROM b) GROUP BY k) SELECT coalesce(p_partkey, k) AS k, CASE WHEN k IS NULL THEN p_name ELSE r.name END AS name, CASE WHEN k IS NULL THEN p_size ELSE r.size END::INTEGER AS size FROM part FULL JOIN r ON p_partkey = k")
def k3_replace(spark: SparkSession, sf: str) -> DataFrame:
    """SET n = m: the batch's last row replaces all properties, what it does not mention is gone (K3)."""
    nodes, batch = _merge_inputs(spark, sf)
    return upsert.replace(nodes, batch, ["k"], "o", ["name", "size"])


@query(f"WITH {_BATCH}, {_LAST}, n AS (SELECT 1001 + p_partkey % 50 AS k, p_name AS name, p_size AS size FROM part) SELECT coalesce(n.k, l.k) AS k, CASE WHEN hn THEN l.name ELSE n.name END AS name, CASE WHEN hs THEN l.size ELSE n.size END::INTEGER AS size FROM n FULL JOIN l ON n.k = l.k")
def k1_merge_all_matches(spark: SparkSession, sf: str) -> DataFrame:
    """A merge key that several nodes share: all of them are updated (K1)."""
    nodes, batch = _merge_inputs(spark, sf)
    shared = nodes.select((F.col("k") % 50 + 1001).alias("k"), "name", "size")
    return upsert.merge(shared, batch, ["k"], "o", ["name", "size"])


@query("SELECT sha256('File' || '|' || path) AS id, path FROM (SELECT DISTINCT path FROM code_sources WHERE path IS NOT NULL)")
def s4_create_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with deterministic ids, the hash of label and key."""
    return table(spark, sf, "code_sources").filter("path is not null").select("path").distinct().select(F.sha2(F.concat(F.lit("File|"), "path"), 256).alias("id"), "path")


_DEF = "e AS (SELECT id, start_id AS src, end_id AS dst FROM (" + newest_sql("defines_rel", ("start_id", "end_id"), "created_at") + ")), n AS (SELECT id FROM code_functions UNION SELECT id FROM code_symbols)"


def _edge_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = one_per_key(table(spark, sf, "defines_rel"), ["id"], ["start_id", "end_id"], "created_at").withColumnsRenamed({"start_id": "src", "end_id": "dst"})
    n = table(spark, sf, "code_functions").select("id").unionByName(table(spark, sf, "code_symbols").select("id")).distinct()
    return e, n


@query(f"WITH {_DEF} SELECT id, src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def s6_create_edges(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.create_edges(*_edge_inputs(spark, sf))[0].select("id", "src", "dst")


@query(f"WITH {_DEF} SELECT id, src, dst FROM e WHERE NOT (src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))")
def s3_dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.create_edges(*_edge_inputs(spark, sf))[1].select("id", "src", "dst")


@query(f"WITH {_DEF} SELECT id FROM e WHERE src NOT IN (SELECT id FROM code_functions WHERE is_exported) AND dst NOT IN (SELECT id FROM code_functions WHERE is_exported)")
def s7_detach_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of DEFINES when all exported functions are deleted with their edges."""
    e, n = _edge_inputs(spark, sf)
    gone = table(spark, sf, "code_functions").filter("is_exported").select("id")
    return upsert.detach_delete(n, e, gone)[1].select("id")


@query("SELECT start_id AS src, end_id AS dst, count(*) AS n, count(DISTINCT id) AS n_ids FROM defines_rel WHERE start_id IS NOT NULL AND end_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def k4_repeated_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links written more than once by repeated indexing."""
    return table(spark, sf, "defines_rel").filter("start_id is not null and end_id is not null").groupBy(F.col("start_id").alias("src"), F.col("end_id").alias("dst")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")).filter("n > 1")


@query(f"{_N} SELECT label, 'symbol' AS key_name, symbol AS key_value, count(*) AS n FROM nodes WHERE label = 'Symbol' AND symbol IS NOT NULL GROUP BY label, symbol HAVING count(*) > 1 UNION ALL SELECT label, 'name', name, count(*) FROM nodes WHERE label = 'Function' AND name IS NOT NULL GROUP BY label, name HAVING count(*) > 1")
def k6_unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    nodes = Star(spark, sf).nodes("Symbol", "Function")
    return model.violations(nodes, "Symbol", "symbol").unionByName(model.violations(nodes, "Function", "name"))


@query("SELECT * FROM (VALUES ('file_path_unique', 'UNIQUE', 'File'), ('symbol_kind_idx', 'BTREE', 'Symbol')) v(name, kind, label)")
def k7_schema_validate(spark: SparkSession, sf: str) -> DataFrame:
    """What a catalog lacks after two of its entries were dropped; it is stored, and read again by another object."""
    base = f"{shared_dir(spark)}/symloom-catalog-{uuid.uuid4().hex[:12]}"
    one = model.Catalog(spark, base)
    one.create_all()
    one.drop("file_path_unique")
    one.drop("symbol_kind_idx")
    return model.Catalog(spark, base).missing()


_JSON = "list_filter([CASE WHEN title IS NOT NULL THEN '  \"title\" : ' || to_json(title) END, CASE WHEN doc_type IS NOT NULL THEN '  \"doc_type\" : ' || to_json(doc_type) END, CASE WHEN source_url IS NOT NULL THEN '  \"source_url\" : ' || to_json(source_url) END, '  \"meta\" : {' || CASE WHEN lang IS NULL AND n_chars IS NULL THEN ' }' ELSE chr(10) || array_to_string(list_filter([CASE WHEN lang IS NOT NULL THEN '    \"lang\" : ' || to_json(lang) END, CASE WHEN n_chars IS NOT NULL THEN '    \"n_chars\" : ' || n_chars END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '  }' END], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, '{{' || chr(10) || array_to_string({_JSON}, ',' || chr(10)) || chr(10) || '}}' AS json FROM documents")
def s8_json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as indented JSON, one text per document."""
    row = F.struct("title", "doc_type", "source_url", F.struct("lang", "n_chars").alias("meta"))
    return table(spark, sf, "documents").select("doc_id", F.to_json(row, {"pretty": "true"}).alias("json"))

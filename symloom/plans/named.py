"""Named queries: definitions, references, implementations, impact, data flow, dependencies, search, source (L, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import source
from symloom.operators import pattern, scan, traverse
from symloom.plans.base import Registry
from symloom.plans.star import EDGES_SQL, NODES_SQL, Star
from symloom.tables import newest_sql, one_per_key, table

query = Registry()
_G = f"WITH {NODES_SQL}, {EDGES_SQL} "
_R = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL} "
_N = f"WITH {NODES_SQL} "


# ------------------------------------------------------------------ code tables as graph: whole-table forms


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["name", "signature", "file_path", "start_line", "end_line", "start_byte", "end_byte", "labels", "docstring", "lines_of_code", "is_exported"]
    return one_per_key(table(spark, sf, "code_functions"), ["id"], columns, "updated_at")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    return one_per_key(table(spark, sf, "references_rel"), ["id"], ["start_id", "end_id", "line_no", "is_definition"], "ingested_at")


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["symbol", "kind", "display_name"]
    return one_per_key(table(spark, sf, "code_symbols").select("id", *columns, "created_at"), ["id"], columns, "created_at")


_F = "f AS (SELECT * RENAME (lines_of_code AS loc) FROM (" + newest_sql("code_functions", ("name", "signature", "file_path", "start_line", "end_line", "start_byte", "end_byte", "labels", "docstring", "lines_of_code", "is_exported"), "updated_at") + "))"
_REF = "r AS (" + newest_sql("references_rel", ("start_id", "end_id", "line_no", "is_definition"), "ingested_at") + ")"
_S = "s AS (" + newest_sql("code_symbols", ("symbol", "kind", "display_name"), "created_at") + ")"
_D = "d AS (SELECT DISTINCT start_id, end_id FROM defines_rel WHERE start_id IS NOT NULL AND end_id IS NOT NULL)"


@query(f"WITH {_F}, {_S}, {_D}, h AS (SELECT s.id AS symbol_id, f.id AS function_id, f.file_path, f.start_line, list_last(f.labels) AS kind, row_number() OVER (PARTITION BY s.id ORDER BY f.file_path NULLS LAST, f.start_line NULLS LAST, f.id) AS k FROM s JOIN d ON d.end_id = s.id JOIN f ON f.id = d.start_id) SELECT symbol_id, function_id, file_path, start_line, kind FROM h WHERE k = 1")
def l1_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Go to definition, for every symbol at once: its first definition by file, line and id."""
    links = table(spark, sf, "defines_rel").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst")).distinct()
    hop = pattern.expand(_symbols(spark, sf).select(F.col("id").alias("symbol_id")), links, "symbol_id", "function_id", "in")
    placed = pattern.attach(hop, _functions(spark, sf), "function_id", {"file_path": "file_path", "start_line": "start_line", "kind": F.element_at("labels", -1)})
    order = F.struct(F.col("file_path").isNull(), "file_path", F.col("start_line").isNull(), "start_line", "function_id")
    best = placed.groupBy("symbol_id").agg(F.min_by(F.struct("function_id", "file_path", "start_line", "kind"), order).alias("b"))
    return best.select("symbol_id", "b.*")


@query(f"WITH {_F}, {_REF} SELECT r.end_id AS symbol_id, f.file_path, r.line_no, count(*) AS n FROM r JOIN f ON f.id = r.start_id WHERE r.end_id IS NOT NULL GROUP BY ALL")
def l2_references(spark: SparkSession, sf: str) -> DataFrame:
    """Find references, for every symbol at once: file and line of each usage with its multiplicity.

    The usage's function is joined for its file first (functions are unique by id and no key is hot);
    the hot symbols are only aggregated.
    """
    r = _references(spark, sf).filter("end_id is not null and start_id is not null")
    placed = r.join(_functions(spark, sf).select(F.col("id").alias("start_id"), "file_path"), "start_id")
    return placed.groupBy(F.col("end_id").alias("symbol_id"), "file_path", "line_no").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, {_REF} SELECT r.end_id AS symbol_id, f.file_path, r.line_no, count(*) AS n FROM r JOIN f ON f.id = r.start_id WHERE r.end_id IS NOT NULL GROUP BY ALL ORDER BY symbol_id, file_path NULLS LAST, line_no NULLS LAST")
def f1_ordered_references(spark: SparkSession, sf: str) -> DataFrame:
    """The same in order of symbol, file and line, nulls last: a range sort, in which a hot symbol is many ranges (F1)."""
    return l2_references(spark, sf).orderBy("symbol_id", F.col("file_path").asc_nulls_last(), F.col("line_no").asc_nulls_last())


@query(f"{_G} SELECT s.id AS symbol_id, i.id AS class_id FROM nodes s JOIN edges d ON d.dst = s.id AND d.type = 'DEFINES' JOIN edges x ON x.type = 'EXPOSES_API' AND x.src = d.src JOIN nodes i ON i.id = x.dst WHERE s.label = 'Symbol'")
def l3_chain_through_definition(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol to definer to what that exposes: the three-node pattern of 'find implementations'."""
    s = Star(spark, sf)
    one = pattern.expand(s.nodes("Symbol").select(F.col("id").alias("symbol_id")), s.edges("DEFINES"), "symbol_id", "fn", "in")
    two = pattern.expand(one, s.edges("EXPOSES_API"), "fn", "class_id")
    return two.join(s.nodes("APIRoute").select(F.col("id").alias("class_id")), "class_id", "left_semi").select("symbol_id", "class_id")


@query(f"{_G} SELECT i.name AS interface, count(*) AS implementations FROM nodes i JOIN edges e ON e.dst = i.id AND e.type = 'IMPLEMENTS' JOIN nodes c ON c.id = e.src AND c.label = 'Class' WHERE i.label = 'Interface' GROUP BY i.name")
def l3_implementations(spark: SparkSession, sf: str) -> DataFrame:
    s = Star(spark, sf)
    hop = pattern.expand(s.nodes("Interface").select("id", F.col("name").alias("interface")), s.edges("IMPLEMENTS"), "id", "cls", "in")
    own = hop.join(s.nodes("Class").select(F.col("id").alias("cls")), "cls", "left_semi")
    return own.groupBy("interface").agg(F.count("*").alias("implementations"))


#: The function from which calls are followed.
ROOT = "fn:1"
_REACH = f"calls AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'CALLS' AND src LIKE 'fn:%'), walk AS (SELECT dst AS node, 1 AS depth FROM calls WHERE src = '{ROOT}' UNION SELECT c.dst, depth + 1 FROM walk JOIN calls c ON c.src = walk.node WHERE depth < 10), least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"


def _reach(spark: SparkSession, sf: str, direction: str = "out") -> tuple[Star, DataFrame]:
    s = Star(spark, sf)
    seed = spark.createDataFrame([(ROOT,)], "seed string")
    return s, traverse.reachable(s.edge_part("CALLS", 1), seed, 1, 10, direction)


@query(f"{_R}, {_REACH} SELECT node, depth FROM least")
def e1_reachable(spark: SparkSession, sf: str) -> DataFrame:
    """Functions within ten calls of one, with their least depth."""
    return _reach(spark, sf)[1].select("node", "depth")


_MANY = "calls AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'CALLS' AND src LIKE 'fn:%'), walk AS (SELECT 'fn:' || p_partkey AS seed, dst AS node, 1 AS depth FROM part JOIN calls ON src = 'fn:' || p_partkey WHERE p_partkey % 20 = 0 UNION SELECT seed, c.dst, depth + 1 FROM walk JOIN calls c ON c.src = walk.node WHERE depth < 4)"


@query(f"{_R}, {_MANY} SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node")
def e1_reachable_many(spark: SparkSession, sf: str) -> DataFrame:
    """The same for many starts at once, every function whose key is divisible by 20, four calls deep."""
    s = Star(spark, sf)
    seeds = s.t("part").filter("p_partkey % 20 = 0").select(F.concat(F.lit("fn:"), F.col("p_partkey").cast("string")).alias("seed"))
    return traverse.reachable(s.edge_part("CALLS", 1), seeds, 1, 4)


@query(f"{_R}, {_MANY}, far AS (SELECT DISTINCT seed, node FROM walk) SELECT seed, count(DISTINCT node) AS functions, count(DISTINCT x.dst) AS routes FROM far LEFT JOIN edges x ON x.src = far.node AND x.type = 'EXPOSES_API' GROUP BY seed")
def l4_impact_many(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions and API routes each of those starts touches; mergeable counts, distinct pairs first."""
    far = e1_reachable_many(spark, sf).select("seed", "node")
    routes = pattern.expand(far, Star(spark, sf).edges("EXPOSES_API"), "node", "route").select("seed", "route").distinct().groupBy("seed").agg(F.count("*").alias("routes"))
    return far.groupBy("seed").agg(F.count("*").alias("functions")).join(routes, "seed", "left").select("seed", "functions", F.coalesce("routes", F.lit(0)).alias("routes"))


@query(f"{_R}, {_REACH} SELECT DISTINCT r.path FROM least JOIN edges x ON x.src = least.node AND x.type = 'EXPOSES_API' JOIN nodes r ON r.id = x.dst")
def l4_impact(spark: SparkSession, sf: str) -> DataFrame:
    """API routes that functions within ten calls expose."""
    s, near = _reach(spark, sf)
    routes = pattern.expand(near.select("node"), s.edges("EXPOSES_API"), "node", "route").select("route").distinct()
    return pattern.attach(routes, s.nodes("APIRoute"), "route", {"path": "path"}).select("path").distinct()


@query(f"{_R}, {_REACH} SELECT max(depth) AS max_depth, count(*) AS functions FROM least")
def l17_affected(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions a change may touch, and how far off."""
    return _reach(spark, sf)[1].agg(F.max("depth").alias("max_depth"), F.count("*").alias("functions"))


_BOTH = f"""calls AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'CALLS' AND src LIKE 'fn:%'),
down AS (SELECT dst AS node, 1 AS depth FROM calls WHERE src = '{ROOT}' UNION SELECT c.dst, depth + 1 FROM down JOIN calls c ON c.src = down.node WHERE depth < 4),
up AS (SELECT src AS node, 1 AS depth FROM calls WHERE dst = '{ROOT}' UNION SELECT c.src, depth + 1 FROM up JOIN calls c ON c.dst = up.node WHERE depth < 4)"""


@query(f"{_R}, {_BOTH} SELECT 'outgoing' AS direction, node, min(depth) AS depth FROM down GROUP BY node UNION ALL SELECT 'incoming', node, min(depth) FROM up GROUP BY node")
def l15_call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of the call graph around a function, four calls deep."""
    calls = Star(spark, sf).edge_part("CALLS", 1)
    seed = spark.createDataFrame([(ROOT,)], "seed string")
    down = traverse.reachable(calls, seed, 1, 4).select(F.lit("outgoing").alias("direction"), "node", "depth")
    return down.unionByName(traverse.reachable(calls, seed, 1, 4, "in").select(F.lit("incoming").alias("direction"), "node", "depth"))


_SUB = f"{_BOTH}, near AS (SELECT node, min(depth) AS depth FROM down GROUP BY node UNION ALL SELECT '{ROOT}', 0), sub AS (SELECT c.src, c.dst FROM calls c JOIN (SELECT node, min(depth) AS depth FROM near GROUP BY node) n ON n.node = c.src AND n.depth < 4), back AS (SELECT dst AS seed, dst AS node FROM sub UNION SELECT seed, sub.dst FROM back JOIN sub ON sub.src = back.node)"


@query(f"{_R}, {_SUB} SELECT src, dst, EXISTS (SELECT 1 FROM back WHERE back.seed = sub.dst AND back.node = sub.src) AS recursive FROM sub")
def l15_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of the graph four deep below a function; recursive are those from whose target the caller is reached again."""
    calls = Star(spark, sf).edge_part("CALLS", 1).select("src", "dst").distinct()
    return traverse.call_edges(calls, spark.createDataFrame([(ROOT,)], "seed string"), 4).select("src", "dst", "recursive")


_FLOW = "fl AS (SELECT src || '>' || dst AS id, src, dst FROM edges WHERE type = 'FLOWS_TO'), tr AS (SELECT dst AS node, [id] AS es, src || '>' || dst AS way, 1 AS depth FROM fl WHERE src = 'ev:5' UNION ALL SELECT fl.dst, list_append(es, fl.id), way || '>' || fl.dst, depth + 1 FROM tr JOIN fl ON fl.src = tr.node WHERE depth < 15 AND NOT list_contains(es, fl.id))"


def _flows(spark: SparkSession, sf: str) -> tuple[Star, DataFrame]:
    s = Star(spark, sf)
    return s, traverse.trails(s.edges("FLOWS_TO"), spark.createDataFrame([("ev:5",)], "seed string"), 1, 15)


@query(f"{_R}, {_FLOW} SELECT node, way, depth FROM tr")
def e2_trails(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge-unique walk of up to fifteen flows from one value."""
    return _flows(spark, sf)[1].select(F.element_at("node_ids", -1).alias("node"), F.array_join("node_ids", ">").alias("way"), "depth")


@query(f"{_R}, {_FLOW} SELECT m.name AS method, way FROM tr JOIN edges c ON c.dst = tr.node AND c.type = 'CONTAINS' JOIN nodes m ON m.id = c.src AND m.label = 'Method'")
def l5_data_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Where a value flows: methods that contain the parameter at a walk's end, with the walk."""
    s, walks = _flows(spark, sf)
    ends = walks.select(F.element_at("node_ids", -1).alias("node"), F.array_join("node_ids", ">").alias("way"))
    held = pattern.expand(ends, s.edge_part("CONTAINS", 4), "node", "m", "in")
    return pattern.attach(held, s.nodes("Method"), "m", {"method": "name"}).select("method", "way")


_TREE = "tree AS (SELECT 'svc:' || n_regionkey AS svc, 'mth:' || o_orderkey AS mth FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)"
_DEPS = "deps AS (SELECT DISTINCT v.name AS service, m.name AS caller, string_split(y.symbol, ' ')[3] AS foreign_service, y.symbol FROM nodes v JOIN tree ON tree.svc = v.id JOIN nodes m ON m.id = tree.mth JOIN edges c ON c.src = m.id AND c.type = 'CALLS' JOIN edges d ON d.src = c.dst AND d.type = 'DEFINES' JOIN nodes y ON y.id = d.dst WHERE contains(y.symbol, ' ') AND NOT contains(y.symbol, v.name))"


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """(service, caller, foreign_service, symbol), distinct, for every service at once."""
    s = Star(spark, sf)
    services = s.nodes("Service").select("id", F.col("name").alias("service"))
    files = pattern.expand(services, s.edge_part("CONTAINS", 0), "id", "file")
    classes = pattern.expand(files, s.edge_part("CONTAINS", 1), "file", "cls")
    methods = pattern.expand(classes, s.edge_part("CONTAINS", 2), "cls", "mth").select("service", "mth")
    calls = pattern.expand(methods, s.edge_part("CALLS", 0), "mth", "fn")
    defined = pattern.expand(calls, s.edges("DEFINES"), "fn", "sym").select("service", "mth", "sym")
    with_symbol = pattern.attach(defined, s.nodes("Symbol"), "sym", {"symbol": "symbol"})
    foreign = with_symbol.filter(F.contains("symbol", F.lit(" ")) & ~F.contains("symbol", "service"))
    named = pattern.attach(foreign, s.nodes("Method"), "mth", {"caller": "name"})
    return named.select("service", "caller", F.try_element_at(F.split("symbol", " "), F.lit(3)).alias("foreign_service"), "symbol").distinct()


@query(f"{_G}, {_TREE}, {_DEPS} SELECT service, caller, foreign_service, symbol FROM deps")
def l6_service_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return dependencies(spark, sf)


@query(f"{_G}, {_TREE}, {_DEPS} SELECT service, caller, foreign_service, symbol FROM deps ORDER BY service, foreign_service, caller, symbol")
def f2_ordered_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """In order of service, foreign service and caller (F2)."""
    return dependencies(spark, sf).orderBy("service", F.col("foreign_service").asc_nulls_last(), F.col("caller").asc_nulls_last(), "symbol")


@query(f"{_G}, {_TREE}, {_DEPS} SELECT service, foreign_service, caller, count(*) AS calls FROM deps GROUP BY ALL ORDER BY service, foreign_service, caller")
def d10_calling_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The list of callers behind each roll-up, as ordered rows: a list in one row would grow with the table."""
    per = dependencies(spark, sf).groupBy("service", "foreign_service", "caller").agg(F.count("*").alias("calls"))
    return per.orderBy("service", F.col("foreign_service").asc_nulls_last(), F.col("caller").asc_nulls_last())


@query(f"{_G}, {_TREE}, {_DEPS} SELECT service, foreign_service, count(*) AS call_count, count(DISTINCT caller) AS callers, 'direct' AS kind FROM deps GROUP BY service, foreign_service")
def l7_dependency_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and distinct callers per foreign service (D10); mergeable counts instead of lists of callers."""
    per = dependencies(spark, sf).groupBy("service", "foreign_service", "caller").agg(F.count("*").alias("_n"))
    return per.groupBy("service", "foreign_service").agg(F.sum("_n").alias("call_count"), F.count("*").alias("callers")).withColumn("kind", F.lit("direct"))


_RANK = "CASE WHEN label IN ('Function', 'Method') THEN 1 WHEN label IN ('Class', 'Interface') THEN 2 WHEN label IN ('Variable', 'Parameter') THEN 3 WHEN label IN ('File', 'Feature', 'Document') THEN 4 WHEN label = 'Symbol' THEN 5 ELSE 6 END"
_HIT = "(contains(lower(name), lower('{t}')) OR contains(lower(display_name), lower('{t}')) OR contains(lower(signature), lower('{t}')) OR contains(lower(symbol), lower('{t}')) OR contains(lower(path), lower('{t}')))"


@query(f"{_N} SELECT id, label, name, {_RANK} AS rank FROM nodes WHERE {_HIT.format(t='small')} ORDER BY rank, name NULLS LAST, id LIMIT 50")
def l8_search(spark: SparkSession, sf: str) -> DataFrame:
    return scan.search(Star(spark, sf).nodes(), "small", (), 50).select("id", "label", "name", "rank")


@query(f"{_N} SELECT coalesce(name, '') AS label_text, label AS kind, coalesce(signature, '') AS detail FROM (SELECT *, {_RANK} AS rank FROM nodes WHERE label IN ('Function', 'Method', 'Class', 'Variable') AND {_HIT.format(t='ring')} ORDER BY rank, name NULLS LAST, id LIMIT 20)")
def l9_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Completion items: a search over four labels, at most 20."""
    labels = ("Function", "Method", "Class", "Variable")
    hit = scan.search(Star(spark, sf).nodes("Function", "Method", "Class", "Variable"), "ring", labels, 20)
    return scan.coerced(hit.select(F.col("name").alias("label_text"), F.col("label").alias("kind"), F.col("signature").alias("detail")), ("label_text", "detail"))


@query(
    f"""WITH {_F}, src AS (SELECT path, max(content) AS content FROM code_sources WHERE path IS NOT NULL GROUP BY path)
SELECT f.id AS function_id, octet_length(content) AS file_size, CASE WHEN start_byte >= 0 AND start_byte <= end_byte AND end_byte <= octet_length(content) THEN sha256(array_slice(content, start_byte::BIGINT + 1, end_byte::BIGINT)) END AS code_hash
FROM f JOIN src ON src.path = f.file_path"""
)
def l10_source_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Exact byte slices of all functions, as hashes (N8 over the whole set)."""
    one = table(spark, sf, "code_sources").filter("path is not null").groupBy("path").agg(F.max("content").alias("content"))
    f = _functions(spark, sf).withColumnRenamed("id", "function_id")
    inside = (F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.octet_length("content"))
    piece = F.substring(F.col("content"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return f.join(one, f.file_path == one.path).select("function_id", F.octet_length("content").cast("long").alias("file_size"), F.when(inside, F.sha2(piece, 256)).alias("code_hash"))


_CODE = f"""{_F}, src AS (SELECT path, max(content) AS content FROM code_sources WHERE path IS NOT NULL GROUP BY path),
cut AS (SELECT f.id AS function_id, name, signature, try(decode(content)) AS body, CASE WHEN start_byte >= 0 AND start_byte <= end_byte AND end_byte <= octet_length(content) THEN try(decode(array_slice(content, start_byte::BIGINT + 1, end_byte::BIGINT))) END AS own, start_line, end_line FROM f JOIN src ON src.path = f.file_path),
code AS (SELECT function_id, name, signature, coalesce(own, CASE WHEN start_line >= 1 AND start_line <= end_line AND start_line <= len(string_split(body, chr(10))) THEN array_to_string(string_split(body, chr(10))[start_line:end_line], chr(10)) END) AS code FROM cut)"""


@query(f"WITH {_CODE} SELECT function_id, signature, code FROM code WHERE code IS NOT NULL")
def l10_source_code(spark: SparkSession, sf: str) -> DataFrame:
    """Source of every function, bytes first, lines where the offsets are missing or past the end."""
    return source.sliced(_functions(spark, sf), table(spark, sf, "code_sources")).filter("code is not null").select(F.col("id").alias("function_id"), "signature", "code")


@query(f"WITH {_CODE} SELECT signature, min(function_id) AS function_id, arg_min(code, function_id) AS code FROM code WHERE code IS NOT NULL AND signature IS NOT NULL GROUP BY signature")
def l10_source_by_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Source by signature, for every signature at once: of several functions the one with the least id."""
    f = _functions(spark, sf).filter("signature is not null")
    code = source.sliced(f, table(spark, sf, "code_sources")).filter("code is not null").select("id", "signature", "code")
    return code.groupBy("signature").agg(F.min_by(F.struct(F.col("id").alias("function_id"), "code"), "id").alias("b")).select("signature", "b.*")


_C = "calls AS (SELECT src, dst FROM edges WHERE type = 'CALLS')"


@query(f"{_G}, {_C} SELECT n.id, n.signature, (SELECT count(*) FROM calls WHERE dst = n.id) AS callers, (SELECT count(*) FROM calls WHERE src = n.id) AS callees FROM nodes n WHERE n.label = 'Function'")
def l11_function_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Signature, number of callers and of callees of every function, each side aggregated before the join."""
    s = Star(spark, sf)
    calls = s.edges("CALLS").select("src", "dst")
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_in"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_out"))
    both = s.nodes("Function").select("id", "signature").join(into, "id", "left").join(out, "id", "left")
    return both.select("id", "signature", F.coalesce("_in", F.lit(0)).alias("callers"), F.coalesce("_out", F.lit(0)).alias("callees"))


@query(f"{_G}, {_C}, h AS (SELECT dst AS id, n.name AS caller, n.id AS caller_id, row_number() OVER (PARTITION BY dst ORDER BY n.name NULLS LAST, n.id) AS k FROM calls JOIN nodes n ON n.id = calls.src) SELECT id, caller, caller_id FROM h WHERE k <= 10")
def l11_callers(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten callers of every function, functions and methods, by name and id (a top-k per group: rank limits
    are pushed into the sort)."""
    s = Star(spark, sf)
    hop = pattern.attach(s.edges("CALLS").select(F.col("dst").alias("id"), F.col("src").alias("caller_id")), s.nodes("Function", "Method"), "caller_id", {"caller": "name"})
    return pattern.first_of(hop, "id", [F.col("caller").asc_nulls_last(), "caller_id"], 10).select("id", "caller", "caller_id")


@query(f"{_G}, {_C}, h AS (SELECT src AS id, n.name AS callee, n.id AS callee_id, row_number() OVER (PARTITION BY src ORDER BY n.name NULLS LAST, n.id) AS k FROM calls JOIN nodes n ON n.id = calls.dst) SELECT id, callee, callee_id FROM h WHERE k <= 10")
def l11_callees(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten callees of every function and method, by name and id."""
    s = Star(spark, sf)
    hop = pattern.attach(s.edges("CALLS").select(F.col("src").alias("id"), F.col("dst").alias("callee_id")), s.nodes("Function"), "callee_id", {"callee": "name"})
    return pattern.first_of(hop, "id", [F.col("callee").asc_nulls_last(), "callee_id"], 10).select("id", "callee", "callee_id")


@query("SELECT coalesce(doc_type, '') AS doc_type, count(*) AS documents, count(DISTINCT title) AS titles, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents GROUP BY ALL")
def l12_document_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type")).agg(F.count("*").alias("documents"), F.count_distinct("title").alias("titles"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query(f"{_N} SELECT count(*) AS functions, round(avg(complexity), 6) AS average, max(complexity) AS most, count(*) FILTER (WHERE complexity > 10) AS high FROM nodes WHERE label = 'Function'")
def l14_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of complexities; high means over 10."""
    return Star(spark, sf).nodes("Function").agg(F.count("*").alias("functions"), F.round(F.avg("complexity"), 6).alias("average"), F.max("complexity").alias("most"), F.count_if(F.col("complexity") > 10).alias("high"))


@query(f"WITH {_F}, {_REF}, h AS (SELECT r.id AS reference_id, g.id AS function_id, row_number() OVER (PARTITION BY r.id ORDER BY g.end_line - g.start_line, g.id) AS k FROM r JOIN f ON f.id = r.start_id JOIN f g ON g.file_path = f.file_path AND g.start_line <= r.line_no AND r.line_no <= g.end_line) SELECT reference_id, function_id FROM h WHERE k = 1")
def l16_hover(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost function around each place (file and line), here those of all references.

    A range join by file and block of 64 lines: a function is listed under every block it covers, so both
    sides meet by equality and a file with very many functions is spread over its blocks.
    """
    block = 64
    all_functions = _functions(spark, sf)
    f = all_functions.filter("file_path is not null and start_line is not null and end_line >= start_line").select("file_path", F.col("id").alias("function_id"), "start_line", "end_line")
    files = all_functions.filter("file_path is not null").select(F.col("id").alias("start_id"), "file_path")
    places = _references(spark, sf).filter("line_no is not null").select(F.col("id").alias("reference_id"), "start_id", F.col("line_no").alias("_line")).join(files, "start_id")
    # A wrong end line must not list a function under blocks that no place of its file is in.
    reach = places.groupBy("file_path").agg(F.min("_line").alias("_low"), F.max("_line").alias("_high"))
    first, last = F.greatest("start_line", "_low"), F.least("end_line", "_high")
    spread = f.join(reach, "file_path").filter(first <= last).withColumn("_block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block)))).drop("_low", "_high")
    hit = places.withColumn("_block", F.floor(F.col("_line") / block)).join(spread, ["file_path", "_block"]).filter("start_line <= _line and _line <= end_line")
    return hit.groupBy("reference_id").agg(F.min_by("function_id", F.struct(F.col("end_line") - F.col("start_line"), "function_id")).alias("function_id"))


# ------------------------------------------------------------------ containment and documented queries (C4, N)


@query("WITH RECURSIVE l AS (SELECT DISTINCT start_id, end_id FROM contains_rel WHERE start_id IS NOT NULL AND end_id IS NOT NULL), t AS (SELECT start_id AS svc, end_id AS node, 1 AS d FROM l WHERE start_id LIKE 'svc:%' UNION ALL SELECT svc, l.end_id, d + 1 FROM t JOIN l ON l.start_id = t.node WHERE d < 200) SELECT svc AS service, node AS function_id FROM t WHERE node LIKE 'fn:%'")
def n3_service_functions(spark: SparkSession, sf: str) -> DataFrame:
    """All functions below every service over containment of any depth (C4): from the resolved hierarchy, as a
    node of a tree lies below exactly the services on its path."""
    from symloom.operators import hierarchy

    links = hierarchy.parent_links(table(spark, sf, "contains_rel"), "start_id", "end_id", "child_order")
    rooted = hierarchy.resolve(links, with_path=True).filter("depth > 0 and node_id like 'fn:%'")
    above = rooted.select(F.col("node_id").alias("function_id"), F.explode(F.slice("path", 1, F.size("path") - 1)).alias("service"))
    return above.filter("service like 'svc:%'").select("service", "function_id")


@query(f"{_G} SELECT r.path AS route, n.name AS handler, s.symbol FROM nodes r JOIN edges x ON x.dst = r.id AND x.type = 'EXPOSES_API' JOIN nodes n ON n.id = x.src JOIN edges d ON d.src = n.id AND d.type = 'DEFINES' JOIN nodes s ON s.id = d.dst WHERE r.label = 'APIRoute'")
def n2_route_handlers(spark: SparkSession, sf: str) -> DataFrame:
    """API route to handler to symbol, a chain of three hops."""
    s = Star(spark, sf)
    one = pattern.expand(s.nodes("APIRoute").select("id", F.col("path").alias("route")), s.edges("EXPOSES_API"), "id", "fn", "in")
    two = pattern.expand(pattern.attach(one, s.nodes("Function"), "fn", {"handler": "name"}), s.edges("DEFINES"), "fn", "sym")
    return pattern.attach(two, s.nodes("Symbol"), "sym", {"symbol": "symbol"}).select("route", "handler", "symbol")


@query(f"{_G} SELECT f.name AS feature, c.label AS code_type, c.name AS code_name, c.file_path FROM nodes f JOIN edges x ON x.dst = f.id AND x.type = 'IMPLEMENTS' JOIN nodes c ON c.id = x.src AND c.label IN ('Function', 'Method', 'Class') WHERE f.label = 'Feature'")
def n1_feature_code(spark: SparkSession, sf: str) -> DataFrame:
    """Feature to the code that implements it, with its file."""
    s = Star(spark, sf)
    one = pattern.expand(s.nodes("Feature").select("id", F.col("name").alias("feature")), s.edges("IMPLEMENTS"), "id", "code", "in")
    return pattern.attach(one, s.nodes("Function", "Method", "Class"), "code", {"code_type": "label", "code_name": "name", "file_path": "file_path"}).select("feature", "code_type", "code_name", "file_path")


@query(f"{_G} SELECT r.path AS route, h.name AS handler, f.name AS feature, d.title AS document FROM nodes r JOIN edges x ON x.dst = r.id AND x.type = 'EXPOSES_API' JOIN nodes h ON h.id = x.src JOIN edges i ON i.src = h.id AND i.type = 'IMPLEMENTS' JOIN nodes f ON f.id = i.dst AND f.label = 'Feature' JOIN edges w ON w.dst = f.id AND w.type = 'DESCRIBES' JOIN nodes d ON d.id = w.src AND d.label = 'Document' WHERE r.label = 'APIRoute'")
def n2_route_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """API route to handler to feature to the documents that describe it."""
    s = Star(spark, sf)
    one = pattern.attach(pattern.expand(s.nodes("APIRoute").select("id", F.col("path").alias("route")), s.edges("EXPOSES_API"), "id", "fn", "in"), s.nodes("Function"), "fn", {"handler": "name"})
    two = pattern.attach(pattern.expand(one, s.edge_part("IMPLEMENTS", 1), "fn", "feat"), s.nodes("Feature"), "feat", {"feature": "name"})
    three = pattern.expand(two, s.edges("DESCRIBES"), "feat", "doc", "in")
    return pattern.attach(three, s.nodes("Document"), "doc", {"document": "title"}).select("route", "handler", "feature", "document")


@query(f"{_G} SELECT m.name AS caller, m.file_path, m.start_line, n.name AS callee FROM edges c JOIN nodes m ON m.id = c.src JOIN nodes n ON n.id = c.dst WHERE c.type = 'CALLS'")
def n4_callers_with_place(spark: SparkSession, sf: str) -> DataFrame:
    """Callers, functions and methods, of every function with their place; a method of the star tables has none."""
    s = Star(spark, sf)
    calls = s.edges("CALLS").select("src", "dst")
    one = pattern.attach(calls, s.nodes("Function", "Method"), "src", {"caller": "name", "file_path": "file_path", "start_line": "start_line"})
    return pattern.attach(one, s.nodes("Function"), "dst", {"callee": "name"}).select("caller", "file_path", "start_line", "callee")


@query(f"WITH {_F} SELECT name, count(*) AS functions, count(DISTINCT signature) AS signatures FROM f WHERE name IS NOT NULL GROUP BY name")
def n7_signatures_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).filter("name is not null").groupBy("name").agg(F.count("*").alias("functions"), F.count_distinct("signature").alias("signatures"))


@query(f"WITH {_F} SELECT count(*) AS functions, count(*) FILTER (WHERE end_line - start_line + 1 <> loc) AS wrong_lines, count(*) FILTER (WHERE end_byte <= start_byte) AS wrong_bytes, count(*) FILTER (WHERE start_byte IS NULL OR end_byte IS NULL) AS no_bytes FROM f")
def t1_location_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Invariants of locations as one aggregate: line counts and byte ranges that do not fit."""
    wrong = F.count_if(F.col("end_line") - F.col("start_line") + 1 != F.col("lines_of_code"))
    return _functions(spark, sf).agg(F.count("*").alias("functions"), wrong.alias("wrong_lines"), F.count_if(F.col("end_byte") <= F.col("start_byte")).alias("wrong_bytes"), F.count_if(F.col("start_byte").isNull() | F.col("end_byte").isNull()).alias("no_bytes"))


@query(f"WITH {_REF} SELECT count(*) AS refs, count(*) FILTER (WHERE end_id IS NULL) AS no_end, count(*) FILTER (WHERE end_id IS NOT NULL AND end_id NOT IN (SELECT id FROM code_symbols WHERE id IS NOT NULL UNION SELECT id FROM shared_symbols)) AS dangling FROM r")
def t2_orphan_references(spark: SparkSession, sf: str) -> DataFrame:
    """References that point nowhere. The hot ends are counted before the join, so it sees each end once."""
    per = _references(spark, sf).groupBy("end_id").agg(F.count("*").alias("_n"))
    known = table(spark, sf, "code_symbols").select("id").unionByName(table(spark, sf, "shared_symbols").select("id")).filter("id is not null").distinct().withColumn("_there", F.lit(1))
    joined = per.join(known, per.end_id == known.id, "left")
    zero = F.lit(0).cast("long")
    return joined.agg(F.coalesce(F.sum("_n"), zero).alias("refs"), F.coalesce(F.sum(F.when(F.col("end_id").isNull(), F.col("_n"))), zero).alias("no_end"), F.coalesce(F.sum(F.when(F.col("end_id").isNotNull() & F.col("_there").isNull(), F.col("_n"))), zero).alias("dangling"))


@query("SELECT CASE WHEN contains(lower(text), 'voucher') THEN 'voucher' ELSE 'other' END AS topic, lower(coalesce(lang, '')) AS language, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def t3_keyword_groups(spark: SparkSession, sf: str) -> DataFrame:
    topic = F.when(scan.contains_ci("text", "voucher"), "voucher").otherwise("other")
    return table(spark, sf, "documents").filter("text is not null").groupBy(topic.alias("topic"), F.lower(F.coalesce("lang", F.lit(""))).alias("language")).agg(F.count("*").alias("n"))

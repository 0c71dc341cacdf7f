"""Scalar functions and the text pipeline over whole tables (inventory H, D11, L13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import source, text
from symloom.functions import symbols as sym
from symloom.plans.base import Registry
from symloom.tables import newest_sql, one_per_key, table

query = Registry()
_SYM = "s AS (SELECT DISTINCT symbol FROM code_symbols WHERE symbol IS NOT NULL)"
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_symbols").filter("symbol is not null").select("symbol").distinct()


@query(f"WITH {_SYM}, p AS (SELECT symbol, string_split(symbol, ' ') AS a FROM s) SELECT symbol, a[1] AS scheme, a[2] AS manager, a[3] AS package, a[4] AS version, array_to_string(a[5:], ' ') AS descriptor FROM p WHERE len(a) >= 5")
def h4_parse_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).withColumn("p", sym.parse_symbol(F.col("symbol"))).filter("p is not null").select("symbol", "p.*")


@query("SELECT DISTINCT p_partkey AS k, 'scip-go go ' || p_brand || ' v' || p_size || ' ' || p_type || '#' || replace(p_name, ' ', '_') || '().' AS symbol FROM part")
def h6_build_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Go symbols out of their parts (H5 to H7)."""
    null = F.lit(None).cast("string")
    descriptor = sym.go_descriptor(null, F.col("p_type"), F.translate("p_name", " ", "_"), null, null, F.lit(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), sym.go_symbol(F.col("p_brand"), F.concat(F.lit("v"), F.col("p_size").cast("string")), descriptor).alias("symbol")).distinct()


@query("SELECT DISTINCT p_partkey AS k, 'scip-go go ' || p_brand || ' v' || p_size || ' ' || CASE WHEN p_size % 2 = 0 THEN p_type || '#' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'f' || p_size || '.' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'local x' || p_size ELSE '' END || CASE WHEN p_size % 7 = 0 THEN 'param ctx' ELSE '' END AS symbol FROM part")
def h7_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors with each kind of part: types, fields, locals and parameters, where they are there (H7)."""
    null, size = F.lit(None).cast("string"), F.col("p_size").cast("string")
    if_ = lambda n, value: F.when(F.col("p_size") % n == 0, value)
    descriptor = sym.go_descriptor(null, if_(2, F.col("p_type")), null, if_(3, F.concat(F.lit("f"), size)), if_(5, F.concat(F.lit("x"), size)), if_(7, F.lit("ctx")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), sym.go_symbol(F.col("p_brand"), F.concat(F.lit("v"), size), descriptor).alias("symbol")).distinct()


@query(f"WITH {_SYM} SELECT symbol, CASE WHEN contains(symbol, '#') AND contains(symbol, '().') THEN 'Method' WHEN contains(symbol, '().') THEN 'Function' WHEN contains(symbol, '#') THEN 'Type' WHEN contains(symbol, '/') THEN 'Package' ELSE 'Variable' END AS kind FROM s")
def h8_infer_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).select("symbol", sym.infer_kind(F.col("symbol")).alias("kind"))


@query(f"WITH {_SYM}, p AS (SELECT symbol, string_split(symbol, ' ') AS a FROM s) SELECT symbol, CASE WHEN len(a) < 5 THEN symbol WHEN contains(a[5], '#') THEN regexp_replace(string_split(a[5], '#')[-1], '\\(\\)$', '') WHEN contains(a[5], '/') THEN string_split(a[5], '/')[-1] ELSE a[5] END AS shown FROM p")
def h9_display_names(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).select("symbol", sym.display_name(F.col("symbol")).alias("shown"))


@query("SELECT DISTINCT kind, CASE kind WHEN 'Namespace' THEN 'Package' WHEN 'Class' THEN 'Type' WHEN 'Type' THEN 'Type' WHEN 'Interface' THEN 'Interface' WHEN 'Function' THEN 'Function' WHEN 'Method' THEN 'Method' WHEN 'Field' THEN 'Field' WHEN 'Constant' THEN 'Constant' WHEN 'Parameter' THEN 'Parameter' ELSE 'Variable' END AS model_kind, CASE WHEN kind IN ('Function', 'Method', 'Parameter') THEN kind ELSE 'Variable' END AS label FROM code_symbols")
def h10_kind_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Index kinds to model kinds to labels."""
    kinds = table(spark, sf, "code_symbols").select("kind").distinct()
    mapped = kinds.withColumn("model_kind", sym.index_kind(F.col("kind")))
    return mapped.select("kind", "model_kind", sym.kind_label(F.col("model_kind")).alias("label"))


@query("SELECT id, CASE WHEN list_contains(labels, 'Method') THEN 'Method' WHEN list_contains(labels, 'Function') THEN 'Function' ELSE 'Unknown' END AS kind FROM (" + newest_sql("code_functions", ("labels",), "updated_at") + ")")
def h12_label_kinds(spark: SparkSession, sf: str) -> DataFrame:
    one = one_per_key(table(spark, sf, "code_functions"), ["id"], ["labels"], "updated_at")
    return one.select("id", sym.labels_kind(F.col("labels")).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_suppkey + 1 END AS start_line, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_suppkey + 1 ELSE l_suppkey + 3 END AS end_line, (l_partkey & 1) <> 0 AS is_definition FROM lineitem")
def h13_ranges_and_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of four, three and fewer numbers, and the definition bit."""
    n = F.col("l_linenumber") % 3
    i = lambda c: c.cast("int")
    a, b = i(F.col("l_suppkey")), i(F.col("l_linenumber"))
    span = F.when(n == 0, F.array(a, b)).when(n == 1, F.array(a, b, b + 5)).otherwise(F.array(a, b, a + 2, b))
    parts = sym.range_parts(span)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parts["start_line"].alias("start_line"), parts["end_line"].alias("end_line"), sym.is_definition(F.col("l_partkey")).alias("is_definition"))


@query("SELECT doc_id, CASE WHEN n LIKE '%.md' THEN CASE WHEN contains(n, 'readme') THEN 'README' WHEN contains(n, 'rfc') THEN 'RFC' WHEN contains(n, 'spec') THEN 'Specification' WHEN contains(n, 'arch') THEN 'Architecture' ELSE 'Markdown Document' END WHEN n LIKE '%.txt' THEN 'Text Document' WHEN n LIKE '%.rst' THEN 'reStructuredText' ELSE 'Document' END AS kind FROM (SELECT doc_id, lower(string_split(coalesce(source_url, ''), '/')[-1]) AS n FROM documents)")
def h16_document_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.document_type(F.coalesce("source_url", F.lit(""))).alias("kind"))


_TITLE = f"CASE WHEN regexp_extract(text, '(?m)^#\\s+(.+)$', 1) <> '' THEN trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1), {_BLANK}) ELSE coalesce(trim(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANK})), lambda x: strlen(x) > 5 AND strlen(x) < 100)[1], '[#*_`]', '', 'g'), {_BLANK}), 'Untitled Document') END"


@query(f"SELECT doc_id, {_TITLE} AS title FROM documents WHERE text IS NOT NULL")
def h17_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", text.title(F.col("text")).alias("title"))


_WORDS = "len(list_filter(regexp_split_to_array({x}, '[\\t\\n\\f\\r ]+'), lambda w: w <> ''))"
_PARAS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, {_BLANK})), lambda p: p <> '')"


def _chunk_sql(limit: int) -> str:
    items = f"list_transform({_PARAS}, lambda p: {{'done': []::VARCHAR[], 'open': p, 'n': {_WORDS.format(x='p')}}})"
    fold = f"list_reduce({items}, lambda a, p: CASE WHEN a.n + p.n > {limit} AND a.open <> '' THEN {{'done': list_append(a.done, a.open), 'open': p.open, 'n': p.n}} WHEN a.open = '' THEN {{'done': a.done, 'open': p.open, 'n': a.n + p.n}} ELSE {{'done': a.done, 'open': a.open || chr(10) || chr(10) || p.open, 'n': a.n + p.n}} END, {{'done': []::VARCHAR[], 'open': '', 'n': 0::BIGINT}})"
    return f"c AS (SELECT doc_id, source_url, CASE WHEN f.open <> '' THEN list_append(f.done, f.open) ELSE f.done END AS chunks FROM (SELECT doc_id, source_url, {fold} AS f FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {_chunk_sql(100)} SELECT doc_id, unnest(range(len(chunks))) AS chunk, unnest(chunks) AS words_of FROM c")
def h18_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs packed to chunks of at most 100 words."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(text.chunks(F.col("text"), 100)).alias("chunk", "words_of"))


@query(f"WITH {_chunk_sql(1000)} SELECT doc_id, unnest(range(len(chunks))) AS chunk, unnest(chunks) AS words_of FROM c")
def h18_chunks_of_a_thousand(spark: SparkSession, sf: str) -> DataFrame:
    """The same at the size that the pipeline uses."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk", "words_of"))


@query(f"SELECT doc_id, {_WORDS.format(x='text')} AS words, trim(regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g'), {_BLANK}) AS flat FROM documents WHERE text IS NOT NULL")
def h25_words_and_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """Word counts and collapsed white space."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", text.word_count(F.col("text")).alias("words"), text.collapse(F.col("text")).alias("flat"))


@query("SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*(?:\\(\\))?)`', 1), lambda t: regexp_matches(t, '[A-Z_]') AND lower(t) NOT IN ({})))) AS token FROM documents WHERE text IS NOT NULL".format(", ".join(f"'{w}'" for w in text.COMMON_WORDS)))
def h23_code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.explode(text.code_tokens(F.col("text"))).alias("token"))


_H20 = "list_filter(list_transform(regexp_extract_all(chunk, '(?m)^#{1,3}[\\t\\n\\f\\r ]+(.+)$', 1), lambda h: trim(h, " + _BLANK + ")), lambda h: strlen(h) >= 3 AND strlen(h) <= 80 AND len(list_filter([" + ", ".join(f"'{g}'" for g in text.GENERIC_HEADERS) + "], lambda g: contains(lower(h), g))) = 0)"
_CATS = " UNION ALL ".join(
    "SELECT doc_id, ci, '{c}' AS category, unnest(list_filter(list_transform(regexp_extract_all(chunk, '{p}', 1), lambda n: trim(n, {b})), lambda n: strlen(n) > 3)) AS name FROM e".format(c=c, p=p, b=_BLANK) for c, p in text.CATEGORIES.items()
)
_FOUND = f"WITH {_chunk_sql(1000)}, e AS (SELECT doc_id, unnest(range(len(chunks))) AS ci, unnest(chunks) AS chunk FROM c), found AS ({_CATS} UNION ALL SELECT doc_id, ci, 'section', unnest({_H20}) FROM e)"


# With description and tags; a feature's place is its chunk, the rank of its pattern and its number there.
_NAMES = " UNION ALL ".join(
    [
        "SELECT doc_id, kind, ci, chunk, {r} AS r, '{c}' AS category, list_filter(list_transform(regexp_extract_all(chunk, '{p}', 1), lambda n: trim(n, {b})), lambda n: strlen(n) > 3) AS names FROM e".format(r=r, c=c, p=p, b=_BLANK)
        for r, (c, p) in enumerate(text.CATEGORIES.items())
    ]
    + [f"SELECT doc_id, kind, ci, chunk, {len(text.CATEGORIES)}, 'section', {_H20} FROM e"]
)
_KIND = "CASE WHEN n LIKE '%.md' THEN CASE WHEN contains(n, 'readme') THEN 'README' WHEN contains(n, 'rfc') THEN 'RFC' WHEN contains(n, 'spec') THEN 'Specification' WHEN contains(n, 'arch') THEN 'Architecture' ELSE 'Markdown Document' END WHEN n LIKE '%.txt' THEN 'Text Document' WHEN n LIKE '%.rst' THEN 'reStructuredText' ELSE 'Document' END"
_REST = "CASE WHEN strlen(chunk) > 100 THEN substr(chunk, 1, list_max(list_filter(range(25, 101), lambda k: strlen(substr(chunk, 1, k)) <= 100))) || '...' ELSE chunk END"
_HIT = f"trim(list_filter(string_split(chunk, '.'), lambda s: contains(lower(s), lower(name)))[1], {_BLANK})"
_FULL = f"""{_FOUND.split(', found AS (')[0].replace('SELECT doc_id, unnest(range(len(chunks))) AS ci', f"SELECT doc_id, (SELECT {_KIND} FROM (SELECT lower(string_split(coalesce(source_url, ''), '/')[-1]) AS n)) AS kind, unnest(range(len(chunks))) AS ci")},
named AS ({_NAMES}), each AS (SELECT doc_id, lower(kind) AS kind, ci, chunk, r, category, unnest(range(len(names))) AS k, unnest(names) AS name FROM named),
full_found AS (SELECT doc_id, ci, category, name, ci * 1000000 + r * 100000 + k AS ordinal, CASE WHEN category = 'section' THEN 'Section: ' || name ELSE coalesce({_HIT} || '.', {_REST}) END AS description, CASE WHEN category = 'section' THEN ['section', 'documentation'] ELSE [category, kind] END AS tags FROM each)"""
_KEY = f"lower(trim(regexp_replace(name, '[\\t\\n\\f\\r ]+', ' ', 'g'), {_BLANK}))"
_MERGED = f"""{_FULL}, keyed AS (SELECT *, {_KEY} AS key, strlen(description) AS size FROM full_found),
tagged AS (SELECT doc_id, key, array_to_string(list(tag ORDER BY o), ',') AS tags FROM (SELECT doc_id, key, tag, min(ordinal * 10 + p) AS o FROM (SELECT doc_id, key, ordinal, unnest(tags) AS tag, unnest(range(len(tags))) AS p FROM keyed) GROUP BY doc_id, key, tag) GROUP BY doc_id, key),
merged AS (SELECT k.doc_id, k.key, any_value(tagged.tags) AS tags, arg_min(name, ordinal) AS name, arg_max(description, (size, -ordinal)) AS description FROM keyed k JOIN tagged USING (doc_id, key) GROUP BY k.doc_id, k.key)"""


@query(f"{_FULL} SELECT doc_id, ci AS chunk, category, name, description, array_to_string(tags, ',') AS tags FROM full_found")
def h19_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features by category patterns and by section headers, of every document, with description and tags."""
    return text.features(table(spark, sf, "documents")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "category", "name", "description", F.array_join("tags", ",").alias("tags"))


@query(f"{_MERGED} SELECT doc_id, key, name, description, tags FROM merged")
def d11_merged_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of one document merged by name, case and spacing aside: first name, longest description, all tags."""
    return text.merge_features(text.features(table(spark, sf, "documents"))).select("doc_id", "key", "name", "description", F.array_join("tags", ",").alias("tags"))


@query(f"{_MERGED}, titled AS (SELECT doc_id, {_TITLE} AS title, (SELECT {_KIND} FROM (SELECT lower(string_split(coalesce(source_url, ''), '/')[-1]) AS n)) AS kind FROM documents WHERE text IS NOT NULL) SELECT titled.doc_id, title, kind, name, description, tags FROM titled LEFT JOIN merged ON merged.doc_id = titled.doc_id")
def l13_index_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text pipeline: title, type, and merged features with description and tags."""
    docs = table(spark, sf, "documents")
    merged = text.merge_features(text.features(docs)).select(F.col("doc_id").alias("_doc"), "name", "description", F.array_join("tags", ",").alias("tags"))
    titled = docs.filter("text is not null").select("doc_id", text.title(F.col("text")).alias("title"), text.document_type(F.coalesce("source_url", F.lit(""))).alias("kind"))
    return titled.join(merged, titled.doc_id == merged["_doc"], "left").drop("_doc")


@query("SELECT id, CASE WHEN end_line <= start_line THEN 1 ELSE end_line - start_line + 1 END::BIGINT AS loc, regexp_matches(name, '^\\p{Lu}') AS exported, CASE WHEN name = '_' THEN NULL WHEN regexp_matches(name, '^\\p{Lu}') THEN 'package' ELSE 'private' END AS scope, file_path || ':' || start_line || ':0' AS fallback FROM (" + newest_sql("code_functions", ("name", "start_line", "end_line", "file_path"), "updated_at") + ")")
def h26_lines_and_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of code, exported names, scopes and fallback ids."""
    one = one_per_key(table(spark, sf, "code_functions"), ["id"], ["name", "start_line", "end_line", "file_path"], "updated_at")
    return one.select("id", sym.lines_of_code(F.col("start_line"), F.col("end_line")).alias("loc"), sym.is_exported(F.col("name")).alias("exported"), sym.scope(F.col("name")).alias("scope"), sym.fallback_id(F.col("file_path"), F.col("start_line"), F.lit(0)).alias("fallback"))


_LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS x, doc_id % 5 + 1 AS a, doc_id % 7 + 2 AS b FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_LINES} SELECT doc_id, CASE WHEN a <= b AND a <= len(x) THEN array_to_string(x[a:b], chr(10)) END AS lines, coalesce(list_sum(list_transform(x[1:a - 1], lambda y: strlen(y) + 1)), 0)::BIGINT + 3 AS at FROM l")
def h28_lines_and_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """A range of lines of every text, of another place and length for each (some are past the end or turned round),
    and the byte offset of its first line's column 3 (H28, H29)."""
    docs = table(spark, sf, "documents").filter("text is not null")
    first, last = F.col("doc_id") % 5 + 1, F.col("doc_id") % 7 + 2
    return docs.select("doc_id", source.line_slice(F.col("text"), first, last).alias("lines"), source.offset_of(F.col("text"), first, F.lit(3)).alias("at"))


@query("SELECT DISTINCT path, sha256(path) AS hash FROM code_sources WHERE path IS NOT NULL")
def h30_path_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_sources").filter("path is not null").select("path", F.sha2("path", 256).alias("hash")).distinct()


@query("SELECT DISTINCT id, array_to_string(list_filter(list_transform(string_split(docstring, chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '^[\\t ]*//', ''), '^/\\*', ''), '\\*/$', ''), " + _BLANK + ")), lambda x: x <> ''), ' ') AS docstring FROM code_functions WHERE docstring IS NOT NULL")
def h34_docstrings(spark: SparkSession, sf: str) -> DataFrame:
    """Docstrings without comment marks, lines joined by spaces."""
    return table(spark, sf, "code_functions").filter("docstring is not null").select("id", text.docstring(F.col("docstring")).alias("docstring")).distinct()

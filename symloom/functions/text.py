"""Prose documents to titles, chunks and features: column expressions and higher-order functions, no UDF.

Patterns use (?d), so that only a line feed ends a line, and spell out white space; both as RE2 reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\r\f\x0b"
_S = r"[\t\n\f\r ]"

# What marks a feature, in the order in which categories are tried.
CATEGORIES = {
    "implementation": r"(?i)implement(?:s|ing|ation)?[\t\n\f\r ]+([A-Z][A-Za-z\t\n\f\r ]+)",
    "feature": r"(?i)(?:feature|capability|functionality):[\t\n\f\r ]*([A-Z][A-Za-z\t\n\f\r ]+)",
    "requirement": r"(?i)(?:require(?:s|ment)?|must|should)[\t\n\f\r ]+([A-Z][A-Za-z\t\n\f\r ]+)",
    "api": r"(?i)(?:API|endpoint|route):[\t\n\f\r ]*([A-Z][A-Za-z\t\n\f\r /]+)",
    "service": r"(?i)(?:service|microservice):[\t\n\f\r ]*([A-Z][A-Za-z\t\n\f\r -]+)",
}
# A header of a section, and headers that name no feature.
HEADER = r"(?dm)^#{1,3}[\t\n\f\r ]+(.+)$"
GENERIC_HEADERS = ("introduction", "overview", "conclusion", "summary", "table of contents", "contents", "index", "references", "appendix", "notes", "todo", "changelog")
# An identifier in backticks, and words that are none.
CODE_TOKEN = r"`([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\(\))?)`"
COMMON_WORDS = (
    "the", "and", "or", "but", "if", "then", "else", "when", "where", "what", "how", "why", "who", "which", "that", "this", "these", "those", "can", "will", "would", "should", "could", "may", "might", "must",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "get", "got", "set", "put", "let", "make", "take",
)
CHUNK_WORDS = 1000


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, _S + "+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _S + "+"), lambda w: w != ""))


def title(text: Column) -> Column:
    """The first first-level header; else the first line of more than 5 and less than 100 bytes without its
    marks; else 'Untitled Document'."""
    header = F.regexp_extract(text, r"(?dm)^#[\t\n\f\r ]+(.+)$", 1)
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: (F.octet_length(x) > 5) & (F.octet_length(x) < 100))
    first = trim(F.regexp_replace(F.try_element_at(lines, F.lit(1)), "[#*_`]", ""))
    return F.when(header != "", trim(header)).otherwise(F.coalesce(first, F.lit("Untitled Document")))


def document_type(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    has = lambda word: F.contains(name, F.lit(word))
    markdown = F.when(has("readme"), "README").when(has("rfc"), "RFC").when(has("spec"), "Specification").when(has("arch"), "Architecture").otherwise("Markdown Document")
    return F.when(F.endswith(name, F.lit(".md")), markdown).when(F.endswith(name, F.lit(".txt")), "Text Document").when(F.endswith(name, F.lit(".rst")), "reStructuredText").otherwise("Document")


def chunks(text: Column, limit: int = CHUNK_WORDS) -> Column:
    """Paragraphs packed in order into chunks of at most `limit` words; a longer paragraph is a chunk by itself."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), trim), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(state: Column, paragraph: Column) -> Column:
        n = word_count(paragraph)
        full = (state["n"] + n > limit) & (state["open"] != "")
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(full | (state["open"] == ""), paragraph).otherwise(F.concat(state["open"], F.lit("\n\n"), paragraph)).alias("open"),
            F.when(full, n).otherwise(state["n"] + n).alias("n"),
        )

    return F.aggregate(paragraphs, start, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def is_generic_header(header: Column) -> Column:
    low, size = F.lower(header), F.octet_length(header)
    return F.exists(F.array(*[F.lit(g) for g in GENERIC_HEADERS]), lambda g: F.contains(low, g)) | (size < 3) | (size > 80)


def sentence_with(chunk: Column, name: Column) -> Column:
    """The first sentence that holds the name, whatever its case; else the first 100 bytes, without a cut character."""
    hit = F.try_element_at(F.filter(F.split(chunk, r"\."), lambda s: F.contains(F.lower(s), F.lower(name))), F.lit(1))
    fits = F.array_max(F.filter(F.sequence(F.lit(25), F.lit(100)), lambda n: F.octet_length(F.substring(chunk, F.lit(1), n)) <= 100))
    rest = F.when(F.octet_length(chunk) > 100, F.concat(F.substring(chunk, F.lit(1), fits), F.lit("..."))).otherwise(chunk)
    return F.when(hit.isNotNull(), F.concat(trim(hit), F.lit("."))).otherwise(rest)


def code_tokens(text: Column) -> Column:
    """Distinct identifiers in backticks, first occurrence first, without common words; one capital or '_' at least."""
    found = F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(*COMMON_WORDS) & t.rlike("[A-Z_]")))


def docstring(comment: Column) -> Column:
    """A comment's lines without their marks, joined by spaces."""
    bare = F.transform(F.split(comment, "\n"), lambda x: trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[\t ]*//", ""), r"^/\*", ""), r"\*/$", "")))
    return F.array_join(F.filter(bare, lambda x: x != ""), " ")


def features(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source_url") -> DataFrame:
    """(doc_id, chunk, category, ordinal, name, description, tags): features as patterns and headers give them."""
    base = documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lower(document_type(F.coalesce(F.col(path), F.lit("")))).alias("_type"), F.posexplode(chunks(F.col(text))).alias("chunk", "_chunk"))
    # One pass over each chunk: an array of (category rank, category, names) is exploded twice.
    found = [F.struct(F.lit(i).alias("rank"), F.lit(c).alias("category"), F.filter(F.transform(F.regexp_extract_all("_chunk", F.lit(p), F.lit(1)), trim), lambda n: F.octet_length(n) > 3).alias("names")) for i, (c, p) in enumerate(CATEGORIES.items())]
    headers = F.filter(F.transform(F.regexp_extract_all("_chunk", F.lit(HEADER), F.lit(1)), trim), lambda h: ~is_generic_header(h))
    found.append(F.struct(F.lit(len(CATEGORIES)).alias("rank"), F.lit("section").alias("category"), headers.alias("names")))
    each = base.select("doc_id", "_type", "chunk", "_chunk", F.explode(F.array(*found)).alias("_f")).select("doc_id", "_type", "chunk", "_chunk", "_f.rank", "_f.category", F.posexplode("_f.names").alias("_at", "name"))
    section = F.col("category") == "section"
    return each.select(
        "doc_id",
        "chunk",
        "category",
        (F.col("chunk") * 1_000_000 + F.col("rank") * 100_000 + F.col("_at")).alias("ordinal"),
        "name",
        F.when(section, F.concat(F.lit("Section: "), "name")).otherwise(sentence_with(F.col("_chunk"), F.col("name"))).alias("description"),
        F.when(section, F.array(F.lit("section"), F.lit("documentation"))).otherwise(F.array("category", "_type")).alias("tags"),
    )


def merge_features(found: DataFrame) -> DataFrame:
    """One row per document and name (case and spacing aside): the first name, the longest description in
    bytes (the first of equals), the tags in order of occurrence."""
    key = F.lower(collapse(F.col("name")))
    row = F.struct("ordinal", "name", "description", "tags")
    grouped = found.withColumn("key", key).groupBy("doc_id", "key").agg(F.min_by("name", "ordinal").alias("name"), F.max_by("description", F.struct(F.octet_length("description"), -F.col("ordinal"))).alias("description"), F.array_sort(F.collect_list(row)).alias("_rows"))
    # The list holds one name's occurrences in one document, so the document bounds it.
    return grouped.select("doc_id", "key", "name", "description", F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["tags"]))).alias("tags"))

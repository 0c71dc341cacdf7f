"""Scans, lookups and predicates over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCHED = ("name", "display_name", "signature", "symbol", "path")


def label_scan(nodes: DataFrame, label: str, limit: int = 0) -> DataFrame:
    """Nodes with a label; limit 0 means all. A limited scan is ordered by id, so that it is repeatable."""
    own = nodes.filter(F.array_contains("labels", label))
    return own.orderBy("id").limit(limit) if limit else own


def by_property(nodes: DataFrame, label: str, prop: str, value: object) -> DataFrame:
    """Nodes of a label whose property equals a value; null never does."""
    return nodes.filter(F.array_contains("labels", label) & (F.col(prop) == F.lit(value)))


def any_label(*labels: str) -> Column:
    return F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))


def contains_ci(column: str, term: str) -> Column:
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def matches(term: str) -> Column:
    """Any searched property contains the term, whatever its case. Three-valued: a null property decides
    nothing, and a node all of whose properties are null is no match, not even for ''."""
    parts = [contains_ci(c, term) for c in SEARCHED]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def rank() -> Column:
    """Order of kinds in a search: code first, then types, values, files and texts, symbols, the rest."""
    label = F.col("label")
    return F.when(label.isin("Function", "Method"), 1).when(label.isin("Class", "Interface"), 2).when(label.isin("Variable", "Parameter"), 3).when(label.isin("File", "Feature", "Document"), 4).when(label == "Symbol", 5).otherwise(6)


def search(nodes: DataFrame, term: str, labels: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Ranked search: rank, then name with nulls last, then id; limit 0 means all (top-k, no full sort, if given)."""
    own = nodes.filter(F.col("label").isin(*labels)) if labels else nodes
    hit = own.filter(matches(term)).withColumn("rank", rank()).orderBy("rank", F.col("name").asc_nulls_last(), "id")
    return hit.limit(limit) if limit else hit


def shown(df: DataFrame) -> DataFrame:
    """What a list shows of a node: display_name by label, details as an array."""
    label = F.col("label")
    name = F.when(label == "File", F.col("path")).when(label == "Symbol", F.col("symbol")).when(label == "Document", F.col("title")).otherwise(F.col("name"))
    return df.withColumn("shown_name", name).withColumn("details", F.array_compact(F.array("file_path", "signature")))


def coerced(df: DataFrame, text: tuple[str, ...] = (), numbers: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """The response form: '' for a missing text, 0 for a number, false for a flag."""
    for columns, value in ((text, ""), (numbers, 0), (flags, False)):
        for c in columns:
            df = df.withColumn(c, F.coalesce(c, F.lit(value)))
    return df

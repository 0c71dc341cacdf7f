"""A project to a graph: its service, files and declarations as nodes, containment and definitions as edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import symbols as sym
from symloom.functions import text
from symloom.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from symloom.sources import gosrc


def _nodes(df: DataFrame, **columns: Column) -> DataFrame:
    have = {"labels": F.array(columns["label"]), **columns}
    return df.select(*[(have[f.name].cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in NODE_SCHEMA])


def _edges(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
    ends = df.select(src.alias("src"), dst.alias("dst")).filter("src is not null and dst is not null").distinct()
    have = {"id": F.concat_ws("|", F.lit(kind), "src", "dst"), "type": F.lit(kind), "src": F.col("src"), "dst": F.col("dst")}
    return ends.select(*[(have[f.name].cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in EDGE_SCHEMA])


def go_graph(sources: DataFrame, service: str, version: str = "v1.0.0", repo_url: str = "") -> Graph:
    """The graph of a Go project (path, content): Service, File, Module, Class, Interface, Function, Method, Variable,
    Parameter and Symbol nodes; CONTAINS from the service down, DEFINES from a declaration to its symbol.

    Declarations that share a name in one package (as methods of build variants do) are one node each by file and line.
    """
    found = gosrc.extract(sources)
    own = F.concat_ws(":", F.lit("decl"), "file_path", F.col("start_line").cast("string"), "fqn")
    at = F.when(F.col("label") == "Module", F.concat(F.lit("mod:"), "fqn")).otherwise(own)
    declared = found.withColumn("_id", at)
    root = sources.sparkSession.range(1)
    symbol = sym.go_symbol(F.lit(service), F.lit(version), F.concat(F.col("fqn"), F.when(F.col("label").isin("Function", "Method"), "().").when(F.col("label").isin("Class", "Interface"), "#").otherwise(".")))
    named = declared.filter("label in ('Function', 'Method', 'Class', 'Interface')").withColumn("_symbol", symbol)
    files = sources.filter("path is not null").select("path").distinct()
    nodes = [
        _nodes(root, id=F.lit(f"svc:{service}"), label=F.lit("Service"), name=F.lit(service), props=F.create_map(F.lit("version"), F.lit(version), F.lit("repositoryUrl"), F.lit(repo_url))),
        _nodes(files, id=F.concat(F.lit("file:"), "path"), label=F.lit("File"), name=F.element_at(F.split("path", "/"), -1), path=F.col("path")),
        _nodes(
            declared.dropDuplicates(["_id"]), id=F.col("_id"), label=F.col("label"), name=F.col("name"), fqn=F.col("fqn"), signature=F.col("signature"), file_path=F.col("file_path"), start_line=F.col("start_line"), end_line=F.col("end_line"),
            start_byte=F.col("start_byte"), end_byte=F.col("end_byte"), lines_of_code=F.col("lines_of_code"), is_exported=F.col("is_exported"),
        ),
        _nodes(named.select("_symbol", "name").groupBy("_symbol").agg(F.min("name").alias("name")), id=F.concat(F.lit("sym:"), "_symbol"), label=F.lit("Symbol"), symbol=F.col("_symbol"), display_name=F.col("name"), kind=sym.infer_kind(F.col("_symbol"))),
    ]
    file = F.concat(F.lit("file:"), "file_path")
    inner = declared.filter("parent is not null").select("file_path", F.col("parent").alias("fqn"), F.col("_id").alias("_child"))
    holders = declared.filter("label in ('Class', 'Interface', 'Function', 'Method')").select("file_path", "fqn", "_id")
    edges = [
        _edges(files, "CONTAINS", F.lit(f"svc:{service}"), F.concat(F.lit("file:"), "path")),
        _edges(declared.filter("label <> 'Parameter' and parent is null"), "CONTAINS", file, F.col("_id")),
        _edges(inner.join(holders, ["file_path", "fqn"]), "CONTAINS", F.col("_id"), F.col("_child")),
        _edges(named, "DEFINES", F.col("_id"), F.concat(F.lit("sym:"), "_symbol")),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


def document_graph(documents: DataFrame) -> Graph:
    """Documents (path, text) and their features: DESCRIBES leads from a document to each of its features."""
    rows = documents.filter("path is not null and text is not null").groupBy("path").agg(F.max("text").alias("text"))
    merged = text.merge_features(text.features(rows, "path", "text", "path"))
    doc, feature = F.concat(F.lit("doc:"), "path"), F.concat(F.lit("feat:"), "key")
    nodes = _nodes(rows, id=doc, label=F.lit("Document"), title=text.title(F.col("text")), doc_type=text.document_type(F.col("path")), path=F.col("path")).unionByName(
        _nodes(merged.groupBy("key").agg(F.min("name").alias("name"), F.max_by("description", F.octet_length("description")).alias("description")), id=feature, label=F.lit("Feature"), name=F.col("name"), props=F.create_map(F.lit("description"), F.col("description")))
    )
    return Graph(nodes, _edges(merged.withColumnRenamed("doc_id", "path"), "DESCRIBES", doc, feature))


def index_graph(symbols: DataFrame, occurrences: DataFrame, metadata: DataFrame, service: str | None = None) -> Graph:
    """The graph of symbol indexes (sources.scip): services, files, symbols, and a Reference node for each usage."""
    from symloom.sources import scip

    known = scip.definitions(symbols, occurrences)
    served = scip.services(metadata, service)
    files = occurrences.filter("relative_path is not null").select(F.col("relative_path").alias("path")).distinct()
    used = occurrences.filter("symbol <> ''").join(known.select("symbol"), "symbol", "left_semi").withColumn("_range", sym.range_parts(F.col("range")))
    ref = F.concat_ws(":", F.lit("ref"), "relative_path", F.col("ordinal").cast("string"))
    own = F.concat(F.lit("sym:"), "symbol")
    nodes = [
        _nodes(served, id=F.col("id"), label=F.lit("Service"), name=F.col("name"), props=F.create_map(F.lit("version"), F.coalesce("version", F.lit("")), F.lit("root"), F.coalesce("root", F.lit("")))),
        _nodes(files, id=F.concat(F.lit("file:"), "path"), label=F.lit("File"), name=F.element_at(F.split("path", "/"), -1), path=F.col("path")),
        _nodes(known, id=own, label=F.lit("Symbol"), symbol=F.col("symbol"), display_name=F.col("display_name"), kind=F.col("kind"), file_path=F.col("defined_in"), start_line=F.col("start_line")),
        _nodes(used, id=ref, label=F.lit("Reference"), file_path=F.col("relative_path"), start_line=F.col("_range.start_line"), end_line=F.col("_range.end_line")),
    ]
    edges = [
        _edges(used, "CONTAINS", F.concat(F.lit("file:"), "relative_path"), ref),
        _edges(used, "REFERENCES", ref, own),
        _edges(known.filter("defined_in is not null"), "DEFINES", F.concat(F.lit("file:"), "defined_in"), own),
    ]
    if service:
        edges.append(_edges(files, "CONTAINS", F.lit(f"svc:{service}"), F.concat(F.lit("file:"), "path")))
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))

"""The command line: status, schema, index, query, server.

    python -m symloom.cli --store DIR index project PATH --service NAME
    python -m symloom.cli --store DIR query search TERM

A store is a folder with a graph (nodes, edges), the sources beside it, and a catalog; --tables reads the tables of
a folder instead. Every command prints JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from symloom import model, rest
from symloom.service import NotFound, Service, rows, serve
from symloom.sources import files, project, scip


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="symloom")
    top.add_argument("--store", help="folder of a stored graph")
    top.add_argument("--tables", help="folder of tables to query instead")
    top.add_argument("--master", default=None)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("status")
    server = commands.add_parser("server")
    server.add_argument("-p", "--port", type=int, default=0, help="HTTP on this port; without it, JSON-RPC lines on stdin")
    schema = commands.add_parser("schema").add_subparsers(dest="what", required=True)
    for name in ("create", "drop", "info"):
        schema.add_parser(name)
    index = commands.add_parser("index").add_subparsers(dest="what", required=True)
    for name in ("project", "scip", "docs"):
        one = index.add_parser(name)
        one.add_argument("path")
        if name != "docs":
            one.add_argument("-s", "--service", default="")
            one.add_argument("--version", default="v1.0.0")
            one.add_argument("-r", "--repo-url", default="")
    query = commands.add_parser("query").add_subparsers(dest="what", required=True)
    search = query.add_parser("search")
    search.add_argument("term")
    search.add_argument("-l", "--limit", type=int, default=0, help="0 = no limit")
    source = query.add_parser("source")
    source.add_argument("name")
    source.add_argument("--signature", action="store_true", help="the name is a whole signature")
    for name, what in (("references", "id"), ("analyze", "name"), ("impact", "id")):
        query.add_parser(name).add_argument(what)
    query.add_parser("dependencies")
    return top


def _store(graph: model.Graph, folder: str) -> None:
    """Add a graph to a store: nodes and edges that are there already stay one, by id; what is new is merged, then the
    whole is written beside the old and takes its place."""
    spark = graph.nodes.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = lambda name: jvm.org.apache.hadoop.fs.Path(where, name)
    if system.exists(path("graph")):
        old = model.Graph.read(spark, f"{folder}/graph")
        nodes = old.nodes.join(graph.nodes.select("id"), "id", "left_anti").unionByName(graph.nodes)
        edges = old.edges.join(graph.edges.select("id"), "id", "left_anti").unionByName(graph.edges)
        graph = model.Graph(nodes, edges)
    system.delete(path("graph.new"), True)
    graph.write(f"{folder}/graph.new")
    system.delete(path("graph.old"), True)
    if system.exists(path("graph")):
        system.rename(path("graph"), path("graph.old"))
    system.rename(path("graph.new"), path("graph"))
    system.delete(path("graph.old"), True)


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> int:
    say = lambda value: print(json.dumps(value, default=str), file=out, flush=True)
    if args.command == "schema" or args.command == "index":
        if not args.store:
            say({"error": "--store is needed"})
            return 2
    if args.command == "schema":
        catalog = model.Catalog(spark, f"{args.store}/catalog")
        if args.what == "create":
            catalog.create_all()
        elif args.what == "drop":
            catalog.drop_all()
        for row in rows(catalog.show().orderBy("name")):
            say(row)
        for row in rows(catalog.missing().orderBy("name")) if args.what == "info" else ():
            say({"missing": row["name"]})
        return 0
    if args.command == "index":
        if args.what == "project":
            sources = files.go_sources(spark, args.path)
            sources.select("path", "content").write.mode("overwrite").parquet(f"{args.store}/sources")
            sources = spark.read.parquet(f"{args.store}/sources")
            graph = project.go_graph(sources, args.service or args.path.rstrip("/").split("/")[-1], args.version, args.repo_url)
        elif args.what == "scip":
            graph = project.index_graph(*(scip.read(spark, args.path, t) for t in ("symbols", "occurrences", "metadata")), args.service or None)
        else:
            graph = project.document_graph(files.documents(spark, args.path))
        _store(graph, args.store)
        stored = model.Graph.read(spark, f"{args.store}/graph")
        say({"nodes": stored.nodes.count(), "edges": stored.edges.count()})
        return 0
    service = Service(spark, args.tables) if args.tables else Service(spark, args.store, model.Graph.read(spark, f"{args.store}/graph"))
    if args.command == "server":
        if args.port:
            rest.server(service, args.port).serve_forever()
        serve(service, sys.stdin, out)
        return 0
    try:
        if args.command == "status":
            found = service.status()
        elif args.what == "search":
            found = service.search(args.term, None, args.limit)
        elif args.what == "source":
            found = service.source(**{"signature" if args.signature else "name": args.name})
        elif args.what == "references":
            found = service.references(args.id, 0)
        elif args.what == "analyze":
            found = [service.analyze(args.name)]
        elif args.what == "impact":
            found = service.impact(args.id)
        else:
            from symloom.plans import named

            if not args.tables:
                say({"error": "dependencies are told of tables: --tables is needed"})
                return 2
            found = rows(named.l7_dependency_rollup(spark, args.tables).orderBy("service", F.col("foreign_service").asc_nulls_last()))
    except NotFound as problem:
        say({"error": str(problem)})
        return 1
    for row in found:
        say(row)
    return 0


def main(argv: list[str] | None = None) -> int:
    from symloom.session import build_session

    args = parser().parse_args(argv)
    if args.command not in ("schema", "index") and not (args.store or args.tables):
        parser().error("one of --store and --tables is needed")
    return run(build_session(args.master or "local[*]"), args)


if __name__ == "__main__":
    sys.exit(main())

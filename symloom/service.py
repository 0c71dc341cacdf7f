"""A thin response layer over the queries: text or JSON for a person or a tool, one request a line.

    python -m symloom.service FOLDER     reads JSON-RPC requests from stdin, answers on stdout
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import source
from symloom.model import Graph
from symloom.operators import scan, traverse
from symloom.plans.star import Star
from symloom.tables import one_per_key, table

TOOLS = {
    "search": {"description": "Ranked search over names, signatures, symbols and paths", "arguments": {"term": "string", "labels": "array", "limit": "integer, 0 for all"}},
    "source": {"description": "Source of the functions with a name, or with a signature", "arguments": {"name": "string", "signature": "string"}},
    "references": {"description": "Callers of a function", "arguments": {"id": "string", "limit": "integer, 0 for all"}},
    "overview": {"description": "A function with its first callers and callees", "arguments": {"id": "string"}},
    "analyze": {"description": "The function with a name, its place, first callers and callees", "arguments": {"name": "string"}},
    "impact": {"description": "What a function reaches by calls", "arguments": {"id": "string", "hops": "integer"}},
    "status": {"description": "Counts of nodes by label", "arguments": {}},
}
#: Rows of an answer unless the request says otherwise, and of a function's callers and callees.
SHOWN, NEIGHBOURS = 20, 10


class NotFound(LookupError):
    pass


def rows(df: DataFrame, limit: int = 0) -> list[dict]:
    """Rows as they stream in; 0 means all."""
    return [r.asDict(recursive=True) for r in (df.limit(limit) if limit > 0 else df).toLocalIterator()]


class Service:
    """Answers over the tables of a folder; or over a stored graph (and the sources beside it)."""

    def __init__(self, spark: SparkSession, folder: str, graph: Graph | None = None):
        self.spark, self.folder, self.graph = spark, folder, graph
        self.star = Star(spark, folder) if graph is None else None

    def nodes(self, *labels: str) -> DataFrame:
        return self.star.nodes(*labels) if self.star else self.graph.of(*labels)

    def edges(self, *types: str) -> DataFrame:
        return self.star.edges(*types) if self.star else self.graph.rel(*types)

    def search(self, term: str, labels: list[str] | None = None, limit: int = SHOWN) -> list[dict]:
        hit = scan.search(self.nodes(), term, tuple(labels or ()), max(0, limit))
        return rows(scan.coerced(scan.shown(hit).select("id", "label", "shown_name", "signature"), ("shown_name", "signature")))

    def source(self, name: str | None = None, signature: str | None = None) -> list[dict]:
        """(name, signature, file_path, code) of every function or method with this name or signature, in order of
        file and line; an error if there is none."""
        if (name is None) == (signature is None):
            raise TypeError("one of name and signature is needed")
        if self.star:
            columns = ["name", "signature", "file_path", "start_line", "end_line", "start_byte", "end_byte"]
            functions = one_per_key(table(self.spark, self.folder, "code_functions"), ["id"], columns, "updated_at")
            texts = table(self.spark, self.folder, "code_sources")
        else:
            functions, texts = self.nodes("Function", "Method"), self.spark.read.parquet(f"{self.folder}/sources")
        own = functions.filter((F.col("name") == name) if signature is None else (F.col("signature") == signature))
        # The few files wanted are picked by a semi join; no other content is moved.
        texts = texts.join(F.broadcast(own.select(source.relative_path(F.col("file_path")).alias("_p")).distinct().limit(10_000)), source.relative_path(F.col("path")) == F.col("_p"), "left_semi") if own.count() <= 10_000 else texts
        found = rows(source.sliced(own, texts).orderBy(F.col("file_path").asc_nulls_last(), F.col("start_line").asc_nulls_last(), "id").select("name", "signature", "file_path", "code"))
        if not found:
            raise NotFound(f"no function {name or signature}")
        return found

    def references(self, id: str, limit: int = SHOWN) -> list[dict]:
        calls = self.edges("CALLS").filter(F.col("dst") == id).select(F.col("src").alias("caller")).orderBy("caller")
        return rows(calls, limit)

    def overview(self, id: str) -> dict:
        own = rows(self.nodes("Function").filter(F.col("id") == id).select("id", "name", "signature", "file_path", "start_line", "end_line"), 1)
        if not own:
            raise NotFound(f"no function {id}")
        callees = self.edges("CALLS").filter(F.col("src") == id).select(F.col("dst").alias("callee")).orderBy("callee")
        return own[0] | {"callers": [r["caller"] for r in self.references(id, NEIGHBOURS)], "callees": [r["callee"] for r in rows(callees, NEIGHBOURS)]}

    def analyze(self, name: str) -> dict:
        """The first function with this name, by id, with names and files of ten callers and ten callees of all
        functions with it, functions and methods alike."""
        named = self.nodes("Function").filter(F.col("name") == name)
        own = rows(named.select("id", "name", "signature", "file_path", "start_line", "end_line", "lines_of_code").orderBy("id"), 1)
        if not own:
            raise NotFound(f"no function {name}")
        return own[0] | {side: self.near(name, side, NEIGHBOURS) for side in ("callers", "callees")}

    def near(self, name: str, side: str, limit: int = 0) -> list[dict]:
        """(id, name, file_path) of the callers or callees of the functions with a name, functions and methods alike."""
        here, there = ("dst", "src") if side == "callers" else ("src", "dst")
        ids = self.nodes("Function").filter(F.col("name") == name).select(F.col("id").alias("_own"))
        ends = self.nodes("Function", "Method").select("id", "name", "file_path")
        hop = self.edges("CALLS").join(ids, F.col(here) == F.col("_own"), "left_semi").select(F.col(there).alias("_end")).distinct().join(ends, F.col("_end") == F.col("id"))
        return rows(scan.coerced(hop.select("id", "name", "file_path"), ("name", "file_path")).orderBy("name", "id"), limit)

    def impact(self, id: str, hops: int = 10) -> list[dict]:
        seed = self.spark.createDataFrame([(id,)], "seed string")
        return rows(traverse.reachable(self.edges("CALLS"), seed, 1, hops).select("node", "depth").orderBy("depth", "node"))

    def status(self) -> list[dict]:
        return rows(self.nodes().groupBy("label").agg(F.count("*").alias("n")).orderBy("label"))

    def handle(self, line: str) -> dict:
        """The answer to one request line; errors by the JSON-RPC codes."""
        try:
            request = json.loads(line)
        except ValueError:
            return _error(None, -32700, "parse error")
        if not isinstance(request, dict):
            return _error(None, -32600, "no request")
        number, method, params = request.get("id"), request.get("method"), request.get("params") or {}
        if method == "initialize":
            return _result(number, {"name": "symloom", "tools": True})
        if method == "tools/list":
            return _result(number, {"tools": [{"name": n} | t for n, t in TOOLS.items()]})
        if method != "tools/call":
            return _error(number, -32601, f"no method {method}")
        tool = params.get("name")
        if tool not in TOOLS:
            return _error(number, -32602, f"no tool {tool}")
        try:
            return _result(number, getattr(self, tool)(**(params.get("arguments") or {})))
        except (TypeError, NotFound) as problem:
            return _error(number, -32602, str(problem))


def _result(number, value) -> dict:
    return {"jsonrpc": "2.0", "id": number, "result": value}


def _error(number, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def serve(service: Service, lines, out) -> None:
    for line in lines:
        if line.strip():
            print(json.dumps(service.handle(line), default=str), file=out, flush=True)


def main() -> None:
    from symloom.session import build_session

    serve(Service(build_session("local[*]"), sys.argv[1]), sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()

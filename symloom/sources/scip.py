"""Code-index files (SCIP protobuf) as a Spark data source: documents, symbols, occurrences, metadata.

    spark.dataSource.register(ScipSource)
    spark.read.format("scip").option("table", "occurrences").load("/indexes/*.scip")

A small reader of the wire format suffices for the public message layout; each file is one partition.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "documents": "index_file string, relative_path string, language string",
    "symbols": "index_file string, relative_path string, symbol string, display_name string, kind int, documentation array<string>, is_external boolean",
    "occurrences": "index_file string, relative_path string, ordinal bigint, symbol string, range array<int>, symbol_roles int",
    "metadata": "index_file string, tool_name string, tool_version string, project_root string",
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if not byte & 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("message is cut off")
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"no such wire type: {kind}")


def _text(value: int | bytes) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else ""


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n - (1 << 64) if n >= 1 << 63 else n)
    return out


def _symbol(data: bytes) -> dict:
    out: dict = {"symbol": "", "display_name": None, "kind": 0, "documentation": []}
    for n, value in fields(data):
        if n == 1:
            out["symbol"] = _text(value)
        elif n == 3:
            out["documentation"].append(_text(value))
        elif n == 5:
            out["kind"] = value
        elif n == 6:
            out["display_name"] = _text(value)
    return out


def rows(data: bytes, name: str, table: str) -> Iterator[tuple]:
    """Rows of one table out of an index file's bytes."""
    for n, value in fields(data):
        if n == 1 and table == "metadata":
            tool, version, root = None, None, None
            for k, v in fields(value):
                if k == 2:
                    inner = dict(fields(v))
                    tool, version = _text(inner.get(1, b"")), _text(inner.get(2, b""))
                elif k == 3:
                    root = _text(v)
            yield name, tool, version, root
        elif n == 2 and table != "metadata":
            parts = list(fields(value))
            path = next((_text(v) for k, v in parts if k == 1), "")
            if table == "documents":
                yield name, path, next((_text(v) for k, v in parts if k == 4), "")
            elif table == "symbols":
                for s in (_symbol(v) for k, v in parts if k == 3):
                    yield name, path, s["symbol"], s["display_name"], s["kind"], s["documentation"], False
            else:
                for ordinal, occurrence in enumerate(v for k, v in parts if k == 2):
                    span: list[int] = []
                    symbol, roles = "", 0
                    for k, v in fields(occurrence):
                        if k == 1:
                            span += _numbers(v)
                        elif k == 2:
                            symbol = _text(v)
                        elif k == 3:
                            roles = v
                    yield name, path, ordinal, symbol, span, roles
        elif n == 3 and table == "symbols":
            s = _symbol(value)
            yield name, None, s["symbol"], s["display_name"], s["kind"], s["documentation"], True


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str):
        self.paths, self.table = paths, table

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not hasattr(partition, "path"):
            return
        with open(partition.path, "rb") as f:
            yield from rows(f.read(), partition.path, self.table)


class ScipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scip"

    def table(self) -> str:
        table = self.options.get("table", "occurrences")
        if table not in SCHEMAS:
            raise ValueError(f"no such table: {table}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self.table()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(sorted(glob.glob(self.options["path"])), self.table())


def read(spark, path: str, table: str):
    """A table out of the index files at a path or glob of any file system that Spark reads, one file a row."""
    if table not in SCHEMAS:
        raise ValueError(f"no such table: {table}")
    columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                yield pd.DataFrame(list(rows(bytes(content), name, table)), columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMAS[table])


def services(metadata, name: str | None = None):
    """Service nodes (id, name, version, root) of index files: named by the project's root, or as told."""
    from pyspark.sql import functions as F

    own = F.lit(name) if name else F.element_at(F.filter(F.split("project_root", "/"), lambda x: x != ""), -1)
    return metadata.select(F.coalesce(own, F.lit("unknown")).alias("name"), F.col("tool_version").alias("version"), F.col("project_root").alias("root")).distinct().select(F.concat(F.lit("svc:"), "name").alias("id"), "name", "version", "root")


def looks_like_index(first: bytes) -> bool:
    """Whether a file's first byte is one that no text begins with."""
    return bool(first) and first[0] < 32


# ------------------------------------------------------------------------------------------ to the graph


def definitions(symbols, occurrences):
    """(symbol, display_name, kind, defined_in, start_line, n_references) of every symbol that has five fields.

    A symbol's place is its first occurrence with the definition bit, else its first occurrence; every
    group is folded by algebraic aggregates, so a symbol with very many usages is one small state.
    """
    from pyspark.sql import functions as F

    from symloom.functions import symbols as sym

    place = F.struct(F.when(sym.is_definition(F.col("symbol_roles")), 0).otherwise(1), "relative_path", "ordinal")
    used = occurrences.filter("symbol <> ''").groupBy("symbol").agg(
        F.min_by(F.struct(F.col("relative_path").alias("defined_in"), sym.range_parts(F.col("range"))["start_line"].alias("start_line")), place).alias("p"),
        F.count_if(~sym.is_definition(F.col("symbol_roles"))).alias("n_references"),
    )
    named = symbols.filter("symbol <> ''").groupBy("symbol").agg(F.max("display_name").alias("display_name"))
    both = used.join(named, "symbol", "full_outer").filter(sym.parse_symbol(F.col("symbol")).isNotNull())
    return both.select("symbol", F.coalesce("display_name", sym.display_name(F.col("symbol"))).alias("display_name"), sym.infer_kind(F.col("symbol")).alias("kind"), "p.defined_in", "p.start_line", F.coalesce("n_references", F.lit(0)).alias("n_references"))

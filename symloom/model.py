"""The property graph: two columnar tables, their labels, types, constraints and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The labels and relationship types of the data model.
NODE_LABELS = ("Service", "File", "Module", "Class", "Interface", "Function", "Method", "Variable", "Parameter", "Symbol", "APIRoute", "Comment", "Document", "Feature", "Reference")
EDGE_TYPES = ("CONTAINS", "DEFINES", "REFERENCES", "CALLS", "FLOWS_TO", "NEXT_EXECUTION", "INHERITS_FROM", "IMPLEMENTS", "EXPOSES_API", "CALLS_API", "DEPENDS_ON", "DESCRIBES", "MENTIONS")

#: Hot properties are columns, so that they can be pruned and pushed down; the rest goes into props.
NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("labels", T.ArrayType(T.StringType()), False),
        *(T.StructField(c, T.StringType()) for c in ("name", "display_name", "signature", "symbol", "kind", "path", "file_path", "fqn", "title", "doc_type", "method", "protocol")),
        *(T.StructField(c, T.LongType()) for c in ("start_line", "end_line", "start_byte", "end_byte", "lines_of_code", "complexity")),
        T.StructField("is_exported", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("line", T.LongType()),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Fixed values: (name, label, property) of the unique keys, (name, label, properties) of the indexes.
UNIQUE_KEYS = (
    ("symbol_unique", "Symbol", "symbol"),
    ("service_name_unique", "Service", "name"),
    ("file_path_unique", "File", "path"),
    ("class_fqn_unique", "Class", "fqn"),
    ("interface_fqn_unique", "Interface", "fqn"),
    ("module_fqn_unique", "Module", "fqn"),
)
INDEXES = (
    ("service_name_idx", "Service", ("name",)),
    ("file_path_idx", "File", ("path",)),
    ("file_hash_idx", "File", ("hash",)),
    ("class_name_idx", "Class", ("name",)),
    ("class_fqn_idx", "Class", ("fqn",)),
    ("function_name_idx", "Function", ("name",)),
    ("function_signature_idx", "Function", ("signature",)),
    ("method_name_idx", "Method", ("name",)),
    ("variable_name_idx", "Variable", ("name",)),
    ("symbol_kind_idx", "Symbol", ("kind",)),
    ("api_route_path_idx", "APIRoute", ("path",)),
    ("api_route_method_idx", "APIRoute", ("method",)),
    ("document_title_idx", "Document", ("title",)),
    ("document_type_idx", "Document", ("type",)),
    ("feature_name_idx", "Feature", ("name",)),
    ("search_name_idx", "Function", ("name",)),
    ("search_displayname_idx", "Symbol", ("displayName",)),
    ("file_service_path_idx", "File", ("serviceName", "path")),
    ("symbol_service_idx", "Symbol", ("serviceName", "kind")),
)


class Graph:
    """Nodes and edges, whole or by label and type."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def of(self, *labels: str) -> DataFrame:
        """Nodes with any of the labels; a pushed-down filter, and pruned partitions when stored by label."""
        return self.nodes.filter(F.col("label").isin(*labels)) if labels else self.nodes

    def rel(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types)) if types else self.edges

    def write(self, path: str) -> None:
        """Layout of a stored graph: partitions by label and type; sorted inside, so row groups can be skipped."""
        self.nodes.sortWithinPartitions("name", "id").write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.edges.repartition("type", "src").sortWithinPartitions("src").write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Graph:
        nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
        return cls(nodes.select(*[f.name for f in NODE_SCHEMA]), edges.select(*[f.name for f in EDGE_SCHEMA]))


class Catalog:
    """Declared constraints and indexes: create, drop (each with or without 'if exists'), show, validate.

    With a folder the entries are a stored table: every change writes a new version beside the old one, and the
    newest complete version counts, so that another session sees them. Without one they live in this object.
    """

    SCHEMA = "name string, kind string, label string, properties array<string>"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.entries: dict[str, tuple[str, str, tuple[str, ...]]] = {}
        self.version = 0
        if folder:
            self.version = max(self._versions(), default=0)
            if self.version:
                stored = spark.read.schema(self.SCHEMA).parquet(f"{folder}/v{self.version}")
                self.entries = {r["name"]: (r["kind"], r["label"], tuple(r["properties"])) for r in stored.toLocalIterator()}

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(where):
            return []
        names = [s.getPath() for s in system.listStatus(where)]
        return [int(p.getName()[1:]) for p in names if p.getName()[:1] == "v" and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _store(self) -> None:
        if self.folder:
            self.version += 1
            self.show().coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/v{self.version}")

    def _add(self, name: str, kind: str, label: str, properties: tuple[str, ...], if_not_exists: bool) -> bool:
        if kind not in ("UNIQUE", "EXISTENCE", "NODE_KEY", "BTREE", "FULLTEXT", "TEXT", "LOOKUP"):
            raise ValueError(f"no such kind: {kind}")
        if name in self.entries:
            if not if_not_exists:
                raise ValueError(f"{name} exists")
            return False
        self.entries[name] = (kind, label, properties)
        return True

    def create(self, name: str, kind: str, label: str, properties: tuple[str, ...], if_not_exists: bool = False) -> None:
        if self._add(name, kind, label, properties, if_not_exists):
            self._store()

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.entries.pop(name, None) is None:
            if not if_exists:
                raise ValueError(f"{name} does not exist")
            return
        self._store()

    def create_all(self) -> None:
        added = [self._add(name, "UNIQUE", label, (prop,), True) for name, label, prop in UNIQUE_KEYS]
        added += [self._add(name, "BTREE", label, props, True) for name, label, props in INDEXES]
        if any(added):
            self._store()

    def drop_all(self) -> None:
        if self.entries:
            self.entries.clear()
            self._store()

    def show(self, kind: str | None = None) -> DataFrame:
        rows = [(n, k, label, list(p)) for n, (k, label, p) in sorted(self.entries.items()) if kind is None or (k == kind)]
        return self.spark.createDataFrame(rows, self.SCHEMA)

    def missing(self) -> DataFrame:
        """(name, kind, label) of what is declared and the catalog lacks: a set difference as an anti join."""
        declared = [(n, "UNIQUE", label) for n, label, _ in UNIQUE_KEYS] + [(n, "BTREE", label) for n, label, _ in INDEXES]
        return self.spark.createDataFrame(declared, "name string, kind string, label string").join(self.show().select("name"), "name", "left_anti")


def violations(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """(label, key_name, key_value, n) of every value of a unique key that more than one node has."""
    own = nodes.filter((F.col("label") == label) & F.col(key).isNotNull())
    return own.groupBy(F.col(key).alias("key_value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(label).alias("label"), F.lit(key).alias("key_name"), "key_value", "n")


def without_key(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """Nodes that an existence constraint forbids."""
    return nodes.filter((F.col("label") == label) & F.col(key).isNull()).select("id", "label")

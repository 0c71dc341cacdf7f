"""A deterministic property graph out of the star-schema tables, for the queries that need all edge types.

Each part is one projection; parts are joined by name, and nothing is cached, so a query over one label or
type reads only the tables and columns behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from symloom.tables import table


def _node(df: DataFrame, label: str, key: Column, **columns: Column) -> DataFrame:
    have = {"id": key, "label": F.lit(label), "labels": F.array(F.lit(label)), **columns}
    return df.select(*[(have[f.name].cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in NODE_SCHEMA])


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, line: Column | None = None, n: Column | None = None) -> DataFrame:
    parts = [F.lit(kind), src, dst] + ([n.cast("string")] if n is not None else [])
    have = {"id": F.concat_ws("|", *parts), "type": F.lit(kind), "src": src, "dst": dst}
    if line is not None:
        have["line"] = line
    return df.select(*[(have[f.name].cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in EDGE_SCHEMA])


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _symbol() -> Column:
    return F.concat(F.lit("scip-go go "), "p_brand", F.lit(" v"), F.col("p_size").cast("string"), F.lit(" "), "p_type", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("()."))


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        read: dict[str, DataFrame] = {}  # one listing and one schema for each table of a query

        def t(name: str) -> DataFrame:
            if name not in read:
                read[name] = table(spark, sf_dir, name)
            return read[name]

        self.t = t

    # ---------------------------------------------------------------- nodes

    def node_parts(self) -> dict[str, Callable[[], DataFrame]]:
        """Each label's projection, made only when it is asked for."""
        t = self.t
        return {
            "Service": lambda: _node(t("region"), "Service", _id("svc", "r_regionkey"), name=F.concat(F.lit("Brand#"), (F.col("r_regionkey") + 1).cast("string"))),
            "File": lambda: _node(t("nation"), "File", _id("file", "n_nationkey"), path=F.col("n_name")),
            "Class": lambda: _node(t("customer"), "Class", _id("cls", "c_custkey"), name=F.col("c_name"), fqn=F.concat_ws(".", "c_mktsegment", "c_name")),
            "Interface": lambda: _node(t("supplier"), "Interface", _id("if", "s_suppkey"), name=F.col("s_name"), fqn=F.concat(F.lit("pkg."), "s_name")),
            "Method": lambda: _node(t("orders"), "Method", _id("mth", "o_orderkey"), name=F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), created_at=F.col("o_orderdate")).unionByName(
                _node(t("events").select("user_id").distinct(), "Method", _id("um", "user_id"), name=F.concat(F.lit("user_"), F.col("user_id").cast("string")))
            ),
            "Function": lambda: _node(
                t("part"), "Function", _id("fn", "p_partkey"), name=F.col("p_name"), signature=F.concat("p_name", F.lit("("), "p_type", F.lit(") "), "p_brand"), file_path=F.concat(F.lit("src/"), "p_brand", F.lit(".go")),
                start_line=F.col("p_size"), end_line=F.col("p_size") + F.col("p_partkey") % 50, lines_of_code=F.col("p_partkey") % 50 + 1, complexity=F.col("p_size") % 20 + 1, is_exported=F.col("p_size") > 25,
            ),
            "Symbol": lambda: _node(t("part"), "Symbol", _id("sym", "p_partkey"), symbol=_symbol(), display_name=F.col("p_name"), kind=F.lit("Function")),
            "APIRoute": lambda: _node(t("part").filter("p_size < 5").select("p_type", "p_brand").distinct(), "APIRoute", F.concat(F.lit("api:"), "p_type", F.lit("|"), "p_brand"), path=F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type"), method=F.when(F.length("p_type") % 2 == 0, "GET").otherwise("POST"), protocol=F.lit("REST")),
            "Parameter": lambda: _node(t("events").filter("event_type in ('purchase', 'click')"), "Parameter", _id("ev", "event_id"), name=F.concat_ws("_", "event_type", F.col("event_id").cast("string")), created_at=F.col("ts")),
            "Variable": lambda: _node(t("events").filter("event_type not in ('purchase', 'click')"), "Variable", _id("ev", "event_id"), name=F.concat_ws("_", "event_type", F.col("event_id").cast("string")), created_at=F.col("ts")),
            "Reference": lambda: _node(self.lines(), "Reference", self.ref_id(), file_path=F.lit("src/orders.go"), start_line=F.col("l_linenumber")),
            "Feature": lambda: _node(t("part").select("p_type").distinct(), "Feature", F.concat(F.lit("feat:"), "p_type"), name=F.col("p_type")),
            "Document": lambda: _node(t("documents"), "Document", _id("doc", "doc_id"), title=F.col("title"), doc_type=F.col("doc_type"), path=F.col("source_url")),
        }

    def lines(self) -> DataFrame:
        """lineitem with `_n`, which tells rows of one order apart; equal rows get successive numbers."""
        order = [F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
        return self.t("lineitem").withColumn("_n", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))

    @staticmethod
    def ref_id() -> Column:
        return F.concat(F.lit("ref:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("_n").cast("string"))

    # ---------------------------------------------------------------- edges

    def edge_parts(self) -> dict[str, list[Callable[[], DataFrame]]]:
        """Each type's projections, made only when they are asked for."""
        t = self.t
        chosen = "event_type in ('purchase', 'click')"
        return {
            "CONTAINS": [
                lambda: _edge(t("nation"), "CONTAINS", _id("svc", "n_regionkey"), _id("file", "n_nationkey")),
                lambda: _edge(t("customer"), "CONTAINS", _id("file", "c_nationkey"), _id("cls", "c_custkey")),
                lambda: _edge(t("orders"), "CONTAINS", _id("cls", "o_custkey"), _id("mth", "o_orderkey")),
                lambda: _edge(self.lines(), "CONTAINS", _id("mth", "l_orderkey"), self.ref_id()),
                lambda: _edge(t("events").filter(chosen), "CONTAINS", _id("um", "user_id"), _id("ev", "event_id")),
            ],
            "REFERENCES": [lambda: _edge(self.lines(), "REFERENCES", self.ref_id(), _id("sym", "l_partkey"), line=F.col("l_linenumber"))],
            "DEFINES": [lambda: _edge(t("part"), "DEFINES", _id("fn", "p_partkey"), _id("sym", "p_partkey"))],
            "CALLS": [
                lambda: _edge(t("lineitem").select("l_orderkey", "l_partkey").distinct(), "CALLS", _id("mth", "l_orderkey"), _id("fn", "l_partkey")),
                lambda: _edge(self._follow(), "CALLS", _id("fn", "l_partkey"), _id("fn", "_next")),
            ],
            "EXPOSES_API": [lambda: _edge(t("part").filter("p_size < 5"), "EXPOSES_API", _id("fn", "p_partkey"), F.concat(F.lit("api:"), "p_type", F.lit("|"), "p_brand"))],
            "IMPLEMENTS": [
                lambda: _edge(self._implements(), "IMPLEMENTS", _id("cls", "c_custkey"), _id("if", "s_suppkey")),
                lambda: _edge(t("part"), "IMPLEMENTS", _id("fn", "p_partkey"), F.concat(F.lit("feat:"), "p_type")),
            ],
            "DESCRIBES": [lambda: _edge(t("documents").select("doc_id").join(t("part").select("p_partkey", "p_type"), F.col("doc_id") == F.col("p_partkey")), "DESCRIBES", _id("doc", "doc_id"), F.concat(F.lit("feat:"), "p_type"))],
            "FLOWS_TO": [lambda: _edge(self._flows(), "FLOWS_TO", _id("ev", "event_id"), _id("ev", "_next"))],
        }

    #: Labels at the two ends of each projection of a type; None where the edge is made from the node's own row.
    ENDS = {
        "CONTAINS": (("Service", "File"), ("File", "Class"), ("Class", "Method"), ("Method", "Reference"), ("Method", ("Parameter", "Variable"))),
        "REFERENCES": (("Reference", "Symbol"),),
        "DEFINES": (("Function", "Symbol"),),
        "CALLS": (("Method", "Function"), ("Function", "Function")),
        "EXPOSES_API": (("Function", "APIRoute"),),
        "IMPLEMENTS": (("Class", "Interface"), ("Function", "Feature")),
        "DESCRIBES": (("Document", "Feature"),),
        "FLOWS_TO": ((("Parameter", "Variable"), ("Parameter", "Variable")),),
    }
    #: Ends that are made from the very row that makes the node, so that the node is there.
    SURE = {("CONTAINS", 3, "dst"), ("REFERENCES", 0, "src"), ("DEFINES", 0, "src"), ("DEFINES", 0, "dst"), ("EXPOSES_API", 0, "src"), ("EXPOSES_API", 0, "dst"), ("IMPLEMENTS", 0, "src"), ("IMPLEMENTS", 1, "src"), ("IMPLEMENTS", 1, "dst"), ("DESCRIBES", 0, "src"), ("DESCRIBES", 0, "dst"), ("CONTAINS", 0, "dst"), ("CONTAINS", 1, "dst"), ("CONTAINS", 2, "dst")}

    def labelled_edges(self) -> DataFrame:
        """(from_label, type, to_label) of every edge whose ends exist: each projection is held against the nodes of
        the labels that it leads to, instead of all edges against all nodes. A node id with two labels counts twice."""
        parts = []
        for kind, makers in self.edge_parts().items():
            for n, make in enumerate(makers):
                rows = make().select("src", "dst", F.lit(kind).alias("type"))
                for side, labels in zip(("src", "dst"), self.ENDS[kind][n]):
                    name = "from_label" if side == "src" else "to_label"
                    if (kind, n, side) in self.SURE and isinstance(labels, str):
                        rows = rows.withColumn(name, F.lit(labels))
                    else:
                        ends = self.nodes(*((labels,) if isinstance(labels, str) else labels)).select(F.col("id").alias(side), F.col("label").alias(name))
                        rows = rows.join(ends, side)
                parts.append(rows.select("from_label", "type", "to_label"))
        return reduce(DataFrame.unionByName, parts)

    def _follow(self) -> DataFrame:
        by_line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
        after = self.t("lineitem").withColumn("_next", F.lead("l_partkey").over(by_line))
        return after.filter("_next is not null and l_returnflag = 'R' and l_quantity <= 10").select("l_partkey", "_next").distinct()

    def _flows(self) -> DataFrame:
        """(event_id, _next): each event to the user's next one, a purchase also to the one after; one window for both."""
        by_time = W.partitionBy("user_id").orderBy("ts", "event_id")
        both = self.t("events").select("event_id", F.lead("event_id").over(by_time).alias("_one"), F.when(F.col("event_type") == "purchase", F.lead("event_id", 2).over(by_time)).alias("_two"))
        return both.select("event_id", F.explode(F.array_compact(F.array("_one", "_two"))).alias("_next"))

    def _implements(self) -> DataFrame:
        suppliers = self.t("supplier").agg(F.count("*").alias("_suppliers"))
        return self.t("customer").crossJoin(F.broadcast(suppliers)).join(self.t("supplier").select("s_suppkey"), F.expr("c_custkey % _suppliers = s_suppkey"))

    def nodes(self, *labels: str) -> DataFrame:
        parts = self.node_parts()
        return reduce(DataFrame.unionByName, [parts[k]() for k in (labels or parts)])

    def edges(self, *types: str) -> DataFrame:
        parts = self.edge_parts()
        return reduce(DataFrame.unionByName, [make() for k in (types or parts) for make in parts[k]])

    def edge_part(self, kind: str, n: int) -> DataFrame:
        """One projection of a type: CONTAINS between two known labels needs one table, not five."""
        return self.edge_parts()[kind][n]()

    def graph(self) -> Graph:
        return Graph(self.nodes(), self.edges())


#: The same graph in SQL, as common table expressions; row ids as above.
_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem)"
NODES_SQL = f"""{_LINES}, nodes AS (
SELECT 'svc:' || r_regionkey AS id, 'Service' AS label, 'Brand#' || (r_regionkey + 1) AS name, NULL AS display_name, NULL AS signature, NULL AS symbol, NULL AS path, NULL AS fqn, NULL AS file_path, NULL::BIGINT AS start_line, NULL::BIGINT AS end_line, NULL::BIGINT AS complexity, NULL AS title FROM region
UNION ALL SELECT 'file:' || n_nationkey, 'File', NULL, NULL, NULL, NULL, n_name, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'cls:' || c_custkey, 'Class', c_name, NULL, NULL, NULL, NULL, c_mktsegment || '.' || c_name, NULL, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'if:' || s_suppkey, 'Interface', s_name, NULL, NULL, NULL, NULL, 'pkg.' || s_name, NULL, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'mth:' || o_orderkey, 'Method', 'order_' || o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders
UNION ALL SELECT DISTINCT 'um:' || user_id, 'Method', 'user_' || user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL FROM events
UNION ALL SELECT 'fn:' || p_partkey, 'Function', p_name, NULL, p_name || '(' || p_type || ') ' || p_brand, NULL, NULL, NULL, 'src/' || p_brand || '.go', p_size, p_size + p_partkey % 50, p_size % 20 + 1, NULL FROM part
UNION ALL SELECT 'sym:' || p_partkey, 'Symbol', NULL, p_name, NULL, 'scip-go go ' || p_brand || ' v' || p_size || ' ' || p_type || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '().', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
UNION ALL SELECT DISTINCT 'api:' || p_type || '|' || p_brand, 'APIRoute', NULL, NULL, NULL, NULL, '/' || p_brand || '/' || p_type, NULL, NULL, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL FROM part WHERE p_size < 5
UNION ALL SELECT 'ev:' || event_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'Parameter' ELSE 'Variable' END, event_type || '_' || event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events
UNION ALL SELECT 'ref:' || l_orderkey || '-' || n, 'Reference', NULL, NULL, NULL, NULL, NULL, NULL, 'src/orders.go', l_linenumber, NULL, NULL, NULL FROM lines
UNION ALL SELECT DISTINCT 'feat:' || p_type, 'Feature', p_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL FROM part
UNION ALL SELECT 'doc:' || doc_id, 'Document', NULL, NULL, NULL, NULL, source_url, NULL, NULL, NULL, NULL, NULL, title FROM documents)"""
EDGES_SQL = """edges AS (
SELECT 'CONTAINS' AS type, 'svc:' || n_regionkey AS src, 'file:' || n_nationkey AS dst, NULL::BIGINT AS line FROM nation
UNION ALL SELECT 'CONTAINS', 'file:' || c_nationkey, 'cls:' || c_custkey, NULL FROM customer
UNION ALL SELECT 'CONTAINS', 'cls:' || o_custkey, 'mth:' || o_orderkey, NULL FROM orders
UNION ALL SELECT 'CONTAINS', 'mth:' || l_orderkey, 'ref:' || l_orderkey || '-' || n, NULL FROM lines
UNION ALL SELECT 'CONTAINS', 'um:' || user_id, 'ev:' || event_id, NULL FROM events WHERE event_type IN ('purchase', 'click')
UNION ALL SELECT 'REFERENCES', 'ref:' || l_orderkey || '-' || n, 'sym:' || l_partkey, l_linenumber FROM lines
UNION ALL SELECT 'DEFINES', 'fn:' || p_partkey, 'sym:' || p_partkey, NULL FROM part
UNION ALL SELECT DISTINCT 'CALLS', 'mth:' || l_orderkey, 'fn:' || l_partkey, NULL::BIGINT FROM lineitem
UNION ALL SELECT DISTINCT 'CALLS', 'fn:' || l_partkey, 'fn:' || nxt, NULL::BIGINT FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND l_returnflag = 'R' AND l_quantity <= 10
UNION ALL SELECT 'EXPOSES_API', 'fn:' || p_partkey, 'api:' || p_type || '|' || p_brand, NULL FROM part WHERE p_size < 5
UNION ALL SELECT 'IMPLEMENTS', 'cls:' || c_custkey, 'if:' || s_suppkey, NULL FROM customer JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey
UNION ALL SELECT 'IMPLEMENTS', 'fn:' || p_partkey, 'feat:' || p_type, NULL FROM part
UNION ALL SELECT 'DESCRIBES', 'doc:' || doc_id, 'feat:' || p_type, NULL FROM documents JOIN part ON p_partkey = doc_id
UNION ALL SELECT 'FLOWS_TO', 'ev:' || event_id, 'ev:' || nxt, NULL FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL
UNION ALL SELECT 'FLOWS_TO', 'ev:' || event_id, 'ev:' || nxt, NULL FROM (SELECT event_id, event_type, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND event_type = 'purchase')"""

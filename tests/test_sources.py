from pyspark.sql import functions as F

from symloom.sources import files, gosrc, scip


def varint(n):
    out = b""
    while True:
        out += bytes([(n & 0x7F) | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(n, value):
    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(n << 3 | 2) + varint(len(value)) + value


def occurrence(span, symbol, roles):
    return field(2, field(1, b"".join(map(varint, span))) + field(2, symbol) + field(3, roles))


def index():
    s = "scip-go go order v1 pkg/checkout()."
    doc = field(1, "a.go") + field(4, "Go") + occurrence([9, 1, 4], s, 0) + occurrence([2, 0, 5, 1], s, 1) + occurrence([3, 0, 2], "local 1", 9) + field(3, field(1, s) + field(3, "Does it.") + field(6, "checkout"))
    return field(1, field(2, field(1, "scip-go") + field(2, "1.2")) + field(3, "file:///r")) + field(2, doc) + field(3, field(1, "scip-go go other v2 p/X#") + field(5, 7))


def test_scip_source(spark, tmp_path):
    (tmp_path / "one.scip").write_bytes(index())
    spark.dataSource.register(scip.ScipSource)
    read = lambda t: spark.read.format("scip").option("table", t).load(str(tmp_path / "*.scip"))
    used = read("occurrences").orderBy("ordinal").collect()
    assert [(r.symbol_roles, list(r.range)) for r in used] == [(0, [9, 1, 4]), (1, [2, 0, 5, 1]), (9, [3, 0, 2])]
    assert read("documents").first().language == "Go" and read("metadata").first().tool_version == "1.2"
    assert {(r.symbol, r.is_external) for r in read("symbols").collect()} == {("scip-go go order v1 pkg/checkout().", False), ("scip-go go other v2 p/X#", True)}
    got = {r.symbol: r for r in scip.definitions(read("symbols"), read("occurrences")).collect()}
    own = got["scip-go go order v1 pkg/checkout()."]
    assert (own.display_name, own.kind, own.defined_in, own.start_line, own.n_references) == ("checkout", "Function", "a.go", 3, 1)
    assert got["scip-go go other v2 p/X#"].n_references == 0 and "local 1" not in got
    assert scip.looks_like_index(index()[:1]) and not scip.looks_like_index(b"#") and not scip.looks_like_index(b"")


GO = b"""// Package doc.
package shop

import "fmt"

const limit = 3
var (
\tstock map[string]int
\t_     = 1
)

// Cart holds items.
type Cart struct {
\tItems, Sold []string `json:"items"`
\towner *User
}

type Store interface { Get(id string) error }

// Add puts an item in.
// It may fail.
func (c *Cart) Add(name string, a, b int, opts ...fmt.Stringer) (int, error) {
\tif name == "}" { return 0, nil } // }
\treturn 1, nil
}

func plain() {}
"""


def test_go_declarations():
    got = list(gosrc.declarations("shop/cart.go", GO))
    by = {(r[1], r[2]): dict(zip(gosrc.COLUMNS, r)) for r in got}
    add = by["Method", "Add"]
    assert add["signature"] == "Add(name string, a int, b int, opts unknown) int" and add["receiver"] == "*Cart" and add["docstring"] == "Add puts an item in. It may fail."
    assert GO[add["start_byte"] : add["end_byte"]].startswith(b"func (c *Cart) Add") and GO[add["start_byte"] : add["end_byte"]].endswith(b"}")
    assert add["end_line"] - add["start_line"] + 1 == add["lines_of_code"] == 4
    assert by["Function", "plain"]["signature"] == "plain()" and not by["Function", "plain"]["is_exported"]
    assert ("Class", "Cart") in by and ("Interface", "Store") in by and ("Variable", "Items") in by and ("Variable", "Sold") in by and ("Variable", "stock") in by and ("Variable", "limit") in by
    assert ("Variable", "_") not in by and by["Parameter", "b"]["position"] == 2
    assert list(gosrc.declarations("x.go", b"")) == [] and list(gosrc.declarations("x.go", b"func broken(")) == []


def test_go_groups_and_lists():
    """Every name of a value, grouped types, line ends of either kind; the offsets are those of the bytes."""
    src = "\ufeffpackage p\n\nvar x, y int\nvar (\n\ta, b = 1, 2\n\tc map[string]int // says\n)\nconst (\n\tP, Q = 1, 2\n\tR\n)\n\n// Not these.\ntype (\n\tFoo struct {\n\t\tK, L string\n\t\tBase\n\t}\n\n\tBär interface{}\n)\n\ntype Bar struct {\n\t*Foo\n\tM int\n}\n"
    for text in (src, src.replace("\n", "\r\n")):
        raw = text.encode()
        rows = [dict(zip(gosrc.COLUMNS, r)) for r in gosrc.declarations("p.go", raw)]
        assert {r["name"] for r in rows if r["label"] == "Variable"} == {"x", "y", "a", "b", "c", "P", "Q", "R", "K", "L", "M"}
        assert {(r["label"], r["name"]) for r in rows if r["label"] in ("Class", "Interface")} == {("Class", "Foo"), ("Class", "Bar"), ("Interface", "Bär")}
        by = {r["name"]: r for r in rows}
        assert by["K"]["fqn"] == "p.Foo.K" and by["M"]["fqn"] == "p.Bar.M" and by["x"]["signature"] == "int" and by["c"]["signature"] == "map[string]int"
        assert raw[by["Foo"]["start_byte"] : by["Foo"]["end_byte"]].startswith(b"Foo struct {") and raw[by["Bär"]["start_byte"] : by["Bär"]["end_byte"]] == "Bär interface{}".encode()
        assert raw[by["Bar"]["start_byte"] :].startswith(b"type Bar struct")
    import time

    began = time.perf_counter()
    list(gosrc.declarations("p.go", ("package p\n" + "var (\n" * 20_000).encode())), list(gosrc.declarations("p.go", ("package p\n" + "// x\n" * 20_000 + "func f() {}\n" * 3000).encode()))
    assert time.perf_counter() - began < 6


def test_trees(spark, tmp_path):
    for name, body in {"a.go": b"package a", "b_test.go": b"package a", "vendor/c.go": b"package c", "docs/READ.MD": b"# T", "docs/x.bin": b"\x01"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    assert [r.path for r in files.go_sources(spark, str(tmp_path)).collect()] == ["a.go"]
    assert [(r.path, r.text) for r in files.documents(spark, str(tmp_path)).collect()] == [("docs/READ.MD", "# T")]
    got = gosrc.extract(files.go_sources(spark, str(tmp_path)))
    assert [(r.label, r.name) for r in got.collect()] == [("Module", "a")] and gosrc.edges(got).count() == 0


def test_extract_agrees_with_the_function_table(spark, data):
    """Names, first lines and byte ranges of Go functions are those of the given table."""
    go = spark.read.parquet(f"{data}/code_sources.parquet").filter("path like '%.go'")
    found = gosrc.extract(go).filter("label in ('Function', 'Method')").select("file_path", "name", "start_line", "start_byte", "end_byte")
    given = spark.read.parquet(f"{data}/code_functions.parquet").filter("file_path like '%.go' and start_byte is not null").selectExpr("file_path", "name", "start_line", "cast(start_byte as long) start_byte", "cast(end_byte as long) end_byte").distinct().join(go.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    want = {(r.file_path, r.name, r.start_line) for r in given.collect()}
    have = {(r.file_path, r.name, r.start_line) for r in found.collect()}
    assert len(want & have) >= 0.98 * len(want)

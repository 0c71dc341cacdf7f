from pyspark.sql import functions as F

from symloom.functions import source, text
from symloom.functions import symbols as sym


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()[0]


def test_symbols(spark):
    s = ("string", "scip-go go order v1 pkg/T#M().  end")
    parsed = one(spark, sym.parse_symbol(F.col("s")), s=s)
    assert parsed.package == "order" and parsed.descriptor == "pkg/T#M().  end"
    assert one(spark, sym.parse_symbol(F.col("s")), s=("string", "local 3")) is None
    assert one(spark, sym.display_name(F.col("s")), s=("string", "local 3")) == "local 3"
    assert one(spark, sym.display_name(F.col("s")), s=("string", "a b c d pkg/T#M()")) == "M"
    assert one(spark, sym.display_name(F.col("s")), s=("string", "a b c d pkg/f().")) == "f()."
    kinds = {"a#b().": "Method", "b().": "Function", "b#": "Type", "a/": "Package", "x": "Variable"}
    for k, v in kinds.items():
        assert one(spark, sym.infer_kind(F.col("s")), s=("string", k)) == v
    three = one(spark, sym.range_parts(F.col("r")), r=("array<int>", [4, 2, 9]))
    assert (three.start_line, three.start_column, three.end_line, three.end_column) == (5, 2, 5, 9)
    assert one(spark, sym.range_parts(F.col("r")), r=("array<int>", [4])) is None
    assert one(spark, sym.labels_kind(F.col("r")), r=("array<string>", ["Function", "Method"])) == "Method"
    assert one(spark, sym.labels_kind(F.col("r")), r=("array<string>", [])) == "Unknown"
    paths = {"a/b.go": True, "a/b_test.go": False, "vendor/x.go": False, "a/bin/x.go": False, "bin.go": True, "x.py": False}
    for k, v in paths.items():
        assert one(spark, sym.is_go_source(F.col("s")), s=("string", k)) is v


def test_chunks(spark):
    p = lambda n: " ".join(["w"] * n)
    cases = [("", 0), (p(1200), 1), (p(600) + "\n\n" + p(600), 2), (p(600) + "\n\n" + p(400), 1), ("\n\n  \n\n", 0), ("a\n\n\n\nb", 1)]
    for value, n in cases:
        assert len(one(spark, text.chunks(F.col("s")), s=("string", value))) == n


def test_titles(spark):
    cases = {"x\n# My title \n# two": "My title", "short\n**A line of text**\n": "A line of text", "": "Untitled Document", "# a\r\nb": "a", "##no\nabc": "Untitled Document"}
    for k, v in cases.items():
        assert one(spark, text.title(F.col("s")), s=("string", k)) == v


def test_features_merge(spark):
    docs = spark.createDataFrame(
        [(1, "# Payments\n\nThe service must Support Refunds. It implements SUPPORT  refunds for all.\n\n## Overview\n\n### payments", "x/rfc-1.md"), (2, None, None), (3, "", None)],
        "doc_id long, text string, source_url string",
    )
    got = {r.key: r for r in text.merge_features(text.features(docs)).collect()}
    assert got["payments"].name == "Payments" and got["payments"].description == "Section: Payments" and list(got["payments"].tags) == ["section", "documentation"]
    assert "support refunds" in got and "overview" not in got
    assert list(got["support refunds"].tags) == ["requirement", "rfc"]


def test_code_tokens(spark):
    got = one(spark, text.code_tokens(F.col("s")), s=("string", "`BuildTable` and `the`, `a_b.C()` then `BuildTable`, `lower`, `Get`"))
    assert got == ["BuildTable", "a_b.C()"]


def test_slices(spark):
    body = "é1\nzwei\ndrei".encode()
    assert one(spark, source.byte_slice(F.col("c"), F.lit(4), F.lit(8)), c=("binary", body)) == "zwei"
    assert one(spark, source.byte_slice(F.col("c"), F.lit(1), F.lit(3)), c=("binary", body)) is None
    assert one(spark, source.byte_slice(F.col("c"), F.lit(0), F.lit(99)), c=("binary", body)) is None
    assert one(spark, source.byte_slice(F.col("c"), F.lit(5), F.lit(4)), c=("binary", body)) is None
    assert one(spark, source.line_slice(F.col("s"), F.lit(2), F.lit(9)), s=("string", body.decode())) == "zwei\ndrei"
    assert one(spark, source.line_slice(F.col("s"), F.lit(0), F.lit(1)), s=("string", body.decode())) is None
    assert one(spark, source.offset_of(F.col("s"), F.lit(2), F.lit(1)), s=("string", body.decode())) == 5


def test_slicing_a_table(spark):
    src = spark.createDataFrame([("f", bytearray(b"ab\ncd\nef")), ("f", bytearray(b"ab\ncd\nef"))], "path string, content binary")
    fns = spark.createDataFrame([("1", "f", 3, 5, 1, 1), ("2", "f", None, None, 2, 3), ("3", "f", 0, 99, 1, 1), ("4", "gone", 0, 1, 1, 1), ("5", None, 0, 1, 1, 1)], "id string, file_path string, start_byte long, end_byte long, start_line long, end_line long")
    assert {r.id: r.code for r in source.sliced(fns, src).collect()} == {"1": "cd", "2": "cd\nef", "3": "ab", "4": None, "5": None}

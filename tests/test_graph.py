"""Patterns and traversals on a small graph with a diamond, parallel edges, a circle and nulls."""

import pytest
from pyspark.sql import functions as F

from symloom.operators import pattern, scan, traverse, upsert

CALLS = [("e13", "fn1", "fn2"), ("e14", "fn1", "fn2"), ("e15", "fn2", "fn3"), ("e16", "fn3", "fn1"), ("e17", "fn3", "fn5")]
HOLDS = [("e1", "s1", "f1"), ("e2", "s1", "f2"), ("e3", "f1", "fn1"), ("e4", "f1", "fn2"), ("e5", "f2", "fn3"), ("e6", "f2", "c1"), ("e7", "c1", "fn3"), ("e8", "f1", "r1"), ("e9", "f2", "r2"), ("e10", "f2", "r3"), ("e11", "fn3", "p2"), ("e12", "fn1", "p1")]
FLOWS = [("e21", "p1", "v1"), ("e22", "v1", "p2"), ("e23", "p1", "p2")]


def edges(spark, rows):
    return spark.createDataFrame(rows, "id string, src string, dst string")


def seed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def test_reachable(spark):
    got = {(r.node, r.depth) for r in traverse.reachable(edges(spark, CALLS), seed(spark, "fn1"), 1, 10).collect()}
    assert got == {("fn2", 1), ("fn3", 2), ("fn1", 3), ("fn5", 3)}
    back = {(r.node, r.depth) for r in traverse.reachable(edges(spark, CALLS), seed(spark, "fn5"), 1, 2, "in").collect()}
    assert back == {("fn3", 1), ("fn2", 2)}
    assert traverse.reachable(edges(spark, CALLS), seed(spark, "no", None), 1, 3).count() == 0


def test_trails(spark):
    got = traverse.trails(edges(spark, CALLS), seed(spark, "fn1"), 1, 10).collect()
    by_length = {}
    for r in got:
        by_length.setdefault((r.node_ids[-1], r.depth), 0)
        by_length[r.node_ids[-1], r.depth] += 1
    assert by_length == {("fn2", 1): 2, ("fn3", 2): 2, ("fn1", 3): 2, ("fn5", 3): 2, ("fn2", 4): 2, }
    assert len(got) == 10
    assert all(len(set(r.edge_ids)) == len(r.edge_ids) for r in got)
    held = traverse.trails(edges(spark, HOLDS), seed(spark, "s1")).collect()
    ends = sorted(r.node_ids[-1] for r in held)
    assert ends.count("fn3") == 2 and ends.count("p2") == 2 and ends.count("fn1") == 1
    ways = {">".join(r.node_ids) for r in traverse.trails(edges(spark, FLOWS), seed(spark, "p1"), 1, 15).collect()}
    assert ways == {"p1>v1", "p1>p2", "p1>v1>p2"}
    with pytest.raises(ValueError):
        traverse.trails(edges(spark, HOLDS), seed(spark, "s1"), 1, None, "out", 1)


def test_expand_and_without(spark):
    start = spark.createDataFrame([("fn1",), ("fn5",), (None,)], "id string")
    got = sorted(r.far for r in pattern.expand(start, edges(spark, CALLS), "id", "far").collect())
    assert got == ["fn2", "fn2"]
    none = [r.id for r in pattern.without(start.filter("id is not null"), edges(spark, CALLS), "id").collect()]
    assert none == ["fn5"]
    far = spark.createDataFrame([("other",)], "id string")
    assert pattern.without(start.filter("id is not null"), edges(spark, CALLS), "id", far).count() == 2


def test_mentions_of_any_length(spark):
    tokens = spark.createDataFrame([("A",), ("Ab",), ("Abc",), ("zzz",), ("",), (None,), ("Abc",)], "token string")
    names = spark.createDataFrame([("1", "xAbcy", None), ("2", "Ab", "q"), ("3", "q", "Abcd"), ("4", None, None), ("5", "A", None), ("6", None, "zA")], "id string, text string, alt string")
    got = {}
    for r in pattern.mentions(tokens, names, 5).collect():
        got.setdefault(r.token, set()).add(r.id)
    assert got == {"A": {"1", "2", "3", "5", "6"}, "Ab": {"1", "2", "3"}, "Abc": {"1", "3"}}


def test_search_is_three_valued_and_ranked(spark):
    nodes = spark.createDataFrame(
        [("1", "Function", "Process", None), ("2", "Symbol", None, "x process"), ("3", "Method", None, "process"), ("4", "File", None, None), ("5", "Class", "processor", None)],
        "id string, label string, name string, symbol string",
    ).selectExpr("*", "null as display_name", "null as signature", "null as path")
    assert [r.id for r in scan.search(nodes, "PROCESS").collect()] == ["1", "3", "5", "2"]
    assert [r.id for r in scan.search(nodes, "", ("File", "Class")).collect()] == ["5"]
    assert len(scan.search(nodes, "process", (), 2).collect()) == 2


def test_merge_semantics(spark):
    nodes = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("b", "y2", 3), (None, "n", 9)], "k string, p string, q int")
    batch = spark.createDataFrame(
        [("a", 1, "new", None, True, False), ("b", 1, None, 7, True, True), ("c", 1, "c1", None, True, False), ("c", 2, "c2", 5, True, True), ("c", 3, None, None, False, False)],
        "k string, o int, p string, q int, has_p boolean, has_q boolean",
    )
    got = sorted(((r.k, r.p, r.q) for r in upsert.merge(nodes, batch, ["k"], "o", ["p", "q"]).collect()), key=str)
    assert got == sorted([("a", "new", 1), ("b", None, 7), ("b", None, 7), ("c", "c2", 5), (None, "n", 9)], key=str)
    kept = {(r.k, r.p, r.q) for r in upsert.merge(nodes, batch, ["k"], "o", ["p", "q"], True).collect()}
    assert kept == {("a", "x", 1), ("b", "y", 2), ("b", "y2", 3), ("c", "c2", 5), (None, "n", 9)}


def test_edges_and_delete(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    some = spark.createDataFrame([("1", "T", "a", "b"), ("2", "T", "a", "zz"), ("3", "T", "yy", "b"), ("4", "T", "xx", "zz"), ("5", "T", "a", "b")], "id string, type string, src string, dst string")
    good, bad = upsert.create_edges(some, nodes)
    assert {r.id for r in good.collect()} == {"1", "5"} and {r.id for r in bad.collect()} == {"2", "3", "4"} and bad.count() == 3
    assert {r.id for r in upsert.distinct_edges(good).collect()} == {"1"}
    left, rest = upsert.detach_delete(nodes, good, spark.createDataFrame([("b",), ("b",)], "id string"))
    assert {r.id for r in left.collect()} == {"a", "c"} and rest.count() == 0


def test_replace(spark):
    nodes = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("b", "y2", 3), (None, "n", 9)], "k string, p string, q int")
    batch = spark.createDataFrame([("a", 1, "old", 5, True, True), ("a", 2, "new", None, True, False), ("b", 1, None, 7, False, True), ("c", 1, "c1", 4, True, True), (None, 1, "z", 1, True, True)], "k string, o int, p string, q int, has_p boolean, has_q boolean")
    got = sorted(((r.k, r.p, r.q) for r in upsert.replace(nodes, batch, ["k"], "o", ["p", "q"]).collect()), key=str)
    assert got == sorted([("a", "new", None), ("b", None, 7), ("b", None, 7), ("c", "c1", 4), (None, "n", 9), (None, "z", 1)], key=str)
    assert upsert.replace(nodes.limit(0), batch.limit(0), ["k"], "o", ["p", "q"]).count() == 0


def test_call_edges_tell_circles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "d"), ("d", "e"), ("e", "f"), (None, "a"), ("a", None), ("x", "y"), ("a", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",), (None,)], "seed string")
    got = {(r.seed, r.src, r.dst, r.recursive) for r in traverse.call_edges(calls.filter("src is not null and dst is not null"), seeds, 4).collect()}
    assert got == {("a", "a", "b", False), ("a", "b", "c", True), ("a", "c", "b", True), ("a", "c", "d", False), ("a", "d", "d", True), ("a", "d", "e", False), ("x", "x", "y", False)}
    assert traverse.call_edges(calls.limit(0), seeds, 4).count() == 0


def test_first_of_each_key(spark):
    rows = spark.createDataFrame([("k", i % 7, i) for i in range(40)] + [("l", None, 1), ("l", 1, 2)], "key string, a int, b int")
    got = pattern.first_of(rows, "key", [F.col("a").asc_nulls_last(), "b"], 3).collect()
    assert {(r.key, r.a, r.b) for r in got} == {("k", 0, 0), ("k", 0, 7), ("k", 0, 14), ("l", 1, 2), ("l", None, 1)}

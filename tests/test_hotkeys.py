from pyspark.sql import functions as F

from symloom.operators import hotkeys

SCHEMA = "id string, k string, v int, newest int, _best string, n long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_heavy_counts_ids_once_and_nulls_in_the_total(spark):
    data = [(f"a{i}", "hot", i, 1, "x", 0) for i in range(6)] * 3 + [(f"b{i}", f"k{i}", i, 1, None, 0) for i in range(10)] + [(f"c{i}", None, 0, 1, None, 0) for i in range(4)] + [(None, "hot", 0, 1, None, 0)] * 50
    got = {tuple(r) for r in hotkeys.heavy_keys(rows(spark, data), "id", "k", 0.3, "t.k", "newest").collect()}
    assert got == {("t.k", "hot")}
    exactly = {r[1] for r in hotkeys.heavy_keys(rows(spark, data), "id", "k", 0.05, "t.k").collect()}
    assert exactly == {"hot"} | {f"k{i}" for i in range(10)}  # one in twenty is at least 5 %


def test_empty_table(spark):
    assert hotkeys.heavy_keys(rows(spark, []), "id", "k", 0.02, "t.k").count() == 0
    assert hotkeys.per_key(rows(spark, []), "k", {"m": F.count("*")}, ["v"]).count() == 0


def test_newest_row_of_an_id_wins_and_ties_are_settled(spark):
    data = [("a", "old", 1, 1, None, 0), ("a", "new", 2, 5, None, 0), ("b", "x", 1, None, None, 0), ("b", "y", 1, 0, None, 0), ("c", "p", 1, 3, None, 0), ("c", "q", 1, 3, None, 0)]
    got = {r.id: r.k for r in hotkeys.records(rows(spark, data), "id", ["k"], "newest").collect()}
    assert got == {"a": "new", "b": "y", "c": "q"}


def test_per_key_with_distinct(spark):
    data = [(str(i), "hot" if i % 3 else "cold", i % 4 or None, 1, "c", 0) for i in range(60)] + [("x", None, 1, 1, None, 0)]
    got = {r.k: (r.m, r.n_distinct_v) for r in hotkeys.per_key(rows(spark, data), "k", {"m": F.count("*")}, ["v"]).collect()}
    assert got == {"hot": (40, 3), "cold": (20, 3)}

"""Streams, the service, the catalog and the layout of a stored graph."""

import json

import pytest

from symloom import model
from symloom.plans.star import Star
from symloom.service import Service
from symloom.streaming import ingest


def test_upsert_stream_applies_each_batch_once(spark, tmp_path):
    schema = "id string, v int, at int"
    inbox, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).coalesce(1).write.parquet(inbox)
    run = lambda: ingest.upsert_stream(spark, spark.readStream.schema(schema).parquet(inbox), target, marks, ["id"], "at").awaitTermination()
    run()
    spark.createDataFrame([("a", 2, 2), ("c", 1, 0), (None, 5, 5)], schema).coalesce(1).write.mode("append").parquet(inbox)
    run()
    run()
    held = ingest.VersionedTable(spark, target)
    assert {(r.id, r.v) for r in held.read().collect()} == {("a", 2), ("b", 1), ("c", 1)} and held.current() == 1
    ingest.upsert_batch(held, spark.createDataFrame([("a", 99, 99)], schema), 1, ["id"], "at")
    assert {(r.id, r.v) for r in held.read().collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_windowed_counts(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'click' event_type, 1.0D value union all select timestamp'2024-01-01 00:50:00', 'click', 2.0D union all select timestamp'2024-01-01 09:00:00', 'view', 1.0D").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("windows").collect()} == {("click", 2, 3.0), ("view", 1, 1.0)}


def test_service(spark, data):
    s = Service(spark, data)
    ask = lambda **x: s.handle(json.dumps({"jsonrpc": "2.0", "id": 1} | x))
    assert ask(method="initialize")["result"]["name"] == "symloom"
    assert {t["name"] for t in ask(method="tools/list")["result"]["tools"]} == {"search", "source", "references", "overview", "analyze", "impact", "status"}
    hits = ask(method="tools/call", params={"name": "search", "arguments": {"term": "ring", "labels": ["Function"], "limit": 3}})["result"]
    assert 0 < len(hits) <= 3 and all("ring" in h["shown_name"].lower() or "ring" in h["signature"].lower() for h in hits)
    assert ask(method="tools/call", params={"name": "overview", "arguments": {"id": hits[0]["id"]}})["result"]["id"] == hits[0]["id"]
    assert s.handle("{")["error"]["code"] == -32700 and ask(method="x")["error"]["code"] == -32601
    assert ask(method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert ask(method="tools/call", params={"name": "overview", "arguments": {"id": "nothing"}})["error"]["code"] == -32602
    assert ask(method="tools/call", params={"name": "search", "arguments": {"term": "no%such*name"}})["result"] == []
    assert s.handle("[]")["error"]["code"] == -32600
    every = ask(method="tools/call", params={"name": "search", "arguments": {"term": "a", "limit": 0}})["result"]
    assert len(every) > 50  # 0 is no limit
    whole = ask(method="tools/call", params={"name": "analyze", "arguments": {"name": hits[0]["shown_name"]}})["result"]
    assert whole["name"] == hits[0]["shown_name"] and len(whole["callers"]) <= 10 and len(whole["callees"]) <= 10 and whole["callers"]
    one = spark.read.parquet(f"{data}/code_functions.parquet").filter("start_byte >= 0 and end_byte > start_byte and signature is not null").orderBy("id").first()
    by_name = ask(method="tools/call", params={"name": "source", "arguments": {"name": one.name}})["result"]
    by_signature = ask(method="tools/call", params={"name": "source", "arguments": {"signature": one.signature}})["result"]
    assert any(r["code"] and one.name in r["code"] for r in by_name) and {r["signature"] for r in by_signature} == {one.signature}
    assert ask(method="tools/call", params={"name": "source", "arguments": {"name": "no such"}})["error"]["code"] == -32602
    assert ask(method="tools/call", params={"name": "source", "arguments": {}})["error"]["code"] == -32602


def test_command_line(spark, tmp_path):
    import io

    from symloom import cli

    root, store = tmp_path / "shop", str(tmp_path / "store")
    for name, body in {"a.go": b"package shop\n\n// Adds.\nfunc Add(a int) int {\n\treturn a\n}\n\ntype Cart struct {\n\tItems int\n}\n", "docs/feature.md": b"# Cart\n\nFeature: Cart handling\n"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(body)

    def said(*argv):
        out = io.StringIO()
        code = cli.run(spark, cli.parser().parse_args(["--store", store, *argv]), out)
        return code, [json.loads(x) for x in out.getvalue().splitlines()]

    assert said("index", "project", str(root), "--service", "shop")[0] == 0
    code, [counts] = said("index", "docs", str(root))
    assert code == 0 and said("index", "docs", str(root))[1] == [counts]  # indexed again, nothing is there twice
    assert {r["label"] for r in said("status")[1]} >= {"Service", "File", "Module", "Function", "Class", "Variable", "Parameter", "Symbol", "Document", "Feature"}
    assert {r["shown_name"] for r in said("query", "search", "add")[1]} >= {"Add"}
    assert [r["code"] for r in said("query", "source", "Add")[1]] == ["func Add(a int) int {\n\treturn a\n}"]
    assert [r["name"] for r in said("query", "source", "Add(a int) int", "--signature")[1]] == ["Add"] and said("query", "source", "None")[0] == 1
    assert len(said("schema", "create")[1]) == 25 and len(said("schema", "info")[1]) == 25
    assert said("schema", "drop")[1] == [] and len(said("schema", "info")[1]) == 25  # all are missing again


def test_rest(spark, data):
    import threading
    from urllib.request import urlopen

    from symloom import rest

    s = Service(spark, data)
    name = s.nodes("Function").orderBy("id").first().name
    code, info = rest.answer(s, f"/api/v1/functions/{name.replace(' ', '%20')}/info")
    assert code == 200 and info["name"] == name
    assert rest.answer(s, f"/api/v1/functions/{name.replace(' ', '%20')}/callers?limit=3")[1] == info["callers"][:3]
    assert rest.answer(s, "/api/v1/search?q=ring&limit=2")[0] == 200 and len(rest.answer(s, "/api/v1/search/functions?q=ring")[1]) > 2
    assert rest.answer(s, "/api/v1/functions/none/info")[0] == 404 and rest.answer(s, "/x")[0] == 404 and rest.answer(s, "/api/v1/search?limit=x")[0] == 400
    http = rest.server(s, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    with urlopen(f"http://127.0.0.1:{http.server_port}/api/v1/health") as r:
        assert json.load(r)["status"] == "ok"
    http.shutdown()


def test_index_graph(spark, tmp_path):
    from symloom.sources import project, scip
    from test_sources import index

    (tmp_path / "one.scip").write_bytes(index())
    tables = [scip.read(spark, str(tmp_path), t) for t in ("symbols", "occurrences", "metadata")]
    g = project.index_graph(*tables, "shop")
    labels = {r.label: r["count"] for r in g.nodes.groupBy("label").count().collect()}
    assert labels == {"Service": 1, "File": 1, "Symbol": 2, "Reference": 2}
    assert {r.type: r["count"] for r in g.edges.groupBy("type").count().collect()} == {"CONTAINS": 3, "REFERENCES": 2, "DEFINES": 1}
    assert scip.services(tables[2]).first().name == "r"


def test_paths_meet_in_one_form(spark):
    from symloom.functions import source

    f = spark.createDataFrame([("1", "/work/p/a/x.go", 0, 3, 1, 1), ("2", "./a/x.go", 0, 3, 1, 1), ("3", "a\\x.go", 0, 3, 1, 1), ("4", "/other/a/x.go", 0, 3, 1, 1), ("5", None, 0, 3, 1, 1)], "id string, file_path string, start_byte long, end_byte long, start_line long, end_line long")
    s = spark.createDataFrame([("a/x.go", bytearray(b"abcdef"))], "path string, content binary")
    assert {r.id: r.code for r in source.sliced(f, s, "/work/p").collect()} == {"1": "abc", "2": "abc", "3": "abc", "4": None, "5": None}


def test_catalog(spark):
    c = model.Catalog(spark)
    c.create_all()
    c.create_all()
    assert c.show().count() == 25 and c.show("UNIQUE").count() == 6 and c.missing().count() == 0
    c.drop("file_path_idx")
    assert [r.name for r in c.missing().collect()] == ["file_path_idx"]
    c.drop("file_path_idx", if_exists=True)
    with pytest.raises(ValueError):
        c.drop("file_path_idx")
    with pytest.raises(ValueError):
        c.create("symbol_unique", "UNIQUE", "Symbol", ("symbol",))


def test_catalog_is_stored(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    one = model.Catalog(spark, folder)
    one.create_all()
    one.drop("file_path_idx")
    other = model.Catalog(spark, folder)
    assert other.show().count() == 24 and [r.name for r in other.missing().collect()] == ["file_path_idx"]
    other.drop_all()
    assert model.Catalog(spark, folder).show().count() == 0


def test_constraints(spark, data):
    nodes = Star(spark, data).nodes("Symbol", "Function")
    assert model.violations(nodes, "Symbol", "symbol").count() == 0
    assert model.without_key(nodes, "Function", "name").count() == 0


def test_stored_graph_prunes_partitions(spark, data, tmp_path):
    g = Star(spark, data).graph()
    g.write(str(tmp_path))
    back = model.Graph.read(spark, str(tmp_path))
    assert back.nodes.count() == g.nodes.count() and back.edges.count() == g.edges.count()
    plan = back.rel("DEFINES")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "type" in plan.split("PartitionFilters")[1][:80]


def test_cuts_count_while_they_write(spark):
    from pyspark.sql import functions as F

    from symloom.session import Cuts

    cuts = Cuts(spark, "test")
    df = spark.range(100).withColumn("x", F.col("id") % 3 == 0)
    back, seen = cuts.measured(df, n=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"n": 100, "top": 99} and back.count() == 100
    (yes, no), (ended, rest) = cuts.split(df.withColumn("flag", F.when(F.col("id") < 90, F.col("x"))), "flag", "t")
    assert (yes, no) == (30, 70) and ended.count() == 30 and rest.count() == 70 and ended.columns == ["id", "x"]
    (yes, no), (ended, rest) = cuts.split(rest.withColumn("flag", F.col("id") == 1), "flag", "t")
    assert (yes, no) == (1, 69) and ended.count() == 31 and rest.count() == 69  # what ended before is still there
    (yes, no), (ended, rest) = cuts.split(rest.withColumn("flag", F.lit(False)).limit(0), "flag", "t")
    assert (yes, no) == (0, 0) and ended.count() == 31 and rest.count() == 0

import random

import numpy as np

from symloom.llm import provenance as p


def corpus(rng, n=260):
    """Files of five kinds in many repositories; a third of each kind shows no giveaway."""
    rows = []
    words = "order cart stock price ship route item user page table".split()
    for i in range(n):
        repo, w = f"repo{i % 40}", rng.choice(words)
        kind = ["hand", "hand", "hand", "generated", "minified", "vendored", "data"][i % 7]
        shown = rng.random() < 0.67
        path = f"{repo}/src/{w}_{rng.choice(words)}.go"
        if kind == "generated":
            text = "package x\n" + "".join(f"func (m *Msg) Get{rng.choice(words).title()}{j}() int64 {{\n\tif m != nil {{\n\t\treturn m.F{j}\n\t}}\n\treturn 0\n}}\n" for j in range(12))
            if shown:
                text = "// Code generated by weaver v1.2. DO NOT EDIT.\n" + text
        elif kind == "minified":
            text = "".join(f"function {rng.choice('abcdef')}(x,y){{return x.{rng.choice(words)}({j})}}var z=x?y:{j};" for j in range(60))
            path = f"{repo}/web/{w}.min.js" if shown else f"{repo}/web/{w}.js"
        elif kind == "vendored":
            text = "package y\n" + "".join(f"func {rng.choice(words)}All(src Reader) error {{\n\tsrc.mu.Lock()\n\tsrc.mu.Unlock()\n\treturn nil\n}}\n" for _ in range(9))
            path = f"{repo}/vendor/lib{i % 3}/{w}.go" if shown else f"{repo}/parts/{w}.go"
        elif kind == "data":
            text = "var d = []float64{\n" + "".join(f"\t{rng.random():.4f}, {rng.randint(0, 999)}, {rng.random():.3f},\n" for _ in range(60)) + "}\n"
        else:
            text = "// Generated files live elsewhere.\npackage z\n" + "".join(f"// {rng.choice(words)} waits for {rng.choice(words)}.\nfunc (e *Gate) {rng.choice(words)}(limit int) bool {{\n\tfor _, r := range e.{rng.choice(words)}s {{\n\t\ttotal += r.Size\n\t}}\n\treturn total > limit\n}}\n" for _ in range(7))
            if rng.random() < 0.2:
                path = f"{repo}/vendoring/generator_{w}.go"
        rows.append((f"id{i}", path, "/work/" + path, text.encode(), kind))
    return rows


def test_kinds_without_giveaways_are_found(spark):
    rows = corpus(random.Random(2))
    files = spark.createDataFrame([(i, q, a, "Go") for i, q, a, *_ in rows] + [(None, "x", None, None), ("null", None, None, None), ("gone", "repo1/vendor/q/gone.go", None, None), rows[0][:3] + ("Go",)], "id string, path string, absolute_path string, score string").selectExpr("*", "timestamp'2024-01-01' as updated_at")
    sources = spark.createDataFrame([(q, bytearray(t)) for _, q, _, t, _ in rows] + [(None, bytearray(b"x")), ("y", None), ("e", bytearray(b""))], "path string, content binary")
    got = {r.file_id: r.kind for r in p.classify(files, sources).collect()}
    assert len(got) == len(rows) + 2
    wrong = [(i, kind, got[i]) for i, _, _, _, kind in rows if (got[i] == "hand_written") != (kind == "hand")]
    assert len(wrong) <= 0.05 * len(rows), wrong
    assert got["gone"] == "vendored"
    assert p.classify(files.limit(0), sources.limit(0)).count() == 0


def test_giveaways():
    assert p.giveaways(b"// Code generated by x. DO NOT EDIT.\npackage a\n", "a/b.go", "") == {"generated"}
    assert p.giveaways(b"// The generated code lives elsewhere; this file feeds the generator.\npackage a\n", "a/b.go", "") == set()
    assert p.giveaways(b'package a\nconst banner = "// Code generated by %s. DO NOT EDIT."\n', "a/vendoring/generator.go", "") == set()
    assert p.giveaways(None, "a/node_modules/b/c.js", "") == {"vendored"} and p.giveaways(None, "a/x.pb.go", "") == {"generated"}
    assert p.giveaways(b"", "", "") == set()


def test_masks_and_paths():
    assert b"DO NOT EDIT" not in p.masked(b"\xef\xbb\xbf// Code generated by x. DO NOT EDIT.\npackage a1\n") and b"package a0" in p.masked(b"package a1\n")
    assert p.clean_path("./a\\b//./c.go") == "a/b/c.go" and p.clean_path(None) == ""


def test_long_files_are_summed_over_slices(monkeypatch):
    rng = np.random.default_rng(1)
    model = p.Model(rng.normal(size=(p.TEXT_DIMS + p.PATH_DIMS + 1, 4)).astype(np.float32), np.zeros(4, dtype=np.float32), {})
    text = bytes(rng.integers(32, 120, 50_000, dtype=np.uint8))
    whole = model.scores([text, b"abc", None, b""], [("a/b.go", "")] * 4)
    monkeypatch.setattr(p, "SLICE", 7_000)
    assert np.abs(model.scores([text, b"abc", None, b""], [("a/b.go", "")] * 4) - whole).max() < 2e-2


def test_patterns_take_time_in_proportion_to_a_line():
    import time

    lines = [b"1" * 10_000 + b"a", b'"a"' * 5000 + b"x", b"'" * 20_001, b"0123456789012345678901234567890123abcdef  file.txt\n" * 300, b"[(" * 9000 + b"q", b"1 " * 9000 + b"z", b"- " * 9000, b"const " * 5000 + b"=", b"code generated by " * 3000, b"// generated " * 3000, b'a="' * 5000, b" " * 20_000 + b"x", b"copied from " * 3000]
    for line in lines:
        began = time.perf_counter()
        p.literal_share(line), p.literal_share(line, True), p.masked(line), p.giveaways(line, "a/b.go", "")
        assert time.perf_counter() - began < 1, line[:20]


def test_literal_rows():
    for row in (b"1, 2, 3,", b'"a", "b"', b"{1, 2}, {3, 4},", b"[0x1F, -2.5e3];"):
        assert p.literal_share(row) == 1
    for row in (b'"AD": "Andorra",', b"'a' => 1,", b"const T = [1, 2, 3];", b"var x = []float64{1, 2}", b"static const int T[] = {1, 2};"):
        assert p.literal_share(row) == 0 and p.literal_share(row, True) == 1
    for row in (b"foo(1)", b"x = 5", b"return x", b"", b"{ }", b"a, b"):
        assert p.literal_share(row, True) == 0


def test_heads_and_lines_of_any_length():
    licence = b"// a line of a licence\n" * 200
    assert p.giveaways(licence + b"// Code generated by x. DO NOT EDIT.\npackage a\n", "a/b.go", "") == {"generated"}
    assert p.masked(licence + b"// Code generated by x. DO NOT EDIT.\npackage a\n") == b"package a\n"
    assert b"DO NOT EDIT" not in p.masked(b"a();" * 300 + b"/* DO NOT EDIT */" + b"b();" * 300) and b"b();" in p.masked(b"a();" * 300 + b"/* DO NOT EDIT */b();")
    for line in (b"// Generated from a.idl", b"# <auto-generated/>", b"/* @generated */", b"// AUTOGENERATED FILE.", b"// This file was automatically generated on 2020-01-01", b"// Produced by the x compiler"):
        assert p.giveaways(line + b"\nx\n", "a/b.go", "") == {"generated"}, line
    for line in (b"// Walks the generated files below x.", b"// The generator reads this file.", b"// Copies from one to another."):
        assert p.giveaways(line + b"\nx\n", "a/b.go", "") == set(), line


def test_a_model_is_stored(tmp_path):
    rng = np.random.default_rng(3)
    model = p.Model(rng.normal(size=(p.TEXT_DIMS + p.PATH_DIMS + 1, 4)).astype(np.float32), np.arange(4, dtype=np.float32), {k: 0.5 for k in p.KINDS})
    model.save(str(tmp_path / "m.npz"))
    back = p.Model.load(str(tmp_path / "m.npz"))
    assert (back.weights == model.weights).all() and (back.threshold == model.threshold).all() and back.held_out_f1 == model.held_out_f1

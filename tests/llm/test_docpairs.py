import itertools
import random

import numpy as np
import pytest

from symloom.llm import docpairs as d

SAYS = [
    ("Idempotent.", "walk_batch"),
    ("Never returns nil.", "Get"),
    ("/**\n * Walks the tree twice.\n * @param opts the opts to use\n */", "scan"),
    ("//nolint:errcheck\nCosts are linear in the number of entries.", "scan"),
    ("-----\nCallers must close the returned lease.\n-----", "scan"),
    ("TODO: Falls back to the old copy.", "scan"),
    ("Gibt den Puffer frei, sobald kein Schreiber mehr übrig ist.", "release"),
    ("```go\nfunc X()\n```\n\nBlocks until drained.", "X"),
    ("@param timeout seconds to wait before giving up, zero means forever", "poll"),
    ("Counts rows.\n\nDeprecated: kept for old callers.", "scan"),
]
SAYS_NOT = [
    (None, "x"), ("", "x"), (" \n\t", "x"), ("PruneRoster", "PruneRoster"), ("pruneRoster.", "pruneRoster"), ("Prune roster.", "prune_roster"), ("The prune roster method.", "pruneRoster"), ("pruneRoster function", "pruneRoster"),
    ("TODO", "x"), ("// TODO: document", "x"), ("FIXME write docs", "x"), ("XXX", "x"), ("n/a", "x"), ("...", "x"), ("-----------", "x"), ("=== walk token ===", "walkToken"), ("//nolint:gocyclo", "x"), ("go:noinline", "x"),
    ("@param opts\n@return", "x"), ("/** */", "x"), ("//", "x"), ("{@inheritDoc}", "x"), ("Deprecated.", "x"), ("undocumented", "x"), ("Copyright (c) 2020 Some Works. All rights reserved.", "x"),
    ("// x := next(cur)\n// return x", "walk"), ("```py\ndef f(a)\n```", "f"), ("/**\n * @param opts the opts to use\n */", "f"),
]


@pytest.mark.parametrize("text,name", SAYS)
def test_says(text, name):
    assert d.statement(text, name, f"func {name}()")


@pytest.mark.parametrize("text,name", SAYS_NOT)
def test_says_nothing(text, name):
    assert d.statement(text, name, f"func {name}()") == ""


def test_long_text():
    assert d.statement("Keeps the rows sorted. " * 20_000, "f", "") and d.statement("-" * 500_000, "f", "") == ""


def test_assignment_is_the_best_one():
    rng = random.Random(3)
    for _ in range(60):
        rows, columns = rng.randint(1, 5), rng.randint(1, 5)
        w = np.array([[rng.choice([0, 0, 1, 2, 3.5, 7]) for _ in range(columns)] for _ in range(rows)], dtype=float)
        got = [(r, c) for r, c, _ in d.assign([(r, c, w[r, c]) for r in range(rows) for c in range(columns)])]
        assert len({r for r, _ in got}) == len(got) == len({c for _, c in got})
        small, large = (rows, columns) if rows <= columns else (columns, rows)
        m = w if rows <= columns else w.T
        best = max(sum(max(0, m[i, p[i]]) for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(sum(w[r, c] for r, c in got) - best) < 1e-9 and all(w[r, c] > 0 for r, c in got)


def test_many_functions_on_one_line():
    """A minified file: the work depends on the smaller side, not on the product."""
    import time

    fs = [("x.js", f"f{i}", f"f{i}", f"f{i}(a)", 3, 3, None, None, None) for i in range(3000)]
    own = [("x.js", None, None, None, 3, 3, f"Keeps the rows of {i} sorted.", "docstring", f"f{i}") for i in range(0, 3000, 2)]
    comments = [("x.js", None, None, None, i, i, f"// f{2 * i + 1} waits for nobody in row {i}.", "comment", None) for i in range(3)]
    began = time.perf_counter()
    got = {fs[f][1]: (own + comments)[t][7] for f, t, _, _ in d.match_segment(fs, own + comments)}
    assert time.perf_counter() - began < 2
    assert len(got) == 1500 + 3 and all(got[f] == "comment" for f in ("f1", "f3", "f5"))  # by the names in them


def test_notices_are_clauses():
    for text in ("Version: increments on each write so readers can detect races.", "Deprecated: use the v2 client, which retries twice.", "See license server for seat counts before opening a session.", "All rights reserved seats are released after ten minutes."):
        assert d.statement(text, "f", "func f()"), text
    for text in ("Version: 1.2.3", "Since: v2", "Deprecated: kept for old callers.", "Deprecated: use pkg.Client instead.", "See the LICENSE file for details.", "All rights reserved.", "(c) 2020 Some Works, all rights reserved.", "Author: Jo Doe", "Generated by x 1.2."):
        assert d.statement(text, "f", "func f()") == "", text


F_SCHEMA = "id string, labels array<string>, name string, signature string, file_path string, start_line long, end_line long, start_byte long, end_byte long, docstring string, updated_at timestamp, text string, source string, owner string, kind int"
S_SCHEMA = "id string, symbol string, display_name string, documentation string, created_at timestamp"


def function(i, name, path, line, doc, a=None, b=None):
    return (i, ["Function"], name, f"func {name}(a int)", path, line, line and line + 2, a, b, doc, None, "t", "s", "o", 1)


def test_table(spark):
    src = b"package x\n// Puts things back in order.\nfunc sortAll(a int) {\n}\n\n// Other speaks of another function.\n\n\n\n\n\nfunc bare(a int) {\n}\n"
    fs = [
        function("f1", "sortAll", "x.go", 3, None, src.index(b"func sortAll"), src.index(b"func sortAll") + 24),
        function("f2", "bare", "x.go", 12, None),
        function("f3", "own", None, None, "Holds the lock while it runs."),
        function("f4", "named", "gone.go", 5, "named", 0, 5),
        function("f5", "linked", "x.go", 12, "TODO"),
        function("f5", "linked", "x.go", 12, "TODO"),
        function(None, "ghost", "x.go", 1, "Says something useful."),
    ]
    symbols = [("s1", "s", "linked", "```go\nf()\n```\nReads once, then forgets.", None), ("s1", "s", "linked", "```go\nf()\n```\nReads once, then forgets.", None), ("s2", "s", "named", None, None), (None, "s", "x", "Lost words here.", None)]
    links = [("f5", "s1"), ("f5", "s1"), ("f4", "s2"), ("f4", "nowhere"), (None, "s1"), ("f3", None)]
    functions, syms = spark.createDataFrame(fs, F_SCHEMA), spark.createDataFrame(symbols, S_SCHEMA)
    defines = spark.createDataFrame(links, "start_id string, end_id string")
    sources = spark.createDataFrame([("x.go", bytearray(src)), ("x.go", bytearray(src)), (None, bytearray(b"z")), ("empty.go", bytearray(b"")), ("null.go", None)], "path string, content binary")
    found = {r.function_id: r.source for r in d.describe(functions, syms, defines).collect()}
    assert found == {"f3": "docstring", "f5": "symbol"}
    more = {r.function_id: (r.source, r.description) for r in d.describe(functions, syms, defines, sources).collect()}
    assert more["f1"] == ("comment", "Puts things back in order.") and "f2" not in more and len(more) == 3
    code = {r.function_id: r.code for r in d.pairs(functions, syms, defines, sources).collect()}
    assert code["f1"] == "func sortAll(a int) {\n}\n"[:24] and code["f5"].startswith("func bare") and "f3" not in code
    empty = d.describe(functions.limit(0), syms.limit(0), defines.limit(0), sources.limit(0))
    assert empty.count() == 0


def test_segments_do_not_lose_functions(spark):
    """One file with thousands of functions is matched in pieces, and nothing is lost at their borders."""
    n = 3000
    text = "".join(f"// Step {i} waits for nobody.\nfunc f{i}(a int) {{}}\n" for i in range(n)).encode()
    fs = [function(f"f{i}", f"f{i}", "big.go", 2 * i + 2, None) for i in range(n)]
    none = spark.createDataFrame([], S_SCHEMA)
    got = d.describe(spark.createDataFrame(fs, F_SCHEMA), none, spark.createDataFrame([], "start_id string, end_id string"), spark.createDataFrame([("big.go", bytearray(text))], "path string, content binary"))
    rows = got.collect()
    assert len(rows) == n and all(f"Step {r.function_id[1:]} waits" in r.description for r in rows)


def test_borders_of_segments(spark):
    """Functions and comments on all places around a border: each is paired as if there were none."""
    n = d.SEGMENT
    fs, lines = [], [""] * (3 * n + 40)
    for k in (1, 2, 3):
        for shift in range(-30, 30, 5):
            at = k * n + shift
            lines[at - 1] = f"def f{k}_{shift + 30}(a):"
            if (shift // 5) % 2:
                lines[at], lines[at + 1] = '    """Waits for nobody,', f'    of {k} and {shift}."""'
            else:
                lines[at - 3], lines[at - 2] = "# Keeps the rows,", f"# of {k} and {shift}."
            fs.append(function(f"f{k}_{shift + 30}", f"f{k}_{shift + 30}", "b.py", at, None))
    none = spark.createDataFrame([], S_SCHEMA)
    got = d.describe(spark.createDataFrame(fs, F_SCHEMA), none, spark.createDataFrame([], "start_id string, end_id string"), spark.createDataFrame([("b.py", bytearray("\n".join(lines).encode()))], "path string, content binary")).collect()
    assert {r.function_id for r in got} == {f[0] for f in fs} and len(got) == len(fs)
    for r in got:
        k, shift = r.function_id[1:].split("_")
        assert r.description.endswith(f"of {k} and {int(shift) - 30}.")


def test_comments_stand_in_for_lost_docstrings(spark, data):
    """Recall on comments: docstrings and links taken away, the comments in the sources must say the same."""
    from symloom.tables import table

    functions, symbols, defines, sources = (table(spark, data + "/../sf0.01", t) for t in ("code_functions", "code_symbols", "defines_rel", "code_sources"))
    said = {r.function_id: d._bare(r.description) for r in d.describe(functions, symbols, defines).filter("source = 'docstring'").collect()}
    blank = functions.withColumn("docstring", functions.docstring.substr(0, 0))
    again = {r.function_id: d._bare(r.description) for r in d.describe(blank, symbols.limit(0), defines.limit(0), sources).collect()}
    text = {r.path: d._bare(bytes(r.content).decode("utf-8", "replace")) for r in sources.filter("content is not null").collect()}
    where = {r.id: r.file_path for r in functions.filter("id is not null").collect()}
    there = [f for f, words in said.items() if words in text.get(where[f], "")]
    found = [f for f in there if again.get(f) == said[f]]
    print(len(said), len(there), len(found), len(again))
    assert len(there) > 300 and len(found) > 0.95 * len(there)


def test_one_content_of_a_path_counts(spark):
    contents = [b"// Waits for nobody.\nfunc f(a int) {}\n", b"// Keeps the rows sorted.\nfunc f(a int) {}\n", b"\nfunc f(a int) { g() }\n"]
    rows = spark.createDataFrame([("x.go", bytearray(c)) for c in contents], "path string, content binary")
    one = bytes(rows.selectExpr("max_by(content, xxhash64(content)) c").first().c)
    none = spark.createDataFrame([], S_SCHEMA)
    got = [(r.description, r.code) for r in d.pairs(spark.createDataFrame([function("f", "f", "x.go", 2, None)], F_SCHEMA), none, spark.createDataFrame([], "start_id string, end_id string"), rows).collect()]
    assert got == [(t[3:], one.decode().split("\n", 1)[1]) for t in [one.decode().split("\n")[0]] if t]


def test_odd_places(spark):
    """Lines below 1, empty and missing paths, no line: each function is paired once with its own text."""
    fs = [function(f"f{n}{p}", f"f{n}", p, line, "Waits for nobody.") for n, line in enumerate((-5, 0, 1, d.SEGMENT - 2, d.SEGMENT, d.SEGMENT + 3, 10**12, None)) for p in ("a.go", "", None)]
    none = spark.createDataFrame([], S_SCHEMA)
    links = spark.createDataFrame([], "start_id string, end_id string")
    sources = spark.createDataFrame([("a.go", bytearray(b"// Other words.\nfunc x() {}\n")), ("", bytearray(b"x"))], "path string, content binary")
    for texts in (None, sources):
        got = [(r.function_id, r.source) for r in d.describe(spark.createDataFrame(fs, F_SCHEMA), none, links, texts).collect()]
        assert sorted(got) == sorted((f[0], "docstring") for f in fs)

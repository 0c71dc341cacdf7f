"""Go files to declarations: packages, functions and methods, types with their fields, constants and variables.

One pass over each file's text with declaration patterns; only top-level declarations are read, so that
names inside function bodies are not taken for a package's own.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "file_path string, label string, name string, fqn string, signature string, return_type string, receiver string, package string, parent string, position int, "
    "start_line bigint, end_line bigint, start_byte bigint, end_byte bigint, lines_of_code bigint, is_exported boolean, docstring string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

_PACKAGE = re.compile(r"(?m)^package[ \t]+(\w+)")
_FUNC = re.compile(r"(?m)^func[ \t]*(?:\((?P<receiver>[^)]*)\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*\(")
_NAMES = r"[A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*"
_TYPE = re.compile(r"(?m)^type[ \t]+(?P<name>\w+)(?:\[[^\]\n]*\])?[ \t]+(?P<kind>struct|interface)[ \t]*\{")
_VALUE = re.compile(rf"(?m)^(?P<kind>const|var)[ \t]+(?P<names>{_NAMES})[ \t]*(?P<type>[^=\n]*?)[ \t\r]*(?:=|$)")
_BLOCK = re.compile(r"(?m)^(?P<kind>const|var|type)[ \t]*\([^\n]*\n")
_BLOCK_END = re.compile(r"(?m)^\)")
_ENTRY = re.compile(rf"(?m)^\t(?P<names>{_NAMES})[ \t]*(?P<type>[^=\n/]*?)[ \t\r]*(?:=|//|$)")
_TYPE_ENTRY = re.compile(r"(?m)^\t(?P<name>\w+)(?:\[[^\]\n]*\])?[ \t]+(?P<kind>struct|interface)[ \t]*\{")
# Fields of a struct, of one in a group; an embedded type has no name of its own and is no field here.
_FIELDS = {depth: re.compile(rf"(?m)^\t{{{depth}}}(?P<name>{_NAMES})[ \t]+(?P<type>[^\s`/][^`/\n\r]*)") for depth in (1, 2)}


def _closing(text: str, at: int, opens: str, closes: str) -> int:
    """Where the bracket that opens at `at` closes, strings, runes and comments left out; -1 if it doesn't."""
    depth = 0
    n = len(text)
    while at < n:
        c = text[at]
        if c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if not depth:
                return at
        elif c in "\"'":
            at += 1
            while at < n and text[at] != c and text[at] != "\n":
                at += 2 if text[at] == "\\" else 1
        elif c == "`":
            at = text.find("`", at + 1)
            if at < 0:
                return -1
        elif text.startswith("//", at):
            at = text.find("\n", at)
            if at < 0:
                return -1
            continue
        elif text.startswith("/*", at):
            at = text.find("*/", at)
            if at < 0:
                return -1
            at += 1
        at += 1
    return -1


def type_name(text: str) -> str:
    """A plain, pointer or package-qualified type name; 'unknown' for any other type."""
    text = text.strip()
    return text if re.fullmatch(r"\*?\w+|\w+\.\w+", text) else "unknown" if text else ""


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no bracket."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "([{"
        depth -= c in ")]}"
        if c == "," and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def parameters(text: str) -> list[tuple[str, str]]:
    """(name, type) of a parameter list; a name without a type takes the next one's."""
    out: list[tuple[str, str]] = []
    waiting: list[str] = []
    for part in _split(text):
        name, _, kind = part.partition(" ")
        if kind.strip():
            out += [(w, type_name(kind)) for w in waiting] + [(name, type_name(kind))]
            waiting = []
        else:
            waiting.append(name)
    return out or [("", type_name(w)) for w in waiting]


def _docstring(text: str, at: int) -> str:
    own: list[str] = []
    end = text.rfind("\n", 0, at)
    while end >= 0:
        begin = text.rfind("\n", 0, end) + 1
        line = text[begin:end].strip()
        if not line.startswith("//"):
            break
        own.append(line[2:].strip())
        end = begin - 1
    return " ".join(x for x in reversed(own) if x)


def declarations(path: str, content: bytes) -> Iterator[tuple]:
    text = content.decode("utf-8", "surrogateescape")
    shift = 1 if text.startswith("﻿") else 0
    body = text[shift:]
    start_of_lines = [0] + [m.end() for m in re.finditer("\n", body)]
    line = lambda at: bisect.bisect_right(start_of_lines, at)
    # Bytes before each line, so that an offset is counted over one line only.
    before = [shift * 3]
    for a, b in zip(start_of_lines, start_of_lines[1:]):
        before.append(before[-1] + len(body[a:b].encode("utf-8", "surrogateescape")))

    def byte(at: int) -> int:
        n = bisect.bisect_right(start_of_lines, at) - 1
        return before[n] + len(body[start_of_lines[n] : at].encode("utf-8", "surrogateescape"))

    m = _PACKAGE.search(body)
    package = m[1] if m else ""

    def row(label, name, first, last, signature=None, returns=None, receiver=None, parent=None, position=None, doc=None, fqn=None):
        a, b = line(first), line(max(first, last - 1))
        return (path, label, name, fqn or f"{package}.{name}", signature, returns, receiver, package, parent, position, a, b, byte(first), byte(last), b - a + 1, name[:1].isupper(), doc)

    if m:
        yield row("Module", package, m.start(), m.end(), fqn=package)
    for m in _FUNC.finditer(body):
        closing = _closing(body, m.end() - 1, "(", ")")
        if closing < 0:
            continue
        brace = re.compile(r"[^\n{]*(?:interface\{\}[^\n{]*|struct\{\}[^\n{]*)*\{").match(body, closing + 1)
        tail = body[closing + 1 : brace.end() - 1 if brace else body.find("\n", closing) if body.find("\n", closing) >= 0 else len(body)].strip()
        end = _closing(body, brace.end() - 1, "{", "}") + 1 if brace else closing + 1 + len(tail) + 1
        if end <= 0:
            continue
        own = parameters(body[m.end() : closing])
        results = tail[1:-1] if tail.startswith("(") else tail
        first = _split(results)
        returns = type_name(first[0].split(" ")[-1] if first and tail.startswith("(") and " " in first[0] else first[0]) if first else ""
        receiver = type_name((m["receiver"] or "").split(" ")[-1]) if m["receiver"] else None
        signature = f"{m['name']}({', '.join(f'{n} {t}'.strip() for n, t in own)})" + (f" {returns}" if returns else "")
        owner = f"{package}.{receiver.lstrip('*')}.{m['name']}" if receiver else f"{package}.{m['name']}"
        yield row("Method" if receiver else "Function", m["name"], m.start(), end, signature, returns or None, receiver, None, None, _docstring(body, m.start()), owner)
        for n, (name, kind) in enumerate(own):
            if name and name != "_":
                yield row("Parameter", name, m.end(), closing, kind, None, None, owner, n, None, f"{owner}.{name}")

    def declared(m: re.Match, depth: int) -> Iterator[tuple]:
        """A type and its fields."""
        end = _closing(body, m.end() - 1, "{", "}") + 1
        if not end:
            return
        yield row("Class" if m["kind"] == "struct" else "Interface", m["name"], m.start() + depth - 1, end, doc=_docstring(body, m.start()))
        if m["kind"] == "struct":
            for n, f in enumerate(_FIELDS[depth].finditer(body, m.end(), end)):
                for name in re.split(r"[ \t]*,[ \t]*", f["name"]):
                    yield row("Variable", name, f.start() + depth, f.end(), f["type"].strip(), None, None, f"{package}.{m['name']}", n, None, f"{package}.{m['name']}.{name}")

    for m in _TYPE.finditer(body):
        yield from declared(m, 1)
    for m in _VALUE.finditer(body):
        for name in re.split(r"[ \t]*,[ \t]*", m["names"]):
            if name != "_":
                yield row("Variable", name, m.start(), m.end(), m["type"].strip() or None, None, None, None, None, _docstring(body, m.start()))
    at = 0
    while block := _BLOCK.search(body, at):
        closing = _BLOCK_END.search(body, block.end())
        at = closing.start() if closing else len(body)
        if block["kind"] == "type":
            for m in _TYPE_ENTRY.finditer(body, block.end(), at):
                yield from declared(m, 2)
            continue
        for m in _ENTRY.finditer(body, block.end(), at):
            for name in re.split(r"[ \t]*,[ \t]*", m["names"]):
                if name != "_":
                    yield row("Variable", name, m.start() + 1, m.end(), m["type"].strip() or None)
        if not closing:
            break


def extract(sources: DataFrame) -> DataFrame:
    """Declarations of Go files (path, content); null paths and contents are left out, repeated paths are one file."""
    one = sources.filter("path is not null and content is not null").groupBy("path").agg(F.max(F.col("content").cast("binary")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for path, content in zip(batch.path, batch.content) for r in declarations(path, bytes(content))]
            yield pd.DataFrame(found, columns=COLUMNS).astype({"position": "Int32"})

    return one.mapInPandas(run, SCHEMA)


def edges(found: DataFrame) -> DataFrame:
    """(type, src, dst) by fqn: modules and types contain what they declare, functions their parameters."""
    member = F.col("label").isin("Parameter") | (F.col("parent").isNotNull())
    up = F.when(member, F.col("parent")).otherwise(F.col("package"))
    return found.filter("label <> 'Module'").select(F.lit("CONTAINS").alias("type"), up.alias("src"), F.col("fqn").alias("dst")).distinct()

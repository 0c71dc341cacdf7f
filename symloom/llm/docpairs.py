"""Functions paired with what their documentation says about them (problem 1).

Candidate texts (docstrings, documentation of defined symbols, comments in the file) and functions form a
bipartite graph whose links are weighed by parameter tags, names and distance; the assignment of greatest
weight gives each function one text and each text one function. Implausible links are cut before, and texts
that make no statement are dropped before too, so that they take no function's place.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import Cuts
from symloom.tables import one_per_key

#: Lines of a file that are matched together. A hot file is many segments; links span REACH lines only. What stands
#: within MARGIN lines of a border is seen from both sides, so that both know its neighbours.
SEGMENT, MARGIN = 400, 12
#: Farthest distance in lines between a comment and the function it may belong to.
REACH = 3
#: Weights of a link, and the least weight of a plausible one. A function's own text outweighs any comment.
OWNED, TAG, NAMED, NEAR, LEAST = 12.0, 1.5, 3.0, 2.0, 1.5

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_MARK = re.compile(r"^\s*(?:/\*\*?|\*/|//[/!]?|\*(?!\w)|#+!?|--|;+|\"\"\"|'''|<!--)?[ \t]*(?:\*(?!\w)|//|#)?[ \t]*")
_END = re.compile(r"\s*(?:\*/|\"\"\"|'''|-->)\s*$")
# Lines that say nothing on what a function does.
_DIRECTIVE = re.compile(
    r"^(?:nolint|lint:|go:\w+|noqa|eslint|jshint|tslint|prettier-ignore|pylint|flake8|mypy:|type: ?ignore|pragma\b|ts-(?:ignore|expect-error|nocheck)|istanbul|c8 ignore|nosec|\+build|build\b ?:|clang-format|region\b|endregion\b|coding[:=]|vim?:|fmt: ?(?:on|off)|yapf:|isort:|cspell|sonar|suppress|spdx)",
    re.I,
)
# A notice is a clause: what its sentence says beyond it stays ('Deprecated: use B, which retries twice').
_NOTICE = re.compile(
    r"^(?:deprecated\b|copyright\b|\(c\)|©|licen[sc]ed? under\b|confidential\b|internal use only\b|proprietary\b|@?author\b:?|generated by\b|code generated\b|auto-?generated\b)[^,;.]*(?:\.(?=\w)[^,;.]*)*[,;.]?"
    r"|^@?(?:since|version)\b[:\s]*v?\d[\w.-]*\.?$|^@?since\b[:\s]*\w+$|^see (?:the )?licen[sc]e(?: file| text|\.\w+)?(?: (?:for|in)\b.*)?[.]?$|^all rights reserved[.!]?$",
    re.I,
)
_MARKER = re.compile(r"^(?:todo|fixme|xxx|hack|bug|note|nb|review|optimi[sz]e)\b(?:\([^)]*\))?[:!.\s-]*", re.I)
_TO_DO = re.compile(r"^(?:please )?(?:(?:write|add|fill in|complete|improve|update|fix)\b.{0,14}\b(?:docs?|documentation|comments?|description|docstring)|document(?: (?:this|me|it))?|describe(?: (?:this|me|it))?|implement(?: (?:this|me|it))?|clean ?up|refactor(?: (?:this|me|it))?|remove(?: (?:this|me|it))?|explain|tbd)[.!]?$", re.I)
_NOTHING = frozenset("undocumented none na tbd todo fixme xxx deprecated inheritdoc nodoc hidden empty missing documentation undescribed unspecified placeholder stub ditto".split())
_TAG = re.compile(r"^[@\\:](?P<tag>\w+)\s*:?\s*(?P<rest>.*)$|^\{@(?P<brace>\w+)[^}]*\}\s*(?P<after>.*)$|^(?P<head>args?|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|see also)\s*:\s*$", re.I)
_CODE = re.compile(r":=|[=!<>]=|\)\s*\{|[{};]\s*$|^\s*(?:return|if|for|while|func|def|class|import|package|const|var|let|async|public|private|static|void|int|string|bool)\b[^.]*$(?<![.!?])|^[\w.]+\([^)]*\)\s*;?$|^\w+ = \S+|=>|->")
_PART = re.compile(r"[^\W\d_]+", re.U)
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+")
_IDENTIFIER = re.compile(r"[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|\w+_\w+|\w+\(\)|[A-Z]{2,}\d*")
# The first word, behind marks and a marker; and a word that can only be a name.
_FIRST = re.compile(r"\W*(?:(?:todo|fixme|xxx|hack|bug|note|nb|review)\b(?:\([^)\n]*\))?\W*)?(\w+)", re.I)
_NAME = re.compile(r"[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|\w*[a-z]_\w+")
_GENERIC = frozenset(
    "the a an this that these those method methods function functions func procedure routine helper helpers constructor getter setter class type struct interface object value values implementation implements implement of for to and or is are be it its in on with by from as at into "
    "param parameter parameters arg args argument arguments returns return returned result results use used using uses given new i e eg ie see above below here member operation call calls callback handler utility util internal public private static async self".split()
)


def _lines(text: str) -> list[str]:
    """The lines of a comment without its marks, quoted code taken out."""
    bare = _FENCE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    return [_END.sub("", _MARK.sub("", line)).strip() for line in bare.split("\n")]


@lru_cache(maxsize=20_000)
def _parts(name: str) -> frozenset[str]:
    return frozenset(p.lower() for p in _CAMEL.findall(name))


def _covered(word: str, parts: frozenset[str]) -> bool:
    """Whether a word is one of the name's, in whatever form ('throttles' for 'throttle')."""
    if word in parts:
        return True
    return any(len(p) > 3 and word[: len(p) - 1] == p[:-1] and abs(len(word) - len(p)) <= 3 for p in parts)


def statement(text: str | None, name: str = "", signature: str = "", other: str = "") -> str:
    """What a text says on behaviour or use beyond name and signature, '' if that is nothing.

    Markers, directives, notices, rulers, repeated names and signatures, quoted code and bare tags are
    taken out; prose in any language and of any length remains. A tag's own prose counts when it says
    more than the parameter's name.
    """
    if not text or not text.strip():
        return ""
    parts = _parts(name or "") | _parts(other or "")
    # Words of the signature only matter where nothing else is said.
    declared = parts | frozenset(w.lower() for w in _PART.findall(signature or ""))
    kept = []
    flat = re.sub(r"\s+", "", signature or "")
    for line in _lines(text):
        # A ruler's or header's signs on either side of its words go, and so do they alone.
        line = line.strip("=-_*~#+<>/|· \t") if re.match(r"^[=\-_*~#+/|·]{2,}", line) or re.search(r"[=\-_*~#]{3,}$", line) else line
        if not re.search(r"[^\W_]", line):
            continue
        line = line.lstrip("@") if line.startswith("@@") else line
        m = _TAG.match(line)
        tagged = bool(m)
        if m:
            rest = m["rest"] or m["after"] or ""
            words = _PART.findall(rest.lower())
            own = words[:1]  # the parameter's name
            said = [w for w in words if w not in _GENERIC and w not in own and not _covered(w, declared)]
            if len(said) < 2:
                continue
            line = rest
        if _DIRECTIVE.match(line):
            continue
        low = line.lower()
        if "all rights reserved" in low and ("copyright" in low or "(c)" in low or "©" in low):
            continue
        noticed = False
        while line and (notice := _NOTICE.match(line)):
            line, noticed = line[notice.end() :].strip(), True
        if noticed and len(_PART.findall(line)) < 2:
            continue
        marked = _MARKER.match(line)
        if marked and re.match(r"[A-Z@!]*\b(?:TODO|FIXME|XXX|HACK|BUG|todo|fixme|Todo)\b", line):
            line = line[marked.end() :].strip()
            if not line or _TO_DO.match(line):
                continue
        if flat and re.sub(r"\s+", "", line).rstrip("{:;") in (flat, flat.rstrip("{:;")):
            continue
        if not tagged and _CODE.search(line) and not re.search(r"[.!?]$", line):
            continue
        kept.append(line)
    if not kept:
        return ""
    words = [w.lower() for line in kept for w in _PART.findall(_IDENTIFIER.sub(" ", line) if len(line.split()) > 1 else line)]
    if len(kept) == 1 and re.fullmatch(r"\W*(?:n\s*/\s*a|" + "|".join(_NOTHING) + r")\W*", kept[0], re.I):
        return ""
    if len(kept) == 1 and len(kept[0].split()) == 1 and _IDENTIFIER.fullmatch(kept[0].strip(" .:;!?()")):
        return ""
    content = [w for w in words if w not in _GENERIC and w not in _NOTHING and not _covered(w, parts)]
    if not content:
        return ""
    return re.sub(r"\s+", " ", " ".join(kept)).strip()


# ------------------------------------------------------------------------------------------ assignment


def assign(links: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The assignment of greatest total weight among (row, column, weight) links; those of weight <= 0 are left out.

    The Hungarian method over the links of one component. A row needs only as many of its best links as there
    are rows, as the others take no more columns away; so the work depends on the smaller side.
    """
    links = [x for x in links if x[2] > 0]
    if len({c for _, c, _ in links}) < len({r for r, _, _ in links}):
        return [(r, c, w) for c, r, w in assign([(c, r, w) for r, c, w in links])]
    by_row: dict[int, list[tuple[float, int]]] = {}
    for r, c, w in links:
        by_row.setdefault(r, []).append((-w, c))
    if len(by_row) <= 1:
        return [(r, min(own)[1], -min(own)[0]) for r, own in by_row.items()]
    best = {r: nsmallest(len(by_row), own) for r, own in by_row.items()}
    rows, columns = sorted(best), sorted({c for own in best.values() for _, c in own})
    at = {c: j for j, c in enumerate(columns)}
    # Columns of weight 0 at the end, one for each row, so that every row finds one.
    cost = np.zeros((len(rows), len(columns) + len(rows)))
    for i, r in enumerate(rows):
        for w, c in best[r]:
            cost[i, at[c]] = min(cost[i, at[c]], w)
    n = cost.shape[1]
    u, v = np.zeros(len(rows) + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, dtype=int)
    for i in range(1, len(rows) + 1):
        match[0] = i
        j0 = 0
        least = np.full(n + 1, np.inf)
        way = np.zeros(n + 1, dtype=int)
        used = np.zeros(n + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(rows[match[j] - 1], columns[j - 1], -float(cost[match[j] - 1, j - 1])) for j in range(1, len(columns) + 1) if match[j] and cost[match[j] - 1, j - 1] < 0]


def _weight(function: tuple, text: tuple) -> float:
    """The weight of a link: the function's own text, its parameters among the tags, its name, how near."""
    _, fid, name, signature, line, end_line, _, _, _ = function
    _, _, other, said, at, end_at, raw, source, owner = text
    weight = 0.0
    if owner is not None:
        if owner != fid:
            return 0.0
        weight += OWNED + (0.5 if source == "docstring" else 0.0)
    else:
        if line is None or at is None:
            return 0.0
        before = line - end_at - 1
        # Only a docstring stands inside its function; other comments in there speak of single steps.
        inside = line < at <= line + 3 and (end_line is None or end_at <= end_line) and bool(re.match(r"\s*[rRuU]?(?:\"\"\"|''')", raw or ""))
        if not (0 <= before <= REACH or inside):
            return 0.0
        weight += NEAR - 0.5 * (0 if inside else before)
    tags = re.findall(r"[@:]param(?:eter)?\s+(?:\{[^}]*\}\s*)?(\w+)", raw or "")
    if tags:
        known = set(re.findall(r"\w+", signature or ""))
        hit = sum(t in known for t in tags)
        weight += TAG * (hit - 2 * (len(tags) - hit)) / len(tags)
    first = _FIRST.match(raw or "")
    if first and name and first[1].lower() == name.lower():
        weight += NAMED
    elif first and owner is None and _NAME.fullmatch(first[1]) and name and not _parts(first[1]) & _parts(name):
        weight -= NAMED  # it speaks of another function
    return weight if weight >= LEAST else 0.0


def match_segment(functions: list[tuple], texts: list[tuple]) -> Iterator[tuple[int, int, str, float]]:
    """(function, text, description, weight), by their numbers, of one segment of a file.

    A comment is a candidate for the functions of the first line with any that begins after it, and for the
    last ones before it (as a docstring). A comment with the words of a function's own text is that text.
    """
    by_owner: dict[str, list[int]] = {}
    free = []
    for t, text in enumerate(texts):
        if text[8] is not None:
            by_owner.setdefault(text[8], []).append(t)
        elif text[4] is not None and text[5] is not None:
            free.append(t)
    said: dict[tuple[int, int], str] = {}
    links: list[tuple[int, int, float]] = []

    def link(f: int, t: int) -> float:
        weight = _weight(functions[f], texts[t])
        if weight > 0:
            words = statement(texts[t][6], functions[f][2] or "", functions[f][3] or "", texts[t][2] or "")
            if words:
                said[f, t] = words
                links.append((f, t, weight))
                return weight
        return 0.0

    # A text of its own is linked to no other function and outweighs all comments: any best assignment has the
    # heaviest, so those functions and texts are settled before the rest is solved.
    settled: set[int] = set()
    for f, function in enumerate(functions):
        own = [(link(f, t), t) for t in by_owner.get(function[1], ())]
        weight, t = max(own, default=(0.0, 0))
        if weight > 0:
            settled.add(f)
            yield f, t, said[f, t], weight
    if not free:
        return
    by_line: dict[int, list[int]] = {}
    for f, function in enumerate(functions):
        if function[4] is not None:
            by_line.setdefault(function[4], []).append(f)
    lines = sorted(by_line)
    links.clear()
    for t in free:
        first, last = texts[t][4], texts[t][5]
        near = []
        k = bisect.bisect_right(lines, last)
        if k < len(lines) and lines[k] - last - 1 <= REACH:
            near += by_line[lines[k]]
        k = bisect.bisect_left(lines, first) - 1
        if k >= 0:
            near += by_line[lines[k]]
        bare = None
        for f in near:
            if f in settled and bare is None:
                bare = _bare(texts[t][6])
            if f in settled and any(_bare(texts[o][6]) == bare for o in by_owner.get(functions[f][1], ())):
                break  # that function's own text
        else:
            for f in near:
                if f not in settled:
                    link(f, t)
    # Components by union of linked functions and texts.
    root = list(range(len(functions) + len(texts)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for f, t, _ in links:
        root[top(f)] = top(len(functions) + t)
    parts: dict[int, list[tuple[int, int, float]]] = {}
    for x in links:
        parts.setdefault(top(x[0]), []).append(x)
    for own in parts.values():
        for f, t, weight in assign(own):
            yield f, t, said[f, t], weight


def _bare(text: str) -> str:
    """The letters and digits of a text."""
    return "".join(_PART.findall(text)).lower()


# ------------------------------------------------------------------------------------------ the operator

_COMMENT_LINE = re.compile(r"[ \t]*(?://|#(?!!)|--)")


def comments_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of the comment blocks of a file, lines counted from 1."""
    lines = text.split("\n")
    at = 0
    while at < len(lines):
        line = lines[at]
        if _COMMENT_LINE.match(line):
            end = at
            while end + 1 < len(lines) and _COMMENT_LINE.match(lines[end + 1]):
                end += 1
            yield at + 1, end + 1, "\n".join(lines[at : end + 1])
            at = end + 1
        elif re.match(r"\s*/\*", line):
            end = at
            while end < len(lines) - 1 and "*/" not in lines[end]:
                end += 1
            yield at + 1, end + 1, "\n".join(lines[at : end + 1])
            at = end + 1
        elif m := re.match(r"\s*[rRuU]?(\"\"\"|''')", line):
            end = at
            while end < len(lines) - 1 and lines[end].count(m[1]) < (2 if end == at else 1):
                end += 1
            yield at + 1, end + 1, "\n".join(lines[at : end + 1])
            at = end + 1
        else:
            at += 1


_ROW = "file_path string, segment bigint, kind int, id string, name string, signature string, line bigint, end_line bigint, text string, source string, owner string"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def _comment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content, version in zip(batch.path, batch.content, batch.version):
            text = bytes(content).decode("utf-8", "replace").lstrip("﻿")
            for first, last, comment in comments_of(text):
                # A comment goes to the segments of the functions that it may belong to, and of their neighbours.
                for segment in sorted({max(0, x) // SEGMENT for x in (first - REACH - MARGIN, first, last + 1, last + 1 + REACH + MARGIN)}):
                    rows.append((path, segment, 1, None, None, None, first, last, comment, "comment", None, version))
        yield pd.DataFrame(rows, columns=[*_COLUMNS, "version"]).astype({"line": "Int64", "end_line": "Int64", "segment": "int64", "kind": "int32"})


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments out of sorted rows; one that goes on in the next batch is carried over.

    place is null, but for a comment that another segment sees too: then it says which comment it is.
    """

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in _COLUMNS))

    out: list[tuple] = []
    for (path, segment), group in groupby(rows(), key=lambda r: (r[0], r[1])):
        functions, texts = [], []
        known: set[tuple] = set()
        for r in group:
            if r[2] and r[9] == "comment":  # repeated rows of a file repeat its comments
                if (r[6], r[7], r[8]) in known:
                    continue
                known.add((r[6], r[7], r[8]))
            (functions if r[2] == 0 else texts).append((r[0], *r[3:]))
        if functions and texts:
            for f, t, said, weight in match_segment(functions, texts):
                _, fid, _, _, line, *_ = functions[f]
                if segment >= 0 and max(line, 0) // SEGMENT != segment:
                    continue  # a neighbour, settled in its own segment
                first, last, source = texts[t][4], texts[t][5], texts[t][7]
                both = source == "comment" and (first - REACH - MARGIN) // SEGMENT != (last + 1 + REACH + MARGIN) // SEGMENT
                out.append((fid, said, source, weight, f"{path}:{first}" if both else None))
        if len(out) > 20_000:
            yield pa.RecordBatch.from_pylist([dict(zip(_MATCHED, r)) for r in out], _MATCH_SCHEMA)
            out = []
    yield pa.RecordBatch.from_pylist([dict(zip(_MATCHED, r)) for r in out], _MATCH_SCHEMA)


_MATCHED = ["function_id", "description", "source", "weight", "place"]
_MATCH_SCHEMA = pa.schema([(c, pa.float64() if c == "weight" else pa.string()) for c in _MATCHED])

FUNCTION_COLUMNS = ["name", "signature", "file_path", "start_line", "end_line", "start_byte", "end_byte", "docstring"]


def describe(functions: DataFrame, symbols: DataFrame, defines: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(function_id, description, source, weight): one description for each function that has one.

    source is 'docstring', 'symbol' or, if `sources` is given, 'comment'. Functions whose texts make no
    statement are left out. Repeated rows of an id are one record (the newest); links to symbols that do
    not exist give nothing; a function without a file or line can only take texts of its own.
    """
    one = one_per_key(functions, ["id"], FUNCTION_COLUMNS, "updated_at")
    # Without a line, rows are spread by id; they have no neighbours to be matched with. Near a border a function
    # and its texts are seen from both sides, if there are comments.
    lined = F.col("start_line").isNotNull() & F.col("file_path").isNotNull()
    alone = F.array(-1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    at = lambda shift: F.floor(F.greatest(F.col("start_line") + shift, F.lit(0)) / SEGMENT).cast("long")
    seen = F.array_distinct(F.array(at(-MARGIN), at(0), at(MARGIN))) if sources is not None else F.array(at(0))
    base = one.withColumn("_segment", F.explode(F.when(lined, seen).otherwise(alone))).withColumn("_path", F.coalesce("file_path", F.lit("")))
    null = F.lit(None).cast("string")
    rows = base.select(F.col("_path").alias("file_path"), F.col("_segment").alias("segment"), F.lit(0).alias("kind"), "id", "name", "signature", F.col("start_line").alias("line"), "end_line", null.alias("text"), null.alias("source"), null.alias("owner"))
    docs = base.filter("docstring is not null and trim(docstring) <> ''").select(
        F.col("_path").alias("file_path"), F.col("_segment").alias("segment"), F.lit(1).alias("kind"), null.alias("id"), null.alias("name"), null.alias("signature"), F.col("start_line").alias("line"), F.col("start_line").alias("end_line"), F.col("docstring").alias("text"), F.lit("docstring").alias("source"), F.col("id").alias("owner")
    )
    documented = symbols.filter("id is not null and documentation is not null and trim(documentation) <> ''")
    documented = one_per_key(documented, ["id"], ["documentation", "display_name"], "created_at").select(F.col("id").alias("_symbol"), "documentation", "display_name")
    links = defines.filter("start_id is not null and end_id is not null").select(F.col("start_id").alias("_function"), F.col("end_id").alias("_symbol")).distinct()
    by_symbol = links.join(documented, "_symbol").join(base.select(F.col("id").alias("_function"), "_path", "_segment", "start_line"), "_function").select(
        F.col("_path").alias("file_path"), F.col("_segment").alias("segment"), F.lit(1).alias("kind"), null.alias("id"), F.col("display_name").alias("name"), null.alias("signature"), F.col("start_line").alias("line"), F.col("start_line").alias("end_line"), F.col("documentation").alias("text"), F.lit("symbol").alias("source"), F.col("_function").alias("owner")
    )
    every = rows.unionByName(docs).unionByName(by_symbol)
    if sources is not None:
        text = _texts(sources)
        comments = text.mapInPandas(_comment_rows, _ROW + ", version bigint")
        # Of several contents of a path the one with the greatest hash counts, here as in pairs(). They are rare: only
        # if there are any are the comments, and never the contents, brought together by path.
        several = Cuts(sources.sparkSession, "docpairs").cut(text.groupBy("path").agg(F.max("version").alias("_version"), F.min("version").alias("_other")).filter("_version <> _other"))
        if not several.isEmpty():
            comments = comments.join(several, F.col("file_path") == F.col("path"), "left").filter("_version is null or _version = version")
        every = every.unionByName(comments.select(*_COLUMNS))
    placed = every.repartition("file_path", "segment").sortWithinPartitions("file_path", "segment", "kind")
    matched = placed.mapInArrow(_match, "function_id string, description string, source string, weight double, place string")
    if sources is None:
        return matched.drop("place")
    # One comment, one function: only those near a border can have been given away twice.
    near = Cuts(functions.sparkSession, "docpairs").cut(matched)
    twice = near.filter("place is not null").groupBy("place").agg(F.max(F.struct("weight", "function_id", "description", "source")).alias("m")).select("m.function_id", "m.description", "m.source", "m.weight")
    return near.filter("place is null").drop("place").unionByName(twice)


def _texts(sources: DataFrame) -> DataFrame:
    rows = sources.filter("path is not null and content is not null").select("path", F.col("content").cast("binary").alias("content"))
    return rows.withColumn("version", F.xxhash64("content"))


def pairs(functions: DataFrame, symbols: DataFrame, defines: DataFrame, sources: DataFrame) -> DataFrame:
    """(function_id, name, signature, source, description, code): code-description pairs.

    The code is the function's bytes, or its lines where the offsets are missing or past the file's end;
    functions without a text of their file, or whose place in it is unknown, are left out.
    """
    found = describe(functions, symbols, defines, sources)
    one = one_per_key(functions, ["id"], FUNCTION_COLUMNS, "updated_at").withColumnRenamed("id", "function_id")
    text = _texts(sources).groupBy(F.col("path").alias("_path")).agg(F.max_by("content", "version").alias("content"))
    size = F.octet_length("content")
    ranged = F.col("start_byte").isNotNull() & (F.col("start_byte") >= 0) & (F.col("end_byte") > F.col("start_byte")) & (F.col("end_byte") <= size)
    by_bytes = F.expr("substring(content, cast(start_byte + 1 as int), cast(end_byte - start_byte as int))")
    body = F.expr("split(decode(content, 'ISO-8859-1'), '\n')")
    by_lines = F.when((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.encode(F.array_join(F.slice(body, F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n"), "ISO-8859-1"))
    code = F.expr("decode(_code, 'UTF-8')")
    joined = found.join(one, "function_id").join(text, F.col("file_path") == F.col("_path"))
    sliced = joined.withColumn("_code", F.when(ranged, by_bytes).otherwise(by_lines)).filter("_code is not null and octet_length(_code) > 0")
    readable = sliced.withColumn("_code", F.encode(F.expr("coalesce(try_validate_utf8(cast(_code as string)), decode(_code, 'ISO-8859-1'))"), "UTF-8"))
    return readable.select("function_id", "name", "signature", "source", "description", code.alias("code"))

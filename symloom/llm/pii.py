"""Personal information in free text: find it and put typed placeholders in its place (problem 8).

A character-level BiLSTM-CRF (tagger.py), trained by pii_train.py, reads every character of every text, in
overlapping windows; where windows overlap, each character takes the tag of the window in which it stands
farthest from an edge, and spans are read off the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.tagger import KINDS, PAD, TAGS, Tagger, encode

MODEL = Path(__file__).with_name("pii_model.npz")
#: Characters in a window of the fit, and how many of them the next one reads again.
WINDOW, OVERLAP = 96, 40
#: Characters in a window when texts are tagged: the longer it is, the less is read twice.
READ = 384
#: Windows that are tagged at once.
BATCH = 512
#: Texts that are cut into windows at once: the more there are, the more alike are the windows of a batch.
PART = 4000

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

# Words before a name, in any case.
_INTRODUCE = ("name is", "name:", "ich heiße", "name ist", "m'appelle", "me llamo", "signed,", "regards,", "dear ", "attn:", "author:", "contact:", "patient ", "mr", "mrs", "ms", "dr", "prof", "frau", "herr", "mme", "mlle", "monsieur", "madame", "sra", "señor")
_EMAIL = re.compile(r"^[\w.+%’'-]+\s*(?:@|[\[(]\s*(?:at|AT)\s*[\])]|\s(?:at|AT)\s)\s*[\w-]+(?:(?:\.|\s*[\[(]\s*(?:dot|DOT)\s*[\])]\s*|\s+(?:dot|DOT)\s+)[\w-]+)+$")
_TITLE = re.compile(rf"(?:\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Mme|Mlle|M|Monsieur|Madame|Sr|Sra|Señora?|Don|Doña|Sir|Dame)\.?\s+)+$")


_LOWER_TITLE = re.compile(r"\b(?:mr|mrs|ms|miss|dr|prof|herrn?|frau|mme|mlle|monsieur|madame|sra?|señora?)\.?\s+$")
_INTRODUCED = re.compile("(?:" + "|".join(re.escape(w) + (r"[.]?" if w[-1].isalpha() else "") for w in _INTRODUCE) + r"|\bhi|\b(?:to|by|for|from|met|call|contact)):?\s*$")
_LEADING = re.compile(_TITLE.pattern.removesuffix("$"))


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that the tagger reads: all of it."""
    return [(0, len(text))] if text else []


def cut(parts: list[tuple[int, int]], size: int | None = None) -> list[tuple[int, int]]:
    """Windows over the parts: `size` (or WINDOW) characters each, OVERLAP of them shared by neighbours."""
    size = size or WINDOW
    windows = []
    for a, b in parts:
        while True:
            windows.append((a, min(a + size, b)))
            if a + size >= b:
                break
            a += size - OVERLAP
    return windows


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(first, last, kind) spans of each text, before any check."""
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    todo: list[tuple[int, int, int, np.ndarray]] = []
    for n, text in enumerate(texts):
        parts = stretches(text)
        if parts:
            codes = encode(text.replace("\xa0", " "))  # the tagger's white space
            todo += [(n, a, b, codes[a:b]) for a, b in cut(parts, READ)]
    order = sorted(range(len(todo)), key=lambda i: todo[i][2] - todo[i][1])  # windows of a batch are about as long
    tags: list[np.ndarray | None] = [None] * len(todo)
    for k in range(0, len(order), BATCH):
        own = order[k : k + BATCH]
        length = max(len(todo[i][3]) for i in own)
        batch = np.full((len(own), length), PAD, dtype=np.uint8)
        for row, i in enumerate(own):
            batch[row, : len(todo[i][3])] = todo[i][3]
        found = tagger.tag(batch)
        for row in np.flatnonzero(found.any(axis=1)):
            tags[own[row]] = found[row, : len(todo[own[row]][3])]
    by_text: dict[int, list[int]] = {}
    for i, (n, *_rest) in enumerate(todo):
        by_text.setdefault(n, []).append(i)
    for n, own in by_text.items():
        tagged = [(todo[i][1], todo[i][2], tags[i]) for i in own if tags[i] is not None]
        if tagged:
            spans[n] = _reconcile(texts[n], tagged, [(todo[i][1], todo[i][2]) for i in own])
    return spans


def _reconcile(text: str, tagged: list[tuple[int, int, np.ndarray]], windows: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans of one text: of windows that overlap, the one whose edge is farther decides on a character."""
    low, high = min(a for a, _, _ in tagged), max(b for _, b, _ in tagged)
    best = np.full(high - low, -1, dtype=np.int32)
    out = np.zeros(high - low, dtype=np.int8)
    known = {(a, b): t for a, b, t in tagged}
    for a, b in windows:
        x, y = max(a, low), min(b, high)
        if y <= x:
            continue
        at = np.arange(x, y)
        depth = np.minimum(at - a if a else at + READ, b - 1 - at if b < len(text) else READ)
        own = known.get((a, b))
        wins = depth > best[x - low : y - low]
        best[x - low : y - low][wins] = depth[wins]
        out[x - low : y - low][wins] = own[x - a : y - a][wins] if own is not None else 0
    spans = []
    at = 0
    while at < len(out):
        if out[at]:
            kind, end = (out[at] - 1) // 2, at + 1
            while end < len(out) and out[end] and (out[end] - 1) // 2 == kind and out[end] % 2 == 0:
                end += 1
            spans.append((low + at, low + end, KINDS[kind]))
            at = end
        else:
            at += 1
    return spans


def _snap(text: str, first: int, last: int) -> tuple[int, int]:
    """A span moved out to the ends of its words, without white space and closing marks at its edges."""
    while first > 0 and text[first - 1].isalnum() and text[first].isalnum():
        first -= 1
    while last < len(text) and text[last].isalnum() and text[last - 1].isalnum():
        last += 1
    while first < last and text[first] in " \t\r\n,;:.<>\"'`|":
        first += 1
    while last > first and text[last - 1] in " \t\r\n,;:<>\"'`|" or last > first and text[last - 1] == "." and not re.search(r"\b[A-Z]\.$|St\.$|Rd\.$", text[first:last]):
        last -= 1
    return first, last


#: Words before a number that say it is a technical one.
_TECHNICAL = re.compile(r"\b(?:offset|span|commit|build|order|ticket|port|line|version|revision|rev|trace|hash|error|0x\w*)[\s:#=]*$", re.I)


def _shouted(text: str, first: int, last: int) -> bool:
    """Whether the words around are in capitals too: there they tell no name from any other word."""
    around = text[max(0, first - 40) : first] + text[last : last + 40]
    high = sum(c.isupper() for c in around)
    return high >= 10 and high > sum(c.islower() for c in around)


def holds(text: str, first: int, last: int, kind: str) -> bool:
    """The exact check on a span that the tagger found."""
    value = text[first:last]
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        return bool(_EMAIL.match(value)) and not value.lower().startswith("git@") and not re.match(r":[\w/]", text[last : last + 2]) and not re.search(r"@v?\d", value)
    number = first + next((n for n, c in enumerate(value) if c.isdigit()), 0) if kind == "phone" else first
    if kind in ("phone", "address") and _TECHNICAL.search(text[max(0, number - 16) : number]):
        return False
    if kind in ("person", "address") and value.isupper() and _shouted(text, first, last):
        return False
    if kind == "phone":
        return 7 <= digits <= 15 and not re.fullmatch(r"\d{4}-\d\d-\d\d", value) and digits * 2 >= len(value) - 4 and not re.fullmatch(r"\d+(?:\.\d+){3}", value)
    if kind == "id_number":
        return 5 <= digits and len(value) <= 30 and not re.fullmatch(r"\d{4}-\d\d-\d\d", value)
    if kind == "address" and re.match(r"(?:ticket|order|build|commit|error|line|port|version|revision|invoice|case)\b", value, re.I):
        return False
    if kind == "address":
        return digits >= 1 and sum(c.isalpha() for c in value) >= 3 and len(value) >= 6 and bool(re.search(r"\s", value))
    words = [w for w in re.split(r"[\s_,]+", value) if w]
    if value.islower():  # in a text without capitals a name must be introduced
        return not digits and 1 <= len(words) <= 4 and (len(words) > 1 or bool(_LOWER_TITLE.search(text[max(0, first - 20) : first]))) and bool(_INTRODUCED.search(text[max(0, first - 20) : first]))
    if digits or not all(w[0].isupper() or w in ("van", "von", "de", "der", "la", "del", "di", "al", "bin", "da", "dos") for w in words):
        return False
    return len(words) >= 2 or bool(words) and len(words[0]) > 1 and bool(_TITLE.search(text[max(0, first - 20) : first]))


def find_in(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Checked spans (first, last, kind) of each text, in order, none overlapping."""
    out = []
    for text, spans in zip(texts, tag_texts(tagger, texts)):
        kept: list[tuple[int, int, str]] = []
        for first, last, kind in spans:
            first, last = _snap(text, first, last)
            if kind == "person" and (title := _LEADING.match(text, first, last)):
                first = title.end()  # the title stays readable
            if last > first and (not kept or first >= kept[-1][1]) and holds(text, first, last, kind):
                kept.append((first, last, kind))
        out.append(kept)
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for first, last, kind in spans:
        parts += [text[at:first], PLACEHOLDERS[kind]]
        at = last
    return "".join([*parts, text[at:]])


# ------------------------------------------------------------------------------------------ the operator


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents with a text; those of fewer partitions than there are cores are dealt out, as reading takes far longer than moving them."""
    own = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text <> ''")
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return own.repartition(cores) if own.rdd.getNumPartitions() < cores else own


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | Path = MODEL) -> DataFrame:
    """(doc_id, first, last, pii_type): every piece of personal information, by character offsets.

    Null and empty texts hold none; each row is a document, repeated texts are reported for each.
    """
    held = dict(Tagger.load(model).w)  # about 50,000 numbers, sent with the task

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(held)
        for batch in batches:
            for k in range(0, len(batch), PART):
                part = batch.iloc[k : k + PART]
                rows = [(key, a, b, kind) for key, spans in zip(part.doc_id, find_in(tagger, part.text.tolist())) for a, b, kind in spans]
                yield pd.DataFrame(rows, columns=["doc_id", "first", "last", "pii_type"])

    return _texts(documents, doc_id, text).mapInPandas(scan, "doc_id bigint, first int, last int, pii_type string")


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | Path = MODEL) -> DataFrame:
    """(doc_id, n_spans, redacted): every text, with placeholders where it held personal information."""
    held = dict(Tagger.load(model).w)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(held)
        for batch in batches:
            for k in range(0, len(batch), PART):
                part = batch.iloc[k : k + PART]
                texts = part.text.tolist()
                spans = find_in(tagger, texts)
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "n_spans": [len(s) for s in spans], "redacted": [redacted(t, s) for t, s in zip(texts, spans)]})

    return _texts(documents, doc_id, text).mapInPandas(scan, "doc_id bigint, n_spans int, redacted string")

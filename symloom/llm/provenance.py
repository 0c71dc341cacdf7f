"""Generated, minified, vendored and data files among source files (problem 3).

Linear support-vector classifiers, one for each kind, on hashed character n-grams of the text and hashed
components of the path. Their labels are giveaways that some files carry (headers, naming and directory
conventions, the shape of the lines); the giveaway lines themselves are masked in the features, so that a
classifier learns what such files look like and also finds those that carry none. They are fitted on a
bounded sample of files and their thresholds are set on repositories that the fit has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.tables import one_per_key

KINDS = ("generated", "minified", "vendored", "data")
DATA = KINDS.index("data")
#: A data file has at least this share of its text in rows of nothing but literals and their keys.
TABLE_SHARE = 0.5
#: Files that the classifiers are fitted on, drawn by a hash of the path.
SAMPLE = 4000
#: Longest text of the sample, in bytes (the fit only; every text is judged as a whole).
SAMPLE_BYTES = 262_144
#: Bytes of all texts of the sample together: the fit takes files in order of their paths' hashes up to that, so that
#: the driver holds no more (their features take up to ten times as much).
SAMPLE_TOTAL = 32 << 20
#: Bytes that are hashed at once; a longer text is summed up over slices.
SLICE = 2_000_000
#: One repository in so many is kept out of the fit.
HELD_OUT = 4
#: Hashed dimensions: n-grams of the text, then components of the path.
TEXT_DIMS, PATH_DIMS = 1 << 15, 1 << 12
#: Value of a component of the path, however deep the path is.
PATH_SCALE = 0.35
#: Lengths of the n-grams.
GRAMS = (3, 5)
#: Passes over the sample in the first and the second fit, step and decay.
EPOCHS, STEP, DECAY = (5, 8), 0.6, 2e-5
#: Orders of the sample whose weights are averaged, so that a file near the border does not hang on one order.
ORDERS = 3

# Published conventions for what a tool writes above its output, and what people write above a
# copy. Each stands for a statement about this file, so the first is read at the beginning of a comment line;
# a comment that merely speaks of generated code elsewhere makes none. All take time linear in the line.
_HEADER = re.compile(
    r"^[\W_]*(?:code |(?:this|the) \w+ (?:was |is |has been )(?:automatically |auto-?)?|auto-?|automatically )?generated\b(?! (?:files?|code|sources?) [a-z])"
    r"|^[\W_]*(?:produced|emitted|created|written) by (?:the |a )?[\w.-]+ (?:compiler|generator|tool)\b"
    r"|@generated\b|\bdo not (?:edit|modify)\b|\b(?:edits?|changes?) (?:is|are|will be) (?:over-?written|lost|discarded)\b|\bnicht von hand\b|\bne pas modifier\b|\bno editar\b",
    re.I,
)
_COPIED = re.compile(
    r"^[\W_]*(?:(?:verbatim|unmodified|exact) copy|(?:imported|copied|vendored|taken|borrowed|adapted)(?: \w+)? from)\b|\bupstream (?:project|sources?|repository)\b|\bpatches upstream\b|\bcopyright \(c\) [\d, -]+ the \w+ authors\b",
    re.I,
)
#: Whatever one of these patterns matches holds one of these, in small letters: substring searches are cheaper.
_HINTS = tuple(b"generated|produced by|emitted by|created by|written by|do not |edit|change|von hand|ne pas |no editar|upstream|copy|imported|copied|vendored|taken|borrowed|adapted".split(b"|"))
_GENERATED_NAME = re.compile(r"\.pb\.\w+$|_pb2(?:_grpc)?\.pyi?$|_pb\.js$|\.g\.\w+$|[._-]gen(?:erated)?\.\w+$|_string\.go$|(?:^|/)(?:mock_|zz_generated)|(?:^|/)(?:__generated__|generated|autogen|gen)/", re.I)
_MINIFIED_NAME = re.compile(r"[.-]min\.(?:js|css|mjs)$|\.[0-9a-f]{6,20}\.(?:js|css)$", re.I)
_VENDORED_PATH = re.compile(r"(?:^|/)(?:vendor|_?vendored|node_modules|bower_components|godeps/_workspace|third[_-]?party|3rd[_-]?party|external|extern|deps|site-packages|dist-packages|contrib/upstream|\.cargo/registry|go/pkg/mod|gems|\.m2|jspm_packages)/", re.I)
_COMMENT = re.compile(rb"\s*(?://|#|/\*|\*|--|;|<!--|\"\"\")")
# A row of nothing but literals, brackets and separators. No two alternatives begin alike and all are possessive, so
# a line is read once, whatever it holds.
_LITERALS = rb"(?:[ \t\[\](){},;+]++|-?(?:0x[0-9a-fA-F]++|\d[\d._eE+-]*+)|b?\"[^\"\n]*+\"|'[^'\n]*+')++"
_LITERAL_ROW = re.compile(rb"^(?=[^\n]*[\d\"'])" + _LITERALS + rb"[ \t\r]*+$", re.M)
# The same with keys before the literals, or behind an assignment's name: rows of maps, and tables on one line.
_KEYED = rb"(?:[ \t\[\](){},;+]++|[:=]>?|-?(?:0x[0-9a-fA-F]++|\d[\d._eE+-]*+)|b?\"[^\"\n]*+\"|'[^'\n]*+')++"
_KEYED_ROW = re.compile(rb"^(?=[^\n]*[\d\"'])(?:[ \t]*+(?:[A-Za-z_][\w.]*+[ \t]++){0,3}[A-Za-z_][\w.]*+(?:\[[^\]\n]*+\])?[\w.]*+[ \t]*+:?=(?=[ \t]*+[\w*.]*+[\[({])(?:[ \t]*+\[\w*+\][\w.*]++)?+)?+" + _KEYED + rb"[ \t\r]*+$", re.M)


def clean_path(path: str | None) -> str:
    """One way of writing a path: forward slashes, no './', no doubled slashes."""
    text = re.sub(r"/+", "/", (path or "").strip().replace("\\", "/"))
    text = re.sub(r"(?:^|(?<=/))\./", "", text)
    return text


def split_head(text: bytes) -> tuple[list[bytes], int]:
    """The comment lines at the top of a file, and where the rest begins."""
    lines, at = [], 3 if text.startswith(b"\xef\xbb\xbf") else 0
    while at < len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip() and not _COMMENT.match(line):
            break
        lines.append(line)
        at = end + 1
    return lines, min(at, len(text))


def literal_share(text: bytes, keyed: bool = False) -> float:
    """Share of a text that stands in rows of nothing but literals; with `keyed`, of keys and literals."""
    return sum(m.end() - m.start() for m in (_KEYED_ROW if keyed else _LITERAL_ROW).finditer(text)) / max(1, len(text))


def giveaways(text: bytes | None, path: str, absolute: str) -> set[str]:
    """The kinds that a file shows by itself; the labels of the fit."""
    found = set()
    if _GENERATED_NAME.search(path):
        found.add("generated")
    if _MINIFIED_NAME.search(path):
        found.add("minified")
    if _VENDORED_PATH.search(path) or _VENDORED_PATH.search(absolute):
        found.add("vendored")
    if text:
        head, begin = split_head(text)
        top = [line.decode("utf-8", "replace") for line in _hinted(head)]
        if any(_HEADER.search(line) for line in top):
            found.add("generated")
        if any(_COPIED.search(line) for line in top):
            found.add("vendored")
        body = text[begin:]
        lines = body.count(b"\n") + 1
        # Wide lines that hold code, not one long string or a row of literals.
        if len(body) > 400 and len(body) / lines > 250 and sum(body.count(c) for c in b";{}()") > len(body) / 40:
            found.add("minified")
        if literal_share(text) > 0.6:
            found.add("data")
    return found


def masked(text: bytes) -> bytes:
    """The text without its leading comments and without what gives its kind away: a comment line with such a
    phrase goes, elsewhere (a line may be the whole file) the phrase does; digits as one."""
    _, begin = split_head(text)
    body = text[begin:]
    lines = body.split(b"\n")
    if told := set(_hinted(lines)):
        body = b"\n".join(_bare(line) if line in told else line for line in lines)
    return body.translate(_DIGITS, b"\r")


def _hinted(lines: list[bytes]) -> list[bytes]:
    """The lines that may give something away."""
    low = b"\n".join(lines).lower()
    words = [w for w in _HINTS if w in low]
    return [line for line, own in zip(lines, low.split(b"\n")) if any(w in own for w in words)] if words else []


def _bare(line: bytes) -> bytes:
    text = line.decode("utf-8", "surrogateescape")
    if not (_HEADER.search(text) or _COPIED.search(text)):
        return line
    return b"" if _COMMENT.match(line) else _COPIED.sub("", _HEADER.sub("", text)).encode("utf-8", "surrogateescape")


_DIGITS = bytes(48 if 48 <= i <= 57 else i for i in range(256))


def path_features(path: str, absolute: str) -> list[int]:
    """Hashed components of both paths, without the repository's name and what stands above it."""
    parts = path.split("/")
    repo, inner = parts[0], parts[1:]
    outer = absolute.split("/") if absolute else []
    outer = outer[outer.index(repo) + 1 :] if repo in outer else outer
    tokens = set()
    for part in [*inner[:-1], *outer[:-1]]:
        tokens.add("d:" + re.sub(r"[\d.]+", "0", part.lower()))
    name = (inner or parts)[-1].lower()
    stem, dot, suffix = name.partition(".")
    tokens.add("x:" + re.sub(r"[0-9a-f]{6,}", "h", suffix))
    words = re.split(r"[_-]+", re.sub(r"\d+", "0", stem))
    tokens.add("l:" + words[-1])
    tokens.add("f:" + words[0])
    return sorted({(hash64(t) % PATH_DIMS) + TEXT_DIMS for t in tokens})


def hash64(text: str) -> int:
    value = 0xCBF29CE484222325
    for byte in text.encode("utf-8"):
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value ^ (value >> 29)


def gram_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, where each text's begin, how many each has)."""
    pad = b"\0" * max(GRAMS)
    joined = np.frombuffer(b"".join(t + pad for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + len(pad) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    columns = []
    u = joined.astype(np.uint32)
    for n in GRAMS:
        h = np.full(len(u), n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h[: len(u) - k] = (h[: len(u) - k] ^ u[k:]) * np.uint32(0x01000193)
        columns.append(((h ^ (h >> np.uint32(15))) & np.uint32(TEXT_DIMS - 1)).astype(np.int32))
    return np.stack(columns), starts, sizes


@dataclass
class Model:
    """Weights of the four classifiers, and the score from which each one says yes."""

    weights: np.ndarray  # (dims + 1, kinds), the last row holds the biases
    threshold: np.ndarray
    held_out_f1: dict[str, float]

    def save(self, path: str) -> None:
        """One file; a model that was fitted once can judge any number of corpora."""
        np.savez_compressed(path, weights=self.weights, threshold=self.threshold, held_out_f1=np.array([self.held_out_f1[k] for k in KINDS]))

    @classmethod
    def load(cls, path: str) -> Model:
        with np.load(path) as stored:
            return cls(stored["weights"], stored["threshold"], dict(zip(KINDS, stored["held_out_f1"].tolist())))

    def scores(self, texts: list[bytes | None], paths: list[tuple[str, str]]) -> np.ndarray:
        """(files, kinds): the mean weight of a text's n-grams, plus that of the path, plus the bias."""
        return self.text_scores(texts) + self.path_scores(paths)

    def text_scores(self, texts: list[bytes | None]) -> np.ndarray:
        pieces = [(i, t[k : k + SLICE + max(GRAMS) - 1]) for i, t in enumerate(texts) if t for k in range(0, len(t), SLICE)]
        sums, sizes = np.zeros((len(texts), len(KINDS))), np.zeros(len(texts))
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size < SLICE):
                size += len(pieces[end][1])
                end += 1
            rows = [i for i, _ in pieces[at:end]]
            grams, starts, lengths = gram_rows([t for _, t in pieces[at:end]])
            np.add.at(sizes, rows, lengths)
            for g in grams:
                np.add.at(sums, rows, np.stack([np.add.reduceat(self.weights[:, k].take(g), starts) for k in range(len(KINDS))], axis=1))
            at = end
        return (sums / np.maximum(1, sizes * len(GRAMS))[:, None]).astype(np.float32)

    def path_scores(self, paths: list[tuple[str, str]]) -> np.ndarray:
        out = np.tile(self.weights[-1], (len(paths), 1)).astype(np.float32)
        for i, (path, absolute) in enumerate(paths):
            own = path_features(path, absolute)
            out[i] += self.weights[own].sum(axis=0) * PATH_SCALE
        return out


def _sparse(text: bytes | None, path: str, absolute: str) -> tuple[np.ndarray, np.ndarray]:
    own = np.array(path_features(path, absolute), dtype=np.int32)
    value = np.full(len(own), PATH_SCALE, dtype=np.float32)
    if not text:
        return own, value
    grams, _, sizes = gram_rows([text])
    count = np.bincount(grams.ravel(), minlength=TEXT_DIMS)
    at = np.flatnonzero(count).astype(np.int32)
    return np.concatenate([at, own]), np.concatenate([(count[at] / grams.size).astype(np.float32), value])


def fit(rows: list[tuple[bytes | None, str, str, str]], seed: int = 11) -> Model:
    """Fit on (text, path, absolute path, repository) rows by averaged stochastic subgradients of the hinge loss.

    Each row with a text is also learnt without it, as some files have none. n-gram frequencies are
    scaled by the inverse root of their mean, so that rare ones count; the scale is folded into the
    weights.
    """
    dims = TEXT_DIMS + PATH_DIMS
    features, labels, held = [], [], []
    for text, path, absolute, repo in rows:
        kinds = giveaways(text, path, absolute)
        y = np.array([1.0 if k in kinds else -1.0 for k in KINDS], dtype=np.float32)
        out = hash64(repo) % HELD_OUT == 0
        body = masked(text) if text else None
        features.append(_sparse(body, path, absolute))
        labels.append(y)
        held.append(out)
        if body:
            from_path = giveaways(None, path, absolute)
            bare = np.array([1.0 if k in from_path else -1.0 for k in KINDS], dtype=np.float32)
            features.append(_sparse(None, path, absolute))
            labels.append(np.where(bare == y, y, 0.0).astype(np.float32))  # 0: the path alone can't tell
            held.append(out)
    mean = np.zeros(dims)
    for at, value in features:
        mean[at] += value
    mean /= max(1, len(features))
    scale = np.ones(dims, dtype=np.float32)
    scale[:TEXT_DIMS] = 1.0 / np.sqrt(mean[:TEXT_DIMS] + 1e-5)
    data = [(at, value * scale[at]) for at, value in features]
    train = [i for i, h in enumerate(held) if not h] or list(range(len(data)))
    rng = np.random.default_rng(seed)
    w = _descend(data, labels, train, EPOCHS[0], rng)
    # A file that shows no giveaway need not be free of its kind: where the first fit contradicts a label
    # of "no", the second fit does not learn from it.
    labels = [np.where((y < 0) & ((value @ w[at]) + w[-1] > 0), 0.0, y).astype(np.float32) for (at, value), y in zip(data, labels)]
    w = np.mean([_descend(data, labels, train, EPOCHS[1], rng) for _ in range(ORDERS)], axis=0)
    scores = np.array([(value @ w[at]) + w[-1] for at, value in data]) if data else np.zeros((0, len(KINDS)))
    y = np.array(labels) if labels else np.zeros((0, len(KINDS)))
    out = np.array(held, dtype=bool)
    threshold, quality = np.zeros(len(KINDS), dtype=np.float32), {}
    for k, kind in enumerate(KINDS):
        rows_k = out & (y[:, k] != 0) if (out & (y[:, k] > 0)).any() else y[:, k] != 0
        threshold[k], quality[kind] = _best_threshold(scores[rows_k, k], y[rows_k, k] > 0)
    folded = w * np.append(scale, 1.0).astype(np.float32)[:, None]
    return Model(folded, threshold, quality)


def _descend(data: list[tuple[np.ndarray, np.ndarray]], labels: list[np.ndarray], train: list[int], epochs: int, rng: np.random.Generator) -> np.ndarray:
    """Weights by averaged subgradient steps; rare kinds weigh more, labels of 0 nothing."""
    positive = np.array([max(1, sum(labels[i][k] > 0 for i in train)) for k in range(len(KINDS))])
    weight = np.clip(len(train) / positive / 4, 1.0, 8.0).astype(np.float32)
    w = np.zeros((TEXT_DIMS + PATH_DIMS + 1, len(KINDS)), dtype=np.float32)
    total, steps, shrink = np.zeros_like(w), 0, 1.0
    for epoch in range(epochs):
        step = STEP / (1 + epoch)
        for i in rng.permutation(train):
            at, value = data[i]
            y = labels[i]
            score = (value @ w[at]) * shrink + w[-1]
            wrong = (y * score < 1) & (y != 0)
            shrink *= 1 - step * DECAY
            if wrong.any():
                g = np.where(wrong, y * np.where(y > 0, weight, 1.0), 0.0).astype(np.float32) * step
                w[at] += value[:, None] * g[None, :] / shrink
                w[-1] += g * 0.1
        w[:-1] *= shrink
        shrink = 1.0
        if epoch >= epochs // 3:
            total += w
            steps += 1
    return total / max(1, steps)


def _best_threshold(scores: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The threshold with the best F1: a third into the widest gap between scores that has it, and not
    below 0; where there is no case there is no yes."""
    if not truth.any():
        return float("inf"), 0.0
    order = np.argsort(scores)
    ranked, right = scores[order], truth[order]
    below = np.concatenate([[0], np.cumsum(right)])  # cases that a cut before rank i would miss
    said = len(ranked) - np.arange(len(ranked) + 1)
    hits = right.sum() - below
    f1 = 2 * hits / np.maximum(1, said + right.sum())
    edges = np.concatenate([[ranked[0] - 1], ranked, [ranked[-1] + 1]])
    gaps = edges[1:] - edges[:-1]
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-9), key=lambda i: gaps[i])
    return max(0.0, float(edges[best] + gaps[best] / 3)), float(f1.max())


# ------------------------------------------------------------------------------------------ the operator


def _clean() -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(F.trim("path"), "\\", "/"), "/+", "/"), r"(^|(?<=/))\./", "")


def train(files: DataFrame, sources: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the classifiers on `sample` files, those with the smallest hashes of their paths."""
    clean = _clean()
    some = files.filter("path is not null").select(clean.alias("path"), F.coalesce("absolute_path", F.lit("")).alias("absolute_path")).groupBy("path").agg(F.max("absolute_path").alias("absolute_path"))
    some = some.orderBy(F.xxhash64("path"), "path").limit(sample)  # at most `sample` short rows
    text = sources.filter(F.octet_length("content") <= SAMPLE_BYTES).select(F.col("path").alias("_path"), "content").join(F.broadcast(some), F.col("_path") == F.col("path")).groupBy("path").agg(F.max("absolute_path").alias("absolute_path"), F.max("content").alias("content"))
    rows, size = [], 0
    for r in text.filter("content is not null").orderBy(F.xxhash64("path"), "path").toLocalIterator():
        size += len(r["content"])
        if size > SAMPLE_TOTAL and rows:
            break
        rows.append((bytes(r["content"]), r["path"], r["absolute_path"], r["path"].split("/")[0]))
    return fit(rows)


def classify(files: DataFrame, sources: DataFrame, model: Model | None = None) -> DataFrame:
    """(file_id, path, kind, score, <kind scores>): every file, kind 'hand_written' where no classifier says yes.

    A file without a text is judged by its path alone. Empty tables give an empty result; a null id is no
    record.
    """
    model = model or train(files, sources)
    sent = files.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for batch in batches:
            contents = [bytes(c) for c in batch.content]
            scores = held.text_scores([masked(c) for c in contents]) if contents else np.zeros((0, len(KINDS)))
            table = [literal_share(c, keyed=True) >= TABLE_SHARE for c in contents]
            yield pd.DataFrame({"path": batch.path, "scores": list(scores.astype(float)), "table": table})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for batch in batches:
            if not len(batch):
                continue
            none = np.zeros(len(KINDS))
            text = np.stack([none if s is None else np.asarray(s) for s in batch.scores])
            margin = text + held.path_scores(list(zip(batch.path, batch.absolute_path))) - held.threshold
            for i in np.flatnonzero(margin[:, DATA] > 0):  # mostly a table, not some constants
                if batch.scores.iloc[i] is not None and not batch.table.iloc[i]:
                    margin[i, DATA] = -1.0
            top, most = margin.argmax(axis=1), margin.max(axis=1)
            yield pd.DataFrame({"file_id": batch.file_id, "path": batch.path, "kind": [KINDS[k] if m > 0 else "hand_written" for k, m in zip(top, most)], "score": most.astype(float)})

    # Texts are read where they lie; only their few scores are shuffled and joined to the files.
    texts = sources.filter("path is not null and content is not null").select("path", F.col("content").cast("binary").alias("content"))
    scored = texts.mapInPandas(read, "path string, scores array<double>, table boolean").groupBy(F.col("path").alias("_path")).agg(F.max(F.struct("scores", "table")).alias("_t"))
    one = one_per_key(files, ["id"], ["path", "absolute_path"], "updated_at").select(F.col("id").alias("file_id"), F.coalesce(_clean(), F.lit("")).alias("path"), F.coalesce("absolute_path", F.lit("")).alias("absolute_path"))
    joined = one.join(scored, F.col("path") == F.col("_path"), "left").select("file_id", "path", "absolute_path", F.col("_t.scores").alias("scores"), F.col("_t.table").alias("table"))
    return joined.mapInPandas(judge, "file_id string, path string, kind string, score double")

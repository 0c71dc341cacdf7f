"""Evaluation passages inside a corpus: greedy string tiling over shared-token seeds (problem 7).

The items are a stated query set. They are cut into blocks of a bounded number of words; each block is
sent to the tasks once and every document is scanned against it where it lies, so the corpus is never
shuffled. Within a document, seeds (runs of SEED words shared with an item) pick the pairs, running
Karp-Rabin marks the longest non-overlapping matches, and the tiles are chained in both orders.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's words that one stretch must give.
COVERAGE = 1 / 3
#: At most one word in so many of a stretch is changed, added or left out.
EDIT_EVERY = 6
#: Words of a seed at most; short items have shorter ones, see seed_of().
SEED = 4
#: Shortest tile that Karp-Rabin marks, and the window that it starts with.
MIN_TILE, FIRST_TILE = 3, 16
#: Longest gap, in words of either side, that one stretch bridges.
MAX_GAP = 7
#: A sentence that at least this share of the items (and SHARED_LEAST items) have is introductory.
SHARED_SHARE, SHARED_LEAST = 0.02, 5
#: Words of items in one block: about 30 MB in a task.
BLOCK_WORDS = 1_000_000

SCHEMA = "doc_id bigint, item_id bigint, matched_words int, item_words int, first_word int, last_word int, in_order boolean"

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtbf\"'\\/])")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_HYPHEN = re.compile(r"(?<=\w)[-\u00ad\u2010]\r?\n[ \t>*#/|;]*(?=\w)")
#: What stands before the text of a quoted, commented, listed or numbered line.
_PREFIX = re.compile(r"(?m)^[ \t]*(?:(?:>|//+|#+|\*|-|\+|;|--|\||\d{1,4}[.):|])[ \t]*)+")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])


def words(text: str) -> list[str]:
    """The words of a text in small letters, without markup, escapes, line prefixes and punctuation."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("\u00ad\n", "")).translate(_INVISIBLE)
    if "-\n" in text or "-\r" in text:
        text = _HYPHEN.sub("", text)
    if "\n" in text:
        text = _PREFIX.sub("", text)
    return _WORD.findall(text.lower())


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, n, " ".join(words(s))) for i, t in zip(batch.item_id, batch.text) for n, s in enumerate(_SENTENCE.split(t))]
        yield pd.DataFrame(rows, columns=["item_id", "n", "sentence"])


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): the counted words of each item, its widely shared sentences left out.

    Repeated rows of an id are one item; null ids and texts are left out, and so are items of which
    nothing remains.
    """
    rows = items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item_id")).agg(F.max(text_col).alias("text"))
    sentences = rows.mapInPandas(_sentences, "item_id bigint, n int, sentence string").filter("sentence <> ''")
    total = rows.agg(F.count("*").alias("_total"))
    owners = sentences.select("item_id", "sentence").distinct().groupBy("sentence").agg(F.count("*").alias("_owners"))
    shared = owners.join(F.broadcast(total), F.col("_owners") >= F.greatest(F.lit(SHARED_LEAST), F.col("_total") * SHARED_SHARE)).select("sentence")
    kept = sentences.join(shared, "sentence", "left_anti")
    return kept.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ").alias("words"))


def seed_of(size: int) -> int:
    """Words of the seeds of an item with so many counted words, so that seeds lose nothing.

    A stretch that counts has m >= size / 3 matched words with e <= m / 5 edits, so its longest run of equal
    words has at least m / (e + 1) of them: 4 from m = 7 on (items of 19 words), below that 3 or 2. An item of
    less than 4 words must stand there as a whole (0), as one word of it says nothing.
    """
    if size < 4:
        return 0
    least = -(-size // 3)  # at COVERAGE
    return min(SEED, min(-(-m // (m // (EDIT_EVERY - 1) + 1)) for m in range(least, least + 30)))


class Block:
    """The seeds of some items, and the tiling of one document against them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w.split(" ")) for i, w in items]
        self.vocabulary: dict[str, int] = {}
        self.ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int64) for _, ws in self.items]
        self.sets = [frozenset(ids.tolist()) for ids in self.ids]
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 2**62, SEED, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.seed = [seed_of(len(ids)) for ids in self.ids]
        self.short = [n for n, k in enumerate(self.seed) if not k]
        self.seeds: dict[int, dict[int, list[int]]] = {}  # by length, then by hash
        for n, (k, ids) in enumerate(zip(self.seed, self.ids)):
            if k:
                own = self.seeds.setdefault(k, defaultdict(list))
                for h in set(self._hashes(ids, np.arange(len(ids) - k + 1), k).tolist()):
                    own[h].append(n)
        self.sorted = {k: np.array(sorted(own), dtype=np.uint64) for k, own in self.seeds.items()}

    def _hashes(self, ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        u = ids.astype(np.uint64)
        h = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                h = (h ^ (u[at + k] * self.factors[k])) * np.uint64(0x9E3779B97F4A7C15)
        return h

    def scan(self, texts: list[str | None], reordered: bool = False) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """(row, item number, matched words, first, last word, in order) of every affected row of a batch."""
        get = self.vocabulary.get
        flat: list[int] = []
        starts = []
        gap = [0] * SEED
        for text in texts:
            starts.append(len(flat))
            if text:
                flat.extend([get(w, 0) for w in words(text)])
            flat.extend(gap)
        ids = np.array(flat, dtype=np.int64)
        starts = np.array([*starts, len(flat)])
        if self.short:
            yield from self._scan_short(ids, starts)
        known = ids > 0
        for length, seeds in self.seeds.items():
            full = np.ones(max(0, len(ids) - length + 1), dtype=bool)
            for k in range(length):
                full &= known[k : k + len(full)]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            h = self._hashes(ids, at, length)
            where = np.minimum(np.searchsorted(self.sorted[length], h), len(self.sorted[length]) - 1)
            hit = self.sorted[length][where] == h
            at, h = at[hit], h[hit]
            row_of = np.searchsorted(starts, at, side="right") - 1
            pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, v, r in zip(at.tolist(), h.tolist(), row_of.tolist()):
                for n in seeds[v]:
                    pairs[r, n].append(p)
            for (r, n), hits in pairs.items():
                best = self._best(ids, hits, n, starts[r], starts[r + 1] - SEED, reordered)
                if best:
                    yield (r, n, *best)

    def _scan_short(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Items with fewer counted words than a seed: all of them, as they stand."""
        for n in self.short:
            want = self.ids[n]
            at = np.flatnonzero(ids[: len(ids) - len(want) + 1] == want[0])
            for k in range(1, len(want)):
                at = at[ids[at + k] == want[k]]
            rows = np.searchsorted(starts, at, side="right") - 1
            for r, first in sorted({int(r): int(p) for r, p in zip(rows[::-1], at[::-1])}.items()):
                yield r, n, len(want), first - int(starts[r]), first - int(starts[r]) + len(want) - 1, True

    def _best(self, ids: np.ndarray, hits: list[int], n: int, low: int, high: int, reordered: bool) -> tuple[int, int, int, bool] | None:
        """The best stretch of one document for item n, if it gives enough of it; with `reordered`, failing that, the
        stretch that gives most of it in any order."""
        item = self.ids[n].tolist()
        need = len(item) * COVERAGE
        seed = self.seed[n]
        reach = 2 * seed + MAX_GAP + MAX_GAP * 2
        begin = 0
        best = loose = None
        covered, last, run, longest = 0, -seed, 0, 0
        for k in range(1, len(hits) + 1):
            covered += min(seed, hits[k - 1] - last)
            run = run + 1 if hits[k - 1] == last + 1 else seed
            longest, last = max(longest, run), hits[k - 1]
            if k < len(hits) and hits[k] - hits[k - 1] <= reach:
                continue
            a, b = max(low, hits[begin] - reach), min(high, hits[k - 1] + seed + reach)
            begin = k
            enough, wide = covered, longest
            covered, last, run, longest = 0, -seed, 0, 0
            # Of m matched words in e + 1 <= m / 5 + 1 runs, less than a seed's a run lie in runs without a seed.
            if enough < need - (seed - 1) * (need / (EDIT_EVERY - 1) + 1):
                continue
            left = ids[a:b].tolist()
            if not _dense(left, self.sets[n], need):
                continue
            chain = tiles(left, item, min(MIN_TILE, seed), wide)
            found = stretch(left, item, chain)
            if found and found[0] >= need and (best is None or found[0] > best[0]):
                best = (found[0], int(a - low + found[1]), int(a - low + found[2]), True)
            found = coverage(chain) if reordered else None
            if found and found[0] >= need and (loose is None or found[0] > loose[0]):
                loose = (found[0], int(a - low + found[1]), int(a - low + found[2]), False)
        return best or loose


def _dense(left: list[int], words: frozenset[int], need: float) -> bool:
    """Whether some stretch of the left holds enough of an item's words among few others: without one nothing counts."""
    total = inside = 0
    lows, before = [0], [0]  # least sums so far, falling, negated for bisect; words inside before them
    for x in left:
        if x in words:
            total += 1
            inside += 1
            if inside >= need and inside - before[bisect.bisect_left(lows, -total)] >= need:
                return True
        else:
            total -= EDIT_EVERY - 1
            if -total > lows[-1]:
                lows.append(-total)
                before.append(inside)
    return False


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _windows(seq: list[int], used: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of every window of `size` words of which none is marked, by a rolling hash."""
    top = pow(_BASE, size - 1, _PRIME)
    h = begin = 0
    for i, x in enumerate(seq):
        if used[i]:
            h, begin = 0, i + 1
            continue
        if i - begin >= size:
            h -= seq[i - size] * top
        h = (h * _BASE + x) % _PRIME
        if i - begin >= size - 1:
            yield i - size + 1, h


def tiles(left: list[int], right: list[int], least: int = MIN_TILE, longest: int = FIRST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start left, start right, length) of the longest non-overlapping matches.

    Running Karp-Rabin: rolling hashes of the unmarked windows of both sides meet in a table, equal windows are
    compared and extended over unmarked words. The longest matches are marked first; the window starts wide (no wider
    than `longest`, if no match is known to be longer) and is halved down to `least`. A 0 on the left is a word that no
    item has.
    """
    used_left, used_right = bytearray(not x for x in left), bytearray(len(right))
    out = []
    size = max(least, min(FIRST_TILE, longest, len(left), len(right)))
    while True:
        index: dict[int, list[int]] = defaultdict(list)
        for j, h in _windows(right, used_right, size):
            index[h].append(j)
        found: list[tuple[int, int, int]] = []
        for i, h in _windows(left, used_left, size) if index else ():
            for j in index.get(h, ()):
                if i and j and left[i - 1] == right[j - 1] and not used_left[i - 1] and not used_right[j - 1]:
                    continue  # not maximal
                k = 0
                while i + k < len(left) and j + k < len(right) and left[i + k] == right[j + k] and not used_left[i + k] and not used_right[j + k]:
                    k += 1
                if k >= size:
                    found.append((k, i, j))
        again = False
        found.sort(key=lambda x: (-x[0], x[1], x[2]))
        for n, (k, i, j) in enumerate(found):
            if any(used_left[i : i + k]) or any(used_right[j : j + k]):
                again = True  # what is left of it may still be long enough
                continue
            used_left[i : i + k] = used_right[j : j + k] = b"\1" * k
            out.append((i, j, k))
        if again and found:
            continue
        if size == least:
            return sorted(out)
        size = max(least, size // 2)


def _common(left: list[int], right: list[int]) -> int:
    """Longest common subsequence of two short gaps."""
    row = [0] * (len(right) + 1)
    for x in left:
        before = 0
        for j, y in enumerate(right, 1):
            before, row[j] = row[j], before + 1 if x == y and x else max(row[j], row[j - 1])
    return row[-1]


def stretch(left: list[int], right: list[int], chain: list[tuple[int, int, int]] | None = None) -> tuple[int, int, int] | None:
    """(matched words, first, last word in left) of the best chain of tiles, in the order of both sides.

    Consecutive tiles may be up to MAX_GAP words apart. Of the chains that end with a tile, the one with most
    matched words is kept for each number of edits, unless fewer edits give as many; so a weak flank never hides
    what passes without it. A chain's edits must keep to one in EDIT_EVERY words.
    """
    chain = tiles(left, right) if chain is None else chain
    best = None
    states: list[dict[int, tuple[int, int]]] = []  # by edits: matched, first
    for n, (i, j, k) in enumerate(chain):
        own = {0: (k, i)}
        for m in range(n):
            pi, pj, pk = chain[m]
            gap_left, gap_right = i - pi - pk, j - pj - pk
            if gap_left < 0 or gap_right < 0 or gap_left > MAX_GAP or gap_right > MAX_GAP:
                continue
            same = _common(left[pi + pk : i], right[pj + pk : j]) if gap_left and gap_right else 0
            edits = max(gap_left, gap_right) - same
            for before, (matched, first) in states[m].items():
                new = (matched + k + same, first)
                if new > own.get(before + edits, (0, 0)):
                    own[before + edits] = new
        kept: dict[int, tuple[int, int]] = {}
        most = 0
        for edits in sorted(own):
            if own[edits][0] > most:
                most = own[edits][0]
                kept[edits] = own[edits]
        states.append(kept)
        for edits, (matched, first) in kept.items():
            if edits * EDIT_EVERY < matched + edits and (best is None or matched > best[0]):
                best = (matched, first, i + k - 1)
    return best


def coverage(chain: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """(matched words, first, last word in left) of the best stretch of tiles in any order on the right: reordered
    passages. Between its tiles, up to MAX_GAP words apart, stands at most one other word in EDIT_EVERY."""
    best = None
    runs: list[list[tuple[int, int]]] = []
    for i, _, k in chain:
        if runs and i - runs[-1][-1][0] - runs[-1][-1][1] <= MAX_GAP:
            runs[-1].append((i, k))
        else:
            runs.append([(i, k)])
    for run in runs:
        # The longest stretch whose words in tiles outweigh the others: prefix sums, each held against the least before it.
        total, lows = 0, [(0, run[0][0], 0)]
        matched = 0
        for n, (i, k) in enumerate(run):
            if n:
                gap = i - run[n - 1][0] - run[n - 1][1]
                total -= gap * (EDIT_EVERY - 1)
                if total < lows[-1][0]:
                    lows.append((total, i, matched))
            total += k
            matched += k
            low = next(x for x in lows if x[0] <= total)
            if best is None or matched - low[2] > best[0]:
                best = (matched - low[2], low[1], i + k - 1)
    return best


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", reordered: bool = False) -> DataFrame:
    """One row per document and item it gives away: matched and counted words, and where the stretch lies.

    With `reordered`, stretches that give enough of an item in another order are reported too (in_order is false).
    Null and empty texts give nothing. Repeated documents are reported each. Other columns do not matter.
    """
    spark = documents.sparkSession
    counted = item_words(items)
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in counted.toLocalIterator():
        n = row["words"].count(" ") + 1
        if size + n > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], row["words"]))
        size += n
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text <> ''")
    out = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            held = Block(sent.value)
            for batch in batches:
                keys = batch.doc_id.to_numpy()
                rows = [(keys[r], held.items[n][0], m, len(held.ids[n]), a, b, o) for r, n, m, a, b, o in held.scan(batch.text.tolist(), reordered)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        part = source.mapInPandas(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def report(found: DataFrame) -> DataFrame:
    """One row per affected document: how many items it gives away, which, how many of them only in another order,
    and the most of any."""
    share = F.col("matched_words") / F.col("item_words")
    one = found.groupBy("doc_id", "item_id").agg(F.max(share).alias("share"), F.max("in_order").alias("in_order"))
    return one.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if(~F.col("in_order")).alias("n_reordered"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"), F.round(F.max("share"), 4).alias("most"))

"""Texts into containers of a fixed number of tokens (problem 6): hierarchical residual packing.

Each task packs its items best-fit, largest first, a bounded number at a time, and emits the containers
that are nearly full. Underfull containers go on as items: partitions are merged by a tree, a few at a time,
and packed again, until one task holds what little remains. An item is never split unless it alone exceeds
the capacity; then all its pieces but the last fill containers of their own.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import Cuts

#: Rank file of the public tokenizer, and the pattern it was made for (a fixed value).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that one best-fit run holds, and the share of its capacity from which a container is done.
CHUNK, NEARLY_FULL = 20_000, 0.995
#: Partitions that a round of the tree merges into one.
FAN_IN = 8

ITEMS = "limit_name string, capacity bigint, doc_id bigint, piece int, first_token bigint, tokens bigint, container string, done boolean"


@lru_cache(maxsize=2)
def tokenizer(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(ranks: str, text: str) -> int:
    return len(tokenizer(ranks).encode_ordinary(text))


def pieces(tokens: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, first token, tokens): one, or as many full ones as an oversized text takes and its rest."""
    if tokens <= capacity:
        yield 0, 0, tokens
        return
    for n, first in enumerate(range(0, tokens, capacity)):
        yield n, first, min(capacity, tokens - first)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers: largest items first, each into the fullest container that takes it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rooms: list[tuple[int, int]] = []  # (room left, container), sorted
    out: list[list[int]] = []
    for i in order:
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, n = rooms.pop(at)
            out[n].append(i)
            left = room - sizes[i]
        else:
            n, left = len(out), capacity - sizes[i]
            out.append([i])
        if left:
            bisect.insort(rooms, (left, n))
    return out


def _first_round(ranks: str, limits: list[tuple[str, int]]):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        numbers = {name: 0 for name, _ in limits}
        held: dict[str, list[tuple[int, int, int, int]]] = {name: [] for name, _ in limits}
        columns = [c.split()[0] for c in ITEMS.split(", ")]
        out: list[tuple] = []

        def flush(name: str, capacity: int) -> None:
            items, held[name] = held[name], []
            for own in best_fit([x[3] for x in items], capacity):
                fill = sum(items[i][3] for i in own)
                numbers[name] += 1
                container = f"{part}-{numbers[name]}"
                out.extend((name, capacity, *items[i], container, fill >= capacity * NEARLY_FULL) for i in own)

        for batch in batches:
            for key, text in zip(batch.doc_id.tolist(), batch.text):
                n = count_tokens(ranks, text)
                if not n:
                    continue
                for name, capacity in limits:
                    for piece, first, tokens in pieces(n, capacity):
                        held[name].append((key, piece, first, tokens))
                    if len(held[name]) >= CHUNK:
                        flush(name, capacity)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        for name, capacity in limits:
            flush(name, capacity)
        yield pd.DataFrame(out, columns=columns)

    return pack


def _next_round(step: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Underfull containers (limit_name, capacity, container, fill) to (limit_name, container, target, fill, done)."""
        part = TaskContext.get().partitionId()
        held: dict[tuple[str, int], list[tuple[str, int]]] = {}
        number = 0
        out: list[tuple] = []
        columns = ["limit_name", "capacity", "container", "target", "fill", "done"]

        def flush(key: tuple[str, int]) -> None:
            nonlocal number
            items = held.pop(key)
            for own in best_fit([f for _, f in items], key[1]):
                fill = sum(items[i][1] for i in own)
                number += 1
                target = f"r{step}-{part}-{number}"
                out.extend((*key, items[i][0], target, fill, fill >= key[1] * NEARLY_FULL) for i in own)

        for batch in batches:
            for name, capacity, container, fill in batch[["limit_name", "capacity", "container", "fill"]].itertuples(index=False, name=None):
                key = (name, int(capacity))
                held.setdefault(key, []).append((container, int(fill)))
                if len(held[key]) >= CHUNK:
                    flush(key)
        for key in list(held):
            flush(key)
        yield pd.DataFrame(out, columns=columns)

    return pack


def pack(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(limit_name, capacity, container, doc_id, piece, first_token, tokens): every text in a container of each size.

    Null and empty texts take no room and are left out; limits without a name or with no positive
    capacity are ignored, of a repeated name the largest capacity holds. With no limits the result is
    empty. The limits are a small stated table, at most 1000 rows; more raise an error.
    """
    spark = documents.sparkSession
    wanted = limits.filter("limit_name is not null and capacity_tokens > 0").groupBy("limit_name").agg(F.max("capacity_tokens").alias("c")).orderBy("limit_name").limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("pack() takes at most 1000 container sizes at once")
    sizes = [(r["limit_name"], int(r["c"])) for r in wanted]
    cuts = Cuts(spark, "packing")
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text <> ''")
    items = cuts.cut(source.mapInPandas(_first_round(ranks, sizes), ITEMS))
    under = items.filter("not done").groupBy("limit_name", "capacity", "container").agg(F.sum("tokens").alias("fill"))
    parts = max(1, source.rdd.getNumPartitions())
    rest = cuts.cut(under)
    left = rest.count()
    step = 0
    # Where each underfull container of the first round has gone: containers only, composed round by round.
    gone: DataFrame | None = None
    while left:
        step += 1
        # One task holds at most a few runs' worth. The tree goes on until one task holds all that is left; if that is too
        # much for one, until other neighbours bring no more than one container in a thousand together.
        wide, parts = parts, max(1, -(-parts // FAN_IN), -(-left // (4 * CHUNK)))
        # One hash for all sizes; another one in each round, so that others meet.
        spread = rest.repartition(parts, F.pmod(F.xxhash64("container", F.lit(step)), F.lit(parts)))
        moved = cuts.cut(spread.mapInPandas(_next_round(step), "limit_name string, capacity bigint, container string, target string, fill bigint, done boolean"))
        ahead = moved.select(F.col("limit_name").alias("_limit"), F.col("container").alias("_from"), F.col("target").alias("_to"))
        if gone is None:
            gone = cuts.cut(moved.select("limit_name", F.col("container").alias("first"), F.col("target").alias("last")))
        else:
            before = gone
            gone = cuts.cut(before.join(ahead, (F.col("limit_name") == F.col("_limit")) & (F.col("last") == F.col("_from")), "left").select("limit_name", "first", F.coalesce("_to", "last").alias("last")))
            cuts.drop(before)
        rest = cuts.cut(moved.filter("not done").groupBy("limit_name", "capacity", F.col("target").alias("container")).agg(F.max("fill").alias("fill")))
        was, left = left, rest.count()
        if parts == 1 or parts == wide and left > was * 0.999:
            break
    out = items
    if gone is not None:  # the items are joined once; those of full containers keep their name
        ahead = gone.select(F.col("limit_name").alias("_limit"), F.col("first").alias("_from"), F.col("last").alias("_to"))
        out = out.join(ahead, (F.col("limit_name") == F.col("_limit")) & (F.col("container") == F.col("_from")), "left").withColumn("container", F.coalesce("_to", "container"))
    return out.select("limit_name", "capacity", "container", "doc_id", "piece", "first_token", "tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """(limit_name, capacity, n_containers, n_items, tokens, fill): how well each size is used."""
    per = packed.groupBy("limit_name", "capacity", "container").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return per.groupBy("limit_name", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * F.col("capacity")), 5).alias("fill"))

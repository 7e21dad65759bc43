"""Best-fit packing into bins of several permitted lengths.

Documents longer than the largest permitted length are cut into pieces of that length and a rest. Pieces
are dealt over shards by a hash of their row's number, about `SHARD` to a shard however many there are; only
keys and lengths move. In a shard, longest first, each piece goes to the open bin it leaves the least
room in. If none has room, a bin is opened of the permitted length that costs least per token it can
still expect to hold: a bin of capacity c costs `overhead + c + c * c * attention`, and can expect its
first piece and, of what is left to place, the pieces that fit beside it. With the defaults a step costs as
much as 256 tokens, and attention as much as the tokens themselves at 4096, so that about 1024 is cheapest to
fill. At the end each bin is downsized to the smallest permitted length that holds its contents.

The lengths are chosen jointly: a shard is packed with all lengths open to choice and with a preference for
each single one (larger ones then only for what needs them), and the packing of the least total cost stays.
So a shard never costs more than with the best single length.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

LENGTHS, SHARD, OVERHEAD, ATTENTION = (512, 1024, 2048, 4096), 20_000, 256.0, 1 / 4096
#: A token of the default measure: a run of letters and digits, or one other sign that isn't white space.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"


def token_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(TOKEN)).cast("long")


def bin_cost(capacity: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return overhead + capacity + capacity * capacity * attention


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's final capacity for each piece: the cheapest of the joint packing and those that
    prefer one length. Sizes are at most the largest length."""
    best, least = None, None
    for prefer in (None, *sorted(lengths)) if len(lengths) > 1 else (None,):
        found = _pack(sizes, lengths, overhead, attention, prefer)
        where, _, final = found
        total = sum(bin_cost(int(c), overhead, attention) for c in final[np.unique(where, return_index=True)[1]])
        if least is None or total < least - 1e-6:
            best, least = found, total
    return best


def _pack(sizes: np.ndarray, lengths: tuple[int, ...], overhead: float, attention: float, prefer: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One best-fit pass. prefer: the length to open, or the next one that holds the piece."""
    lengths = sorted(lengths)
    top = lengths[-1]
    cost = {c: bin_cost(c, overhead, attention) for c in lengths}
    order = np.argsort(-sizes, kind="stable")
    # tokens not yet placed in pieces of at most so many tokens: sizes fall, so a prefix sum by size does
    tokens_to = np.concatenate([[0], np.cumsum(np.bincount(sizes, minlength=top + 1) * np.arange(top + 1))])
    placed_at = np.zeros(top + 2, np.int64)
    rooms: list[list[int]] = [[] for _ in range(top + 1)]
    free: list[int] = []  # rooms that some open bin has, sorted
    capacity: list[int] = []
    used: list[int] = []
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        n = int(sizes[i])
        k = bisect_left(free, n)
        if k < len(free):
            room = free[k]
            b = rooms[room].pop()
            if not rooms[room]:
                free.pop(k)
        else:
            # what is still to come has at most n tokens a piece, less those of size n already placed
            def expect(c: int) -> float:
                space = c - n
                small = tokens_to[min(space, n) + 1] - (placed_at[n] + n if space >= n else 0)
                return n + min(space, max(small, 0))

            c = min((c for c in lengths if c >= n), key=lambda c: (cost[c] / max(expect(c), 1), c)) if prefer is None else lengths[bisect_left(lengths, max(n, prefer))]
            b, room = len(capacity), c
            capacity.append(c), used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        placed_at[n] += n
        room -= n
        if room:
            if not rooms[room]:
                free.insert(bisect_left(free, room), room)
            rooms[room].append(b)
    final = np.array([lengths[bisect_left(lengths, u)] for u in used], np.int64)
    return where, offset, final[where] if len(final) else where


def best_fit(docs: DataFrame, key: str = "doc_id", text: str = "text", size: Column | None = None, lengths: tuple[int, ...] = LENGTHS, shard: int = SHARD, overhead: float = OVERHEAD, attention: float = ATTENTION) -> DataFrame:
    """One row per piece: key, piece, first (its first token in the document), n_tokens, bin_id, position
    (its first token in the bin), bin_tokens (capacity after downsizing).

    size: the length of each row, by default its token count. Rows of null or empty text have no tokens
    and one piece of length 0, which shares a bin without taking room. Rows that repeat a key are packed
    each for itself, as are rows with a null key. Other columns are ignored.
    """
    top = max(lengths)
    counted = cut(docs.select(F.col(key).alias("__id"), F.monotonically_increasing_id().alias("__row"), F.greatest(F.coalesce(size if size is not None else token_count(text), F.lit(0)), F.lit(0)).cast("long").alias("__n")))
    pieces = counted.select(
        "__id", "__row", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("__n") / top) - 1, F.lit(0).cast("long")))).alias("piece")
    ).withColumn("n", F.least(F.col("__n") - F.col("piece") * top, F.lit(top)).cast("long"))
    total = counted.agg(F.sum(F.greatest(F.ceil(F.col("__n") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    # by the row and not by its key: null and repeated keys are spread like all others
    placed = pieces.select("__id", "piece", "n", F.pmod(F.xxhash64("__row", "piece"), F.lit(shards)).cast("long").alias("shard"))
    kind = docs.schema[key].dataType.simpleString()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "__id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        where, offset, capacity = pack(group["n"].to_numpy(np.int64), lengths, overhead, attention)
        return pd.DataFrame(
            {key: group["__id"], "piece": group["piece"], "first": group["piece"] * top, "n_tokens": group["n"], "bin_id": [f"{s}-{b}" for s, b in zip(group["shard"], where, strict=True)], "position": offset, "bin_tokens": capacity}
        )

    return placed.groupBy("shard").applyInPandas(fill, f"`{key}` {kind}, piece long, first long, n_tokens long, bin_id string, position long, bin_tokens long")

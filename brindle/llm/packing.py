"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

How few bins are needed depends on how many pieces of each length there are, so the instance is the histogram of
lengths: at most ``capacity`` rows whatever the corpus. It is counted by Spark, reduced and packed on the
driver, and each piece then finds its place by its rank among the pieces of its length.

* Dominance reduction: a set {j} or {j, i} is fixed for good where any other set with piece j could be exchanged for
  it without needing more bins: (1) nothing fits beside j; (2) the largest i beside j fills the bin, or no two pieces
  fit beside j; (3) at most two fit beside j and i is as long as the best pair. All equal cases are fixed at once.
* The remainder is packed by best-fit decreasing, taking equal lengths and equal bins together.

Defined cases: null text is empty and takes one token (the end id); repeated rows are packed each; a null doc_id
counts as an id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import gapless, keyed, table, tidy, unkeyed

CAPACITY = 4096
END_ID = 1
SLICE = 256  # texts encoded together, which bounds the memory of a batch


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32: the token pieces of each document, the end id included."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from brindle.llm.tokens import ChunkEncoder

        encode, end = ChunkEncoder(tokenizer).encode, np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                out = []
                for key, ids in zip(part["id"], encode(part["text"].tolist())):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s : s + 4 * capacity]
                        out.append((key, k, s // 4, len(own) // 4, zlib.crc32(own)))
                yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    return keyed(docs).mapInPandas(tidy(pieces), "id long, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed sets with how often each is taken, and the counts that remain."""
    left = {w: n for w, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: dict[tuple[int, ...], int] = defaultdict(int)

    def take(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w]
            sizes.pop(bisect.bisect_left(sizes, w))

    def beside(room: int, w: int) -> int | None:
        """The largest size that fits in ``room`` beside one piece of size ``w``."""
        k = bisect.bisect_right(sizes, room) - 1
        while k >= 0 and sizes[k] == w and left[w] < 2:
            k -= 1
        return sizes[k] if k >= 0 else None

    def smallest(w: int, many: int) -> int | None:
        """The sum of the ``many`` smallest pieces apart from one of size ``w``."""
        total = 0
        for s in sizes:
            n = min(many, left[s] - (s == w))
            total, many = total + n * s, many - n
            if not many:
                return total
        return None

    def best_pair(room: int, w: int) -> int:
        """The largest sum of two pieces that fit in ``room`` beside one of size ``w``; 0 if none do."""
        best, low, high = 0, 0, bisect.bisect_right(sizes, room) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            need = (2 if a == b else 1) + (a == w)
            if left[a] < need or (b == w and a != b and left[b] < 2):
                low, high = (low + 1, high) if left[a] < need else (low, high - 1)
                if a == b:
                    break
                continue
            if a + b <= room:
                best, low = max(best, a + b), low + 1
            else:
                high -= 1
        return best

    for w in sorted(left, reverse=True):
        while left.get(w):
            room = capacity - w
            i = beside(room, w)
            if i is None:
                n = left[w] if room < w else 1
                fixed[(w,)] += n
                take(w, n)
                continue
            two, three = smallest(w, 2), smallest(w, 3)
            alone = two is None or two > room
            few = three is None or three > room
            if i == room or alone or (few and i >= best_pair(room, w)):
                n = left[w] // 2 if i == w else min(left[w], left[i])
                if i != room and not alone:
                    n = 1  # the reason may change as pieces go
                fixed[(w, i)] += n
                take(w, n)
                take(i, n)
                continue
            break
    return list(fixed.items()), left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: bins as ((length, how many), ...) with how many bins are alike."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, bins]
    rooms: list[int] = []

    def add(room: int, pattern: tuple, bins: int) -> None:
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append([pattern, bins])

    for w in sorted(counts, reverse=True):
        todo, moved = counts[w], []
        while todo:
            k = bisect.bisect_left(rooms, w)
            if k < len(rooms):
                room = rooms[k]
                group = open_[room][-1]
                fit = room // w
                full = min(group[1], todo // fit)
                if full:
                    moved.append((room - fit * w, (*group[0], (w, fit)), full))
                    group[1] -= full
                    todo -= full * fit
                elif todo:
                    moved.append((room - todo * w, (*group[0], (w, todo)), 1))
                    group[1] -= 1
                    todo = 0
                if not group[1]:
                    open_[room].pop()
                    if not open_[room]:
                        rooms.pop(k)
            else:
                fit = capacity // w
                if todo // fit:
                    moved.append((capacity - fit * w, ((w, fit),), todo // fit))
                if todo % fit:
                    moved.append((capacity - (todo % fit) * w, ((w, todo % fit),), 1))
                todo = 0
        for room, pattern, bins in moved:
            add(room, pattern, bins)
    return [(pattern, bins) for groups in open_.values() for pattern, bins in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces per bin, first sequence, offset), by first rank. Its size is bounded by
    the capacity (each length splits at most one group of bins), not by the corpus."""
    fixed, rest = reduce_instance(counts, capacity)
    bins = [(tuple((w, pattern.count(w)) for w in dict.fromkeys(pattern)), n) for pattern, n in fixed]
    bins += best_fit(rest, capacity)
    at, sequence = defaultdict(int), 0
    rows: dict[int, list] = defaultdict(list)
    for pattern, n in bins:
        offset = 0
        for w, q in pattern:
            rows[w].append((at[w], q, sequence, offset))
            at[w] += q * n
            offset += q * w
        sequence += n
    return {w: np.array(r, dtype=np.int64) for w, r in rows.items()}


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of every token piece."""
    pieces = table(spark, cut(docs, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    places = plan(counts, capacity)
    ranked = gapless(pieces, ["length"], ["id", "piece", "start", "ids_crc32"], sum(counts.values()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            rank, length = rows["rank"].to_numpy(), rows["length"].to_numpy()
            for w, own in rows.groupby("length").indices.items():
                p = places[w][np.searchsorted(places[w][:, 0], rank[own], side="right") - 1]
                inside = rank[own] - p[:, 0]
                sequence[own] = p[:, 2] + inside // p[:, 1]
                offset[own] = p[:, 3] + (inside % p[:, 1]) * length[own]
            yield rows.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.select(unkeyed().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

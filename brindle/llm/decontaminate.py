"""Benchmark decontamination by spaced-seed hashing.

Rule: a document is contaminated by a benchmark item if some ``WINDOW`` (13) successive words of the item stand in the
document, in place and order, with at most ``MISSES`` (2) of them replaced. Items of fewer words must stand there whole, with as large a
share of them replaced at most: one of 7 to 12 words, none of 1 to 6.
Words are runs of letters, digits and marks of the lower-cased text, compared by 64-bit hashes; punctuation, symbols and spaces
of any script part them, and a character of a script without spaces (``_ALONE``) is a word.

Method: a seed is the hash of the words at a mask's positions; the words between are ignored. For any two replaced words
in a window of 13, one of ``MASKS`` fits somewhere without touching either (checked in the tests for all 78 pairs), so
joining test seeds with training seeds misses nothing. An item of 7 to 12 words has seeds of half its words: one replaced word leaves
the first or the last half as it was. A shorter one is a seed. Each hit is then verified word by word around its place.

The documents are scanned once. A table of seed bits (64 times the seeds, 2 to 32 MB) lets a scan keep
only places that may match, as segments with 12 words around, and only these are shuffled for the equi-join of the seeds.

Defined cases: null text has no words; a null doc_id or item_id is an id of its own (item: left out of the list); repeated
rows get equal answers; rows of one doc_id with other texts are judged each by its own; without items nothing is contaminated; an empty
table gives an empty result; other columns are kept by :func:`clean_documents` and not read otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bytehash import LETTERED, Rolling, mix, word_bounds
from brindle.llm.common import id_of, keyed, node, table, tidy, unkeyed

WINDOW, MISSES = 13, 2
MASKS = ((0, 1, 2, 3, 7, 10), (0, 1, 3, 5, 6, 7))
BITS_LEAST, BITS_MOST = 24, 28
BITMAP = 1 << 15  # bits that Spark puts into one bitmap
BUFFER = 1 << 20
AROUND = WINDOW - 1


#: Scripts without spaces: Thai and Lao, Myanmar, Khmer, kana, Han.
_ALONE = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
_KIND = np.zeros(sys.maxunicode + 1, np.uint8)  # 1 parts words, 2 is a word
for _a, _b in _ALONE:
    _KIND[_a : _b + 1] = 2
for _c in range(0x80, 0x20000):  # no such characters beyond
    if unicodedata.category(chr(_c)) in ("Cc", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "Sc", "Sk", "Sm", "So", "Zl", "Zp", "Zs"):
        _KIND[_c] = 1


def prepared(text: str) -> bytes:
    """Lower-cased bytes in which runs of letters, digits and non-ASCII characters are the words."""
    text = text.lower()
    if text.isascii():
        return text.encode()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _KIND[code]
    if not kind.any():
        return text.encode()
    code = np.where(kind == 1, np.uint32(0x20), code)
    alone = np.flatnonzero(kind == 2)
    return np.insert(code, np.concatenate([alone, alone + 1]), 0x20).tobytes().decode("utf-32-le").encode()


def tolerance(n: int) -> int:
    """How many words of a window of n may be replaced."""
    return n * MISSES // WINDOW


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of n words."""
    if n >= WINDOW:
        return MASKS
    return (tuple(range(n // (tolerance(n) + 1))),) if n else ()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all :func:`prepared` texts one after another, and how many words each text has."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    start, stop = word_bounds(data, LETTERED)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    count = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return Rolling(data).slices(start, stop), count


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at each word where the mask's span fits, texts' limits not regarded."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask) * 2654435761 + sum(p << k for k, p in enumerate(mask)), np.uint64)
    for p in mask:
        total = (total + hashes[p : p + n]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total)


def _lists(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[f for f, _ in fields])


_L = pa.list_(pa.int64())


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, its words, its seeds with their places."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            w, _ = words([prepared(text)])
            found = [(h, p) for m in masks_of(len(w)) for p, h in enumerate(seeds(w, m).view(np.int64).tolist())]
            out.append((item, w.view(np.int64), [h for h, _ in found], [p for _, p in found], len(w)))
        yield _lists(out, [("item", pa.int64()), ("item_words", _L), ("h", _L), ("p", _L), ("n", pa.int64())])


def seed_bits(seed: DataFrame) -> tuple[bytes, int]:
    """A table with a bit set for the first bits of each seed's hash, and how many first bits. Spark makes it, as bitmaps; their number is bounded."""
    n = seed.select("h").distinct().count()
    bits = min(BITS_MOST, max(BITS_LEAST, (64 * n - 1).bit_length() if n else 0))
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    maps = seed.select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()  # 2^bits / BITMAP rows at most
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps:
        at = (r["k"] - 1) * (BITMAP // 8)
        table[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return table.tobytes(), bits


def _segments(table: bytes, bits: int, masks: list[tuple[int, ...]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(table, np.uint8)

        def found(ids: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
            w, count = words(texts)
            first = np.concatenate([[0], np.cumsum(count)])
            doc = np.repeat(np.arange(len(texts)), count)
            at, seed, span = [], [], []
            for m in masks:
                s = seeds(w, m)
                place = (s >> np.uint64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                hit = hit[doc[hit] == doc[hit + m[-1]]]
                at.append(hit), seed.append(s[hit].view(np.int64)), span.append(np.full(len(hit), m[-1] + 1))
            at, seed, span = np.concatenate(at), np.concatenate(seed), np.concatenate(span)
            order = np.argsort(at, kind="stable")
            at, seed, span = at[order], seed[order], span[order]
            out = []
            if len(at):
                new = np.flatnonzero((np.diff(at) > 2 * AROUND) | (doc[at[1:]] != doc[at[:-1]])) + 1
                for a, b in zip([0, *new], [*new, len(at)]):
                    d = doc[at[a]]
                    lo = max(first[d], at[a] - AROUND)
                    hi = min(first[d + 1], int((at[a:b] + span[a:b]).max()) + AROUND)
                    out.append((ids[d], int(lo - first[d]), w[lo:hi].view(np.int64), seed[a:b], at[a:b] - lo))
            return _lists(out, [("id", pa.binary()), ("at", pa.int64()), ("words", _L), ("h", _L), ("p", _L)])

        ids, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(key), texts.append(prepared(text))
                held += len(texts[-1])
                if held >= BUFFER:
                    yield found(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield found(ids, texts)

    return scan


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, at, words, item, item_words, shift): the overlaps that hold, as [start, stop) words of the document."""
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("id", "at", "item", "shift")]
        for key, at, item, shift, a, b in zip(*cols, batch.column("words"), batch.column("item_words")):
            a, b = np.asarray(a.values), np.asarray(b.values)
            lo, hi = max(0, shift), min(len(a), shift + len(b))  # shift: where the item's first word falls in the segment
            size = min(WINDOW, len(b))
            if hi - lo < size:
                continue
            same = np.concatenate([[0], np.cumsum(a[lo:hi] == b[lo - shift : hi - shift])])
            good = np.flatnonzero(same[size:] - same[:-size] >= size - tolerance(size))
            if len(good):
                out.append((key, item, at + lo + int(good[0]), at + lo + int(good[-1]) + size, int(same[good[-1] + size] - same[good[0]])))
        yield _lists(out, [("id", pa.binary()), ("item", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("matched", pa.int64())])


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, item, start, stop, matched): verified overlaps, id being the document's :func:`common.node`, places in words of the document."""
    items = table(spark, keyed(benchmark, "item_id").mapInArrow(_items, "item long, item_words array<long>, h array<long>, p array<long>, n long"), "items")
    seed = items.select("item", F.explode(F.arrays_zip("h", "p")).alias("s")).select("item", F.col("s.h").alias("h"), F.col("s.p").alias("p"))
    marks, bits = seed_bits(seed)
    short = sorted(r["n"] for r in items.where(F.col("n").between(1, WINDOW - 1)).select("n").distinct().collect())  # < WINDOW values
    masks = list(dict.fromkeys([*MASKS, *(m for n in short for m in masks_of(n))]))
    texts = docs.select(node(docs["doc_id"], docs["text"]).alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = table(spark, texts.mapInArrow(tidy(_segments(marks, bits, masks)), "id binary, at long, words array<long>, h array<long>, p array<long>"), "segments")
    hits = found.select("id", "at", F.explode(F.arrays_zip("h", "p")).alias("s")).select("id", "at", F.col("s.h").alias("h"), F.col("s.p").alias("q"))
    pairs = hits.join(seed, "h").select("id", "at", "item", (F.col("q") - F.col("p")).alias("shift")).distinct()
    both = pairs.join(found.select("id", "at", "words").dropDuplicates(["id", "at"]), ["id", "at"]).join(items.select("item", "item_words").distinct(), "item")
    return both.select("id", "at", "words", "item", "item_words", "shift").mapInArrow(tidy(_verify), "id binary, item long, start long, stop long, matched long")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_items, item_ids (sorted), n_words (of the longest overlap), kept."""
    by_doc = overlaps(spark, docs, benchmark).groupBy("id").agg(
        F.array_sort(F.collect_set(unkeyed("item"))).alias("item_ids"), F.count_distinct("item").alias("n_items"), F.max(F.col("stop") - F.col("start")).alias("n_words")
    )
    out = docs.select(node(docs["doc_id"], docs["text"]).alias("id")).join(by_doc, "id", "left")
    none = F.array().cast("array<bigint>")
    return out.select(
        id_of("id").alias("doc_id"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.col("n_items").isNull().alias("kept"),
    )


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = overlaps(spark, docs, benchmark).select(F.col("id").alias("_bad")).distinct()
    return docs.join(bad, node(docs["doc_id"], docs["text"]) == bad["_bad"], "left_anti")

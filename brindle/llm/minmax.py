"""Near-duplicate groups by min-max hashing.

A document's set is its distinct word shingles. Under each of ``PERMUTATIONS`` (64) hash permutations both the minimum and the
maximum are kept: 128 signature values for 64 evaluations, each equal for two sets with probability J. They are cut into 32
bands of 4 values from different permutations, so two sets of J = 0.8 share a band except once in 20 million.

1. Documents with one set (by a 128-bit digest of its sorted shingle hashes) form a class, named by its smallest document; classes go on, copies don't.
2. Star round: in each band bucket the classes are compared with its smallest one, on full sets. The links give components.
3. Cross round: a bucket whose classes are now in one component is done. In the others, classes outside the bucket's
   largest component are compared with the classes of all other components, in blocks, on full sets: a class's shingles are looked
   up among all those of the block, which counts its common shingles with every class at once. A block gives back links that
   connect, fewer than it has classes.

So every two classes that share a band are either compared exactly or already connected, and no list of all pairs arises in groups
of near copies. Buckets with the same classes are taken once. Groups of copies, buckets and stars are dealt over salts.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer words
than a shingle has one shingle, its whole sequence; rows that repeat a doc_id and text are one document, rows of one doc_id with other
texts are documents of their own, and of them the one first by a hash of the text is a group's smallest; a null doc_id is an id, the
smallest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bytehash import SPACED, Rolling, mix, word_bounds
from brindle.llm.common import beside, components, drop, id_of, node, salted_join, salts_in, table, tidy

PERMUTATIONS, BANDS = 64, 32
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000  # classes of a bucket, and their shingles, that are compared with as many others in one task
SALTS = 4096  # members of a star that one task compares with its centre, about
BUFFER, CACHED = 1 << 20, 1 << 16

_RNG = np.random.Generator(np.random.PCG64(11))
_XOR = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Columns (minima, then maxima) of each band: four different permutations, every value in one band.
_BAND = np.array([(k, PERMUTATIONS + (k + 13) % PERMUTATIONS, k + 32, PERMUTATIONS + (k + 45) % PERMUTATIONS) for k in range(BANDS)])


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after another, and how many each has."""
    data = np.frombuffer(b"\n".join([*(t.lower() for t in texts), b""]), np.uint8)  # bytes.lower(): A-Z only
    start, stop = word_bounds(data, SPACED)
    h = Rolling(data).slices(start, stop)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    words = np.diff(first)
    n = len(h) - k + 1
    docs, hashes = [], []
    if n > 0:
        doc = np.repeat(np.arange(len(texts)), words)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = (total + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        whole = doc[:n] == doc[k - 1 :]
        docs.append(doc[:n][whole]), hashes.append(mix(total[whole]))
    for d in np.flatnonzero((words > 0) & (words < k)):
        total = np.uint64(words[d])
        with np.errstate(over="ignore"):
            for x in h[first[d] : first[d + 1]]:
                total = (total + x) * np.uint64(0x9E3779B97F4A7C15)
        docs.append(np.array([d])), hashes.append(mix(np.array([total ^ np.uint64(0xABCDEF)])))
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    shingle = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    return shingle[new], np.bincount(doc[new], minlength=len(texts))


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of each non-empty set, in rows."""
    counts = counts[counts > 0]
    out = np.empty((len(counts), 2 * PERMUTATIONS), np.uint64)
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):  # a stretch that stays in the processor's cache
        base = ends[a] - counts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + CACHED, side="right")))
        part = shingles[base : ends[b - 1]]
        at = ends[a:b] - counts[a:b] - base
        for p in range(PERMUTATIONS):
            v = (part ^ _XOR[p]) * _MUL[p]
            out[a:b, p] = np.minimum.reduceat(v, at)
            out[a:b, PERMUTATIONS + p] = np.maximum.reduceat(v, at)
        a = b
    return out


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            ids.append(key), texts.append(text.as_buffer().to_pybytes())
            held += len(texts[-1])
            if held >= BUFFER:
                yield ids, texts
                ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def _scan(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _buffers(batches):
            shingles, counts = shingle_sets(texts, k)
            full = np.flatnonzero(counts)
            sig = signatures(shingles, counts)
            keys = np.zeros((len(full), BANDS), np.uint64)
            for c in range(_BAND.shape[1]):
                keys = mix(keys + sig[:, _BAND[:, c]])
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            ends = np.cumsum(counts)
            bands, digests = [None] * len(ids), [None] * len(ids)
            for j, d in enumerate(full):
                bands[d], digests[d] = keys[j], hashlib.blake2b(shingles[ends[d] - counts[d] : ends[d]], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"]
            )

    return scan


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _buffers(batches):
            shingles, counts = shingle_sets(texts, k)
            ends = np.cumsum(counts)
            parts = [shingles[e - c : e].tobytes() for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], names=["id", "shingles"])

    return sets


def _alike(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have percent / 100 of their union in common, exactly."""
    if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
        return False
    at = np.searchsorted(own, other)
    at[at == len(own)] = 0
    both = int((own[at] == other).sum())
    return 100 * both >= percent * (len(own) + len(other) - both)


def _compare(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b) from rows sorted by (centre, salt, is member): each member against the set before it."""
        centre, own = None, None
        for batch in batches:
            out = []
            for c, key, text in zip(batch.column("centre").to_pylist(), batch.column("id").to_pylist(), batch.column("shingles")):
                other = np.frombuffer(text.as_buffer(), np.uint64)
                if key == c:
                    centre, own = c, other.copy()
                elif c != centre:
                    raise ValueError("a member came without its centre")
                elif _alike(own, other, percent):
                    out.append((c, key))
            yield _pairs(out)

    return compare


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], names=["a", "b"])


def _links(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre, id) whose full sets are similar enough. Members of a large star are dealt over salts, each with a copy
    of the centre, by a hash of the member."""
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / SALTS).cast("int").alias("salts"))
    members = pairs.join(sizes, "centre").select("centre", "id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    centres = sizes.select("centre", F.col("centre").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = members.unionByName(centres).join(sets, "id").select("centre", "salt", "id", "shingles", (F.col("id") != F.col("centre")).alias("member"))
    return rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "member", "id").mapInArrow(tidy(_compare(percent)), "a binary, b binary")


_CELL = ("cell", "side", "id", "component", "shingles")


def _cross(rows: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the rows of side 0 and those of side 1 in other components, but for links that connect nothing new."""
    left, right = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
    if not left or not right:
        return []
    names = {c: k for k, c in enumerate(dict.fromkeys(r[3] for r in rows))}
    over = np.arange(len(names))  # component -> what it is connected with so far
    component = np.array([names[r[3]] for r in right])
    n = np.array([len(r[4]) // 8 for r in right])
    owner = np.repeat(np.arange(len(right)), n)
    every = np.frombuffer(b"".join(r[4] for r in right), np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    links = []
    for _, _, key, name, text in left:
        own, size = names[name], len(text) // 8
        alive = (over[component] != over[own]) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
        if not alive.any():
            continue
        mine = np.frombuffer(text, np.uint64)
        lo, hi = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
        times = hi - lo
        hits = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        both = np.bincount(owner[hits], minlength=len(right))
        for j in np.flatnonzero(alive & (100 * both >= percent * (size + n - both))).tolist():
            a, b = over[own], over[component[j]]
            if a != b:
                over[over == a] = b
                links.append((key, right[j][2]))
    return links


def _across(percent: int):
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links from rows sorted by (cell, side, id)."""
        rows: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in _CELL)):
                if rows and row[0] != rows[0][0]:
                    out += _cross(rows, percent)
                    rows = []
                rows.append(row)
            yield _pairs(out)
        yield _pairs(_cross(rows, percent))

    return across


def groups(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, component) of each row, id and component being nodes; all tables but the two that it is read from are removed."""
    if percent < 80:
        raise ValueError("the bands are chosen for similarities of 0.8 and more")
    texts = docs.select(node(docs["doc_id"], docs["text"]).alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    marks = table(spark, texts.mapInArrow(tidy(_scan(k)), "id binary, n long, digest binary, bands array<long>"), "marks")
    named = table(spark, beside(marks.where("n > 0").select("id", "digest").distinct(), ["digest"], "id", first=F.min("id")).select("id", "first"), "classes")
    leads = marks.select("id", "n", "bands").join(named.where("id = first").select("id"), "id").dropDuplicates(["id"])
    banded = leads.select("id", "n", F.explode("bands").alias("band"))
    found = beside(banded, ["band"], "id", centre=F.min("id"), many=F.count("id")).where("many > 1").select("id", "n", "band", "centre")
    found = table(spark, found, "buckets")
    star = found.where("id <> centre").select("centre", "id").distinct()
    in_doubt = found.select("id").distinct()
    sets = table(spark, texts.join(in_doubt, "id").dropDuplicates(["id"]).mapInArrow(tidy(_sets(k)), "id binary, shingles binary"), "sets")
    links = table(spark, _links(spark, star, sets, percent), "links")
    first = table(spark, components(spark, links), "components")

    # buckets that still hold several components; of those with the same classes, one
    placed = found.join(first, "id", "left").select("id", "n", "band", F.coalesce("component", "id").alias("component"))
    mark = F.xxhash64("id")
    parts = placed.groupBy("band", "component").agg(
        F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 40)).alias("y"), salts_in("id").alias("_in")
    )
    several = parts.groupBy("band").agg(
        F.max(F.struct("c", "component", "s")).alias("largest"), F.sum("c").alias("m"), F.sum("s").alias("s"), F.count("*").alias("parts"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"), F.bit_or("_in").alias("_in")
    )
    several = several.where("parts > 1").groupBy("m", "x", "y").agg(F.min(F.struct("band", "largest", "s", "_in")).alias("one"))
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    several = several.select(
        "one.band", F.col("one.largest.component").alias("largest"), blocks(F.col("m"), F.col("one.s")).alias("wide"),
        blocks(F.col("m") - F.col("one.largest.c"), F.col("one.s") - F.col("one.largest.s")).alias("high"), "one._in",
    )
    open_ = salted_join(placed, ["band"], "id", several, "_in")
    right = open_.select("id", "component", "band", F.pmod(mark, "wide").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("j"), F.lit(1).alias("side"))
    left = open_.where("component <> largest").select(
        "id", "component", "band", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), "high").cast("int").alias("j"), F.lit(0).alias("side")
    )
    cells = left.unionByName(right).select(F.xxhash64("band", "i", "j").alias("cell"), "side", "id", "component").join(sets, "id").select(*_CELL)
    more = table(spark, cells.repartition("cell").sortWithinPartitions("cell", "side", "id").mapInArrow(tidy(_across(percent)), "a binary, b binary"), "links")
    final = components(spark, first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    ends = named.groupBy("first").agg(salts_in("id").alias("_in")).join(final.withColumnsRenamed({"id": "first"}), "first", "left")
    ends = ends.select("first", F.coalesce("component", "first").alias("component"), "_in")
    where = table(spark, salted_join(named, ["first"], "id", ends, "_in").select("id", "component"), "components")
    drop(spark, found, sets, first, links, more, named)
    return marks.select("id", "n").join(where, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``."""
    out = groups(spark, docs, k, percent)
    return out.select(id_of("id").alias("doc_id"), F.col("n").alias("n_shingles"), id_of("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, but for documents that are near copies of a smaller document's group."""
    late = groups(spark, docs, k, percent).where("id <> component").select(F.col("id").alias("_late")).distinct()
    return docs.join(late, node(docs["doc_id"], docs["text"]) == late["_late"], "left_anti")

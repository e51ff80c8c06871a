"""Exact removal of repeated byte strings by distributed prefix doubling over runs of positions.

A byte goes if a string of ``length`` (100) bytes over it also starts earlier: in a smaller document, or earlier in
the same one. A suffix array would rank all positions by their first 1, 2, 4, ... bytes, sort the pairs of ranks at that offset and go on
with what isn't unique. :func:`position_ranks` does just that, one row a position. A row a position and round is some fifteen times the
text, so :func:`repeated_spans` keeps neighbouring positions together as long as they are decided together:

1. First ranks, at ``GRAM`` (50) bytes. Each window of 100 bytes is ranked by its least-hashed 50-gram, its anchor. Equal
   windows have equal anchors, so windows whose anchor occurs once are unique and leave at once. Neighbouring windows
   with one anchor form a run (26 on average) and are sorted as one row: (rank, content, position). Of runs with an equal whole content, by two
   independent 64-bit hashes, all but the first go.
2. Runs that share the rank but not the content are the frontier. They get their bytes and are sorted again by (rank
   of what all their windows share, bytes). A group of up to ``HALL`` contents is settled window by window. In a larger
   one each run is split at growing offsets from its anchor, the new rank being that of the pair (what was shared, what is shared in addition),
   50, 85, 97 and at last all 100 bytes; the parts are sorted again, and those that are alone in their rank are unique and leave.

The rows that are equal in a map batch are combined before the shuffle, groups stream through the sort, and no group is
held as a whole, whatever its size. In the frontier bytes decide, never hashes.

Defined cases: null text is empty; texts under 100 bytes lose nothing; a null doc_id comes before all others; rows that
repeat a doc_id and its text are one document (none of them removes the other, all get the same answer); rows of one doc_id with other
texts are documents of their own, in the order of a hash of the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bytehash import Rolling, mix, sliding_min
from brindle.llm.common import NO_ID, drop, fresh, keyed, table, tidy, unkeyed

LENGTH, GRAM = 100, 50
BUFFER, SEGMENT = 1 << 20, 1 << 20  # bytes hashed together; bytes of a long text taken at once
_PLACE = np.uint64((1 << 24) - 1)  # of a position in a buffer; the other bits choose the anchor
HALL = 2048  # contents of a group that are settled in memory

CELLS = (64, 16, 4, 1)  # places of a window before its anchor that are sorted as one: all, then fewer and fewer

#: code: the run's windows * 128 + the anchor's place in the run; negative: a run already known to go.
#: s, u: hashes of the run's content; id, t: the document, by doc_id and a hash of its text.
RUNS = "h long, s long, u long, id long, t long, lo long, code int"
FOUND = "h long, id long, t long, lo long, code int, settled boolean"
OPEN = "h long, run binary, id long, t long, lo long, off int"


def _runs(ids: list[int], ts: list[int], bases: list[int], parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """h, s, u, id, t, lo, code of the runs in a buffer of text segments; of equal runs, all but the first have code < 0 and are joined."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    rolling = Rolling(data)
    h = rolling.windows(GRAM)
    anchor = (sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(parts)), sizes)
    inside = doc[: len(anchor)] == doc[LENGTH - 1 :]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1]) | (inside[1:] != inside[:-1])) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
    lo, hi = lo[inside[lo]], hi[inside[lo]]
    at = anchor[lo]
    whole = rolling.slices(lo, hi - 1 + LENGTH) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    other = Rolling(data, 1).slices(lo, hi - 1 + LENGTH)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = doc[lo]
    key, text, place = np.array(ids, np.int64)[own], np.array(ts, np.int64)[own], lo - start[own] + np.array(bases, np.int64)[own]
    code = ((hi - lo) * 128 + at - lo).astype(np.int32)
    first = np.lexsort((place, text, key, other, whole))
    same = lambda x: x[first][1:] == x[first][:-1]
    again = np.concatenate([[False], same(whole) & same(other) & ~(same(key) & same(text) & same(place))])
    known = np.zeros(len(lo), bool)
    known[first[again]] = True
    h_out, s_out, u_out = h[at].view(np.int64), whole.view(np.int64), other.view(np.int64)
    # neighbouring runs that are known to go become one row, which goes anywhere: only its place matters from here on
    opens = known & ~np.concatenate([[False], known[:-1] & (own[1:] == own[:-1]) & (lo[1:] == hi[:-1])])
    rows = np.flatnonzero(opens)
    group = np.cumsum(opens) - 1
    windows = np.bincount(group[known], weights=(hi - lo)[known], minlength=len(rows)).astype(np.int64)
    anywhere = mix((key[rows] * np.int64(1_000_003) + place[rows]).view(np.uint64)).view(np.int64)
    keep, none = ~known, np.zeros(len(rows), np.int64)
    parts = (
        (h_out[keep], anywhere), (s_out[keep], none), (u_out[keep], none), (key[keep], key[rows]), (text[keep], text[rows]), (place[keep], place[rows]),
        (code[keep], (-windows * 128).astype(np.int32)),
    )
    return tuple(np.concatenate(p) for p in parts)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _runs(ids, ts, bases, parts)], names=["h", "s", "u", "id", "t", "lo", "code"])

    ids, ts, bases, parts, held = [], [], [], [], 0
    for batch in batches:
        for key, t, text in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), batch.column("text")):
            raw = text.as_buffer().to_pybytes()
            if len(raw) < LENGTH:
                continue
            for base in range(0, len(raw) - LENGTH + 1, SEGMENT):
                part = raw[base : base + SEGMENT + LENGTH - 1]
                ids.append(key), ts.append(t), bases.append(base), parts.append(part)
                held += len(part)
                if held >= BUFFER:
                    yield out()
                    ids, ts, bases, parts, held = [], [], [], [], 0
    if parts:
        yield out()


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (h, s, u, id, t, lo): those that go, and the first run of each content where a rank has several.

    Between batches only the last row, its content's first run and the rank's number of contents are kept."""
    last, first, contents, held = (None, None, None), (0, 0, 0), 0, None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "s", "u", "id", "t", "lo", "code")]
        known = rows[6] < 0
        out = [(rows[0][known], *(r[known] for r in rows[3:6]), -rows[6][known], np.ones(known.sum(), bool))]
        h, s, u, key, t, lo, code = (x[~known] for x in rows)
        if len(h):
            new_h = np.concatenate([[h[0] != last[0]], h[1:] != h[:-1]])
            new_s = new_h | np.concatenate([[s[0] != last[1] or u[0] != last[2]], (s[1:] != s[:-1]) | (u[1:] != u[:-1])])
            lead = np.maximum.accumulate(np.where(new_s, np.arange(len(h)), -1))
            firsts = [np.where(lead < 0, f, x[lead]) for f, x in zip(first, (key, t, lo))]
            goes = (key != firsts[0]) | (t != firsts[1]) | (lo != firsts[2])
            out.append((h[goes], key[goes], t[goes], lo[goes], code[goes], np.ones(goes.sum(), bool)))
            group = np.cumsum(new_h)  # 0: the rank that the last batch ended in
            leads = np.flatnonzero(new_s)
            count = np.bincount(group[leads], minlength=group[-1] + 1)
            if not new_h[0]:
                if contents == 1 and count[0]:
                    out.append(tuple(np.array([x]) for x in (*held, False)))
                count[0] += contents
            more = leads[count[group[leads]] > 1]
            out.append((h[more], key[more], t[more], lo[more], code[more], np.zeros(len(more), bool)))
            contents = min(2, count[group[-1]])
            if contents == 1 and group[-1]:
                k = leads[-1]
                held = (h[k], key[k], t[k], lo[k], code[k])
            last, first = (h[-1], s[-1], u[-1]), tuple(f[-1] for f in firsts)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, bool)
        cols = [np.concatenate(x).astype(k) for x, k in zip(zip(*out), kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "id", "t", "lo", "code", "settled"])


def _batch(rows: list[tuple], fields: tuple[tuple[str, pa.DataType], ...]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[f for f, _ in fields])


_OPEN = (("h", pa.int64()), ("run", pa.binary()), ("id", pa.int64()), ("t", pa.int64()), ("lo", pa.int64()), ("off", pa.int32()))


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frontier's runs with their bytes."""
    for batch in batches:
        out = []
        for key, t, text, runs in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("runs").to_pylist()):
            raw = text.as_buffer()
            out += [(r["h"], raw[r["lo"] : r["lo"] + (r["code"] >> 7) - 1 + LENGTH].to_pybytes(), key, t, r["lo"], r["code"] & 127) for r in runs]
        yield _batch(out, _OPEN)


def _split(h: int, run: bytes, key: int, t: int, lo: int, off: int, cell: int) -> Iterator[tuple]:
    """The parts of a run whose windows start in one cell of places before the anchor. A part's rank is that of the pair (rank of the run, bytes that
    all windows of the whole cell share). Cells are counted from the anchor, so equal windows of two runs fall into one."""
    n, k = len(run) - LENGTH + 1, 0
    while k < n:
        c = (off - k) // cell
        m = min(n, off - c * cell + 1)  # windows k to m - 1 lie in cell c
        shared = run[off - c * cell : off - (c + 1) * cell + 1 + LENGTH]
        rank = hashlib.blake2b(h.to_bytes(8, "little", signed=True) + shared, digest_size=8, key=bytes([c])).digest()
        yield int.from_bytes(rank, "little", signed=True), run[k : m - 1 + LENGTH], key, t, lo + k, off - k
        k = m


def _settle(cell: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by (h, run, id, t, lo): windows that go (run null, off how many), and the parts of the runs of
        large groups."""
        out: list[tuple] = []
        group: list[tuple] = []
        last_h, lead, large = None, None, False

        def close() -> None:
            seen: set[bytes] = set()
            for key, t, lo, run, _ in sorted(group) if len(group) > 1 else ():
                went = []
                for k in range(len(run) - LENGTH + 1):
                    w = run[k : k + LENGTH]
                    if w in seen:
                        went.append(k)
                    seen.add(w)
                for j, k in enumerate(went):
                    if j and went[j - 1] == k - 1:
                        out[-1] = (*out[-1][:5], out[-1][5] + 1)
                    else:
                        out.append((0, None, key, t, lo + k, 1))

        for rows in batches:
            for h, run, key, t, lo, off in zip(*(rows.column(c).to_pylist() for c, _ in _OPEN)):
                if h != last_h:
                    close()
                    group, large, lead, last_h = [], False, None, h
                if lead is not None and lead[0] == run:
                    if lead[1:] != (key, t, lo):  # else the same run of a repeated row
                        out.append((0, None, key, t, lo, len(run) - LENGTH + 1))
                    continue
                lead = (run, key, t, lo)
                if not large:
                    group.append((key, t, lo, run, off))
                    if len(group) <= HALL:
                        continue
                    large = True
                for k, u, p, r, o in group or [(key, t, lo, run, off)]:
                    out.extend(_split(h, r, k, u, p, o, cell))
                group = []
            yield _batch(out, _OPEN)
            out.clear()
        close()
        yield _batch(out, _OPEN)

    return settle


def _texts(docs: DataFrame) -> DataFrame:
    return keyed(docs).withColumn("t", F.xxhash64("text"))


def repeated_spans(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, t, spans): [start, stop) byte spans to remove, for documents that have any; and the tables that stand behind it."""
    texts = _texts(docs)
    runs = texts.mapInArrow(tidy(_scan), RUNS)
    found = table(spark, runs.repartition("h").sortWithinPartitions("h", "s", "u", "id", "t", "lo").mapInArrow(tidy(_sift), FOUND), "runs")
    windows = F.shiftright("code", 7)
    gone = found.where("settled").select("id", "t", "lo", windows.alias("n"))
    frontier = found.where("not settled").groupBy("id", "t").agg(F.collect_list(F.struct("h", "lo", "code")).alias("runs"))
    open_, tables = texts.join(frontier, ["id", "t"]).mapInArrow(tidy(_bytes), OPEN), [found]
    for cell in CELLS[1:]:
        done = table(spark, open_.repartition("h").sortWithinPartitions("h", "run", "id", "t", "lo").mapInArrow(tidy(_settle(cell)), OPEN), "runs")
        tables.append(done)
        gone = gone.unionByName(done.where("run is null").select("id", "t", "lo", F.col("off").alias("n")))
        open_ = done.where("run is not null")
        if open_.isEmpty():
            break
    else:  # parts of one window: a group is one content, whose first stays
        done = table(spark, open_.repartition("h").sortWithinPartitions("h", "run", "id", "t", "lo").mapInArrow(tidy(_settle(1)), OPEN), "runs")
        tables.append(done)
        gone = gone.unionByName(done.where("run is null").select("id", "t", "lo", F.col("off").alias("n")))
    spans = F.collect_list(F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + LENGTH).alias("b")))
    return gone.groupBy("id", "t").agg(spans.alias("spans")), tables


def position_ranks(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, t, at, rank) of the positions whose ``length`` bytes also start elsewhere: equal strings have equal ranks. Plain prefix doubling in
    DataFrame functions, one row a position: the first ranks are single bytes; each round pairs the rank of a position with that of
    the position as many bytes on, ranks the pairs anew (a rank is the least position of its pair, so bytes decide) and drops unique ones,
    and with them those that a unique one would follow. It is what :func:`repeated_spans` is tested against, and asks for many times the shuffle."""
    texts = _texts(docs).distinct().where(F.octet_length("text") >= length)
    raw = F.col("text").cast("binary")
    at = texts.select("id", "t", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda k: F.hex(F.substring(raw, k, F.lit(1))))).alias("at", "rank"))
    ranks, done = table(spark, at.select("id", "t", F.col("at").cast("long").alias("at"), "rank"), "ranks"), 1
    while done < length:
        step = min(done, length - done)
        ahead = ranks.select("id", "t", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        pairs = ranks.join(ahead, ["id", "t", "at"])
        own = F.struct("id", "t", "at")
        names = pairs.groupBy("rank", "next").agg(F.min(own).cast("string").alias("name"), F.count("*").alias("n"))
        done += step
        last, ranks = ranks, table(spark, pairs.join(names.where("n > 1"), ["rank", "next"]).select("id", "t", "at", F.col("name").alias("rank")), "ranks")
        drop(spark, last)
    return ranks


def merge(spans) -> list[tuple[int, int]]:
    """Maximal runs of the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in ([] if spans is None else spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def rest(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of ``raw`` without the spans."""
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removed_bytes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``."""
    spans, _ = repeated_spans(spark, docs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, own in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
                raw, gone = text.as_buffer().to_pybytes(), merge(own)
                out.append((key, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(rest(raw, gone)).hexdigest()))
            yield _batch(out, fields)

    long = pa.int64()
    fields = (("id", long), ("n_bytes", long), ("n_removed", long), ("n_spans", long), ("kept_sha256", pa.string()))
    out = _texts(docs).join(spans, ["id", "t"], "left").mapInArrow(tidy(digest), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(unkeyed().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes out of ``text`` (spans shrunk to whole characters), all columns kept; n_chars, where
    there is one, follows the text. A document of which nothing is left stays, with an empty text."""
    spans, _ = repeated_spans(spark, docs)

    def trim(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans):
            if own is None or text is None:
                out.append(text)
                continue
            raw, whole = text.encode(), []
            for a, b in merge(own):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                whole.append((a, b))
            out.append(rest(raw, whole).decode())
        return pd.Series(out)

    trimmed = F.pandas_udf(trim, "string")
    own = {c: fresh(docs, f"_{c}") for c in ("id", "t", "spans")}
    spans = spans.select(*[F.col(c).alias(n) for c, n in own.items()])
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == spans[own["id"]]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == spans[own["t"]])
    joined, gone = docs.join(spans, same, "left"), spans[own["spans"]]
    text = F.when(gone.isNotNull(), trimmed(docs["text"], gone)).otherwise(docs["text"])
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[changed[c].alias(c) if c in changed else docs[f"`{c}`"] for c in docs.columns])

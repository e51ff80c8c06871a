"""Quality classifier: ordinal cumulative-link regression over hashed text.

One weight vector w scores every document, and ordered thresholds t1 < t2 cut the score into grades:
P(grade <= k) = 1 / (1 + exp(w.x - t(k+1))). Grades come from the label table: 0 toxic, 1 poor, 2 good. A document's
expected grade ranks it and its tail probability P(grade = 2) selects it.

x: the distinct words of the lower-cased text, their first 5 to 8 bytes, and the steps of some shape ratios (marks,
capitals, bars, stutter, repeated lines), each hashed to two of 2^20 weights; a feature counts only where both are live.

Training: the sample holds at most ``SAMPLE`` labelled documents, a third of each grade where there are enough (the smallest
hashes of doc_id); that bound is the only one. A weight is live if at least ``LEAST_DOCS`` sampled documents touch it
and it stands out in one grade, by ``STANDS_OUT`` standard deviations and by a share of documents ``LIFT`` times that in the other grades:
without the first the many rare words, without the second the many common ones would outvote the few telling ones, the more the
larger the sample. Counting is distributed; the likelihood is maximised on the driver, in numpy, with Adam.

Defined cases: a text without words (null and empty too) gets grade 0 and isn't kept; a null doc_id is carried through; labels
without doc_id or quality aren't used, null toxic counts as 0, repeated labels of one document count as the worst of them;
repeated rows get equal answers, and of several texts of a labelled doc_id the least is learned from; without two grades to learn from, everything with words is kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bytehash import LETTERED, SPACED, Rolling, mix, word_bounds
from brindle.llm.common import drop, release, table, tidy

GRADES = 3
SAMPLE, LEAST_DOCS, STANDS_OUT, LIFT = 12_000, 5, 4.5, 4.0
BITS = 20
STEPS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 1.0, 1.6)
SHAPES = 6  # features that each step of a ratio counts as, so that it can outweigh the many words of a long text
#: Grades weigh alike in training, good documents are the most in fact: below 0.5, so that of held-out good documents about one in a hundred is
#: rejected at most, and over nine in ten of the poor and of the toxic ones.
TAIL = 0.3
PREFIXES = (5, 6, 7, 8)
SLICE = 1 << 20  # bytes featurized together

_MARKS = np.array([chr(c) in "#*$%&<>!@^~=+" for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_BAR = np.array([c == 124 for c in range(256)])
_LINE = np.array([c != 10 for c in range(256)])


def features(texts: list[str | None], live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, feature hash) pairs, distinct, and the words of each text; only features whose weights are ``live``, if given."""
    raw = [(t or "").encode() for t in texts]
    low = [(t or "").lower().encode() for t in texts]
    n = len(raw)

    def placed(parts: list[bytes], table: np.ndarray):
        data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        start, stop = word_bounds(data, table)
        return data, start, stop, np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")

    def per_doc(indicator: np.ndarray, parts: list[bytes]) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(indicator)])
        ends = np.cumsum([len(p) + 1 for p in parts])
        return total[ends] - total[ends - [len(p) + 1 for p in parts]]

    data, start, stop, doc = placed(low, LETTERED)
    rolling = Rolling(data)
    h = rolling.slices(start, stop)
    words = np.bincount(doc, minlength=n)
    stutter = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / np.maximum(words, 1)
    shown, _, _, spaced_doc = placed(raw, SPACED)
    spaced = np.bincount(spaced_doc, minlength=n)
    letters = np.maximum(per_doc(LETTERED[shown], raw), 1)
    _, a, b, line_doc = placed(raw, _LINE)
    line = Rolling(shown).slices(a, b)
    order = np.lexsort((line, line_doc))
    twice = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1]) & ((b - a)[order][1:] > 20)
    again = np.bincount(line_doc[order][1:][twice], weights=(b - a)[order][1:][twice], minlength=n) / letters
    ratios = (per_doc(_MARKS[shown], raw) / np.maximum(spaced, 1), per_doc(_UPPER[shown], raw) / letters, per_doc(_BAR[shown], raw) / np.maximum(spaced, 1), stutter, again)
    docs, hashes = [doc], [h]
    for k, ratio in enumerate(ratios):
        for j, step in enumerate(STEPS):
            hit = np.flatnonzero((ratio >= step) & (words > 0))
            for copy in range(SHAPES):
                docs.append(hit)
                hashes.append(np.full(len(hit), mix(np.array([1000 + 100 * k + j + 10_000 * copy], np.uint64))[0]))
    for size in PREFIXES:
        longer = np.flatnonzero(stop - start > size)
        docs.append(doc[longer])
        hashes.append(rolling.slices(start[longer], start[longer] + size) + np.uint64(size))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    if live is not None:
        a, b = buckets(h)
        on = live[a] & live[b]
        doc, h = doc[on], h[on]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return doc[new], h[new], words


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


class CumulativeLink:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        a, b = buckets(h)
        return np.bincount(doc, weights=self.weights[a] + self.weights[b], minlength=n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -500, 500)))

    @classmethod
    def fit(cls, doc: np.ndarray, h: np.ndarray, grade: np.ndarray, rounds: int = 300, rate: float = 0.07, shrink: float = 1e-3) -> CumulativeLink:
        """From the live features of the documents, whose grades are given."""
        n = len(grade)
        a, b = buckets(h)
        seen = np.zeros(1 << BITS, bool)
        seen[a] = seen[b] = True
        live = np.flatnonzero(seen)
        at = np.zeros(1 << BITS, np.int32)
        at[live] = np.arange(len(live))
        a, b, doc = at[a], at[b], doc.astype(np.int32)
        share = np.array([(grade < k).mean() for k in range(1, GRADES)]).clip(0.01, 0.99)
        first = np.log(share / (1 - share))
        theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])  # t1 and the logs of the gaps
        x = np.concatenate([np.zeros(len(live)), theta])
        m, v = np.zeros_like(x), np.zeros_like(x)
        each = 1.0 / np.maximum(np.bincount(grade, minlength=GRADES), 1)[grade] / len(np.unique(grade))  # grades weigh alike
        for step in range(1, rounds + 1):
            w, t = x[: len(live)], np.concatenate([x[len(live) : len(live) + 1], np.exp(x[len(live) + 1 :])]).cumsum()
            score = np.bincount(doc, weights=w[a] + w[b], minlength=n)
            low = np.concatenate([np.full((n, 1), -40.0), t[None] - score[:, None], np.full((n, 1), 40.0)], axis=1)
            p = 1 / (1 + np.exp(-low))
            k = np.arange(n)
            top, bottom = p[k, grade + 1], p[k, grade]
            size = np.maximum(top - bottom, 1e-12)
            dt, db = top * (1 - top) / size * each, bottom * (1 - bottom) / size * each
            pull = (db - dt)[doc]
            gw = np.bincount(a, weights=pull, minlength=len(live)) + np.bincount(b, weights=pull, minlength=len(live)) - shrink * w
            gt = np.array([dt[grade == j].sum() - db[grade == j + 1].sum() for j in range(GRADES - 1)])
            tail = gt[::-1].cumsum()[::-1]  # a gap moves all thresholds after it
            g = np.concatenate([gw, tail[:1], tail[1:] * np.exp(x[len(live) + 1 :])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights = np.zeros(1 << BITS)
        weights[live] = x[: len(live)]
        return cls(weights, np.concatenate([x[len(live) : len(live) + 1], np.exp(x[len(live) + 1 :])]).cumsum())


def graded(labels: DataFrame) -> DataFrame:
    """(id, grade): 0 toxic, 1 poor, 2 good."""
    worst = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return worst.select("id", F.when(F.col("t") > 0, 0).when(F.col("q") > 0, 2).otherwise(1).alias("grade"))


def telling(grades: dict[int, int]) -> Column:
    """Whether a weight is live: g0, g1, ... documents of each grade touch it, n in all; ``grades`` has the documents of each."""
    every = float(sum(grades.values()))

    def stands_out(k: int) -> Column:
        own = grades.get(k, 0)
        share = own / every
        spread = F.sqrt(F.greatest(F.col("n") * share * (1 - share) * (1 - F.col("n") / every), F.lit(1e-9)))
        lift = (F.col(f"g{k}") + 0.5) / (own + 1) / ((F.col("n") - F.col(f"g{k}") + 0.5) / (every - own + 1))
        return (F.col(f"g{k}") - F.col("n") * share - 0.5 > STANDS_OUT * spread) & (lift >= LIFT)

    return (F.col("n") >= LEAST_DOCS) & reduce(lambda x, y: x | y, [stands_out(k) for k in range(GRADES)])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CumulativeLink | None:
    """None where there are no two grades to tell apart."""
    marks = graded(labels)
    parts = [marks.where(F.col("grade") == k).orderBy(F.xxhash64("id"), "id").limit(sample // GRADES) for k in range(GRADES)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]))  # <= sample ids
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(chosen, "id").groupBy("id", "grade").agg(F.min("text").alias("text"))
    rows = table(spark, rows.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id"), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((GRADES, 1 << BITS), np.int64)
        for batch in batches:
            for at, doc, h, words in sliced(batch["text"].tolist()):
                a, b = buckets(h)
                pair = np.unique(np.concatenate([doc, doc]) << BITS | np.concatenate([a, b]))
                grade = batch["grade"].to_numpy()[at : at + len(words)]
                np.add.at(total, (grade[pair >> BITS], pair & ((1 << BITS) - 1)), 1)
        grade, weight = np.nonzero(total)
        yield pd.DataFrame({"grade": grade, "weight": weight, "n": total[grade, weight]})

    counted = rows.mapInPandas(tidy(count), "grade int, weight int, n long").groupBy("grade", "weight").agg(F.sum("n").alias("n"))
    grades = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(grades) < 2:
        return None
    counted = counted.groupBy("weight").agg(*[F.sum(F.when(F.col("grade") == k, F.col("n")).otherwise(0)).alias(f"g{k}") for k in range(GRADES)], F.sum("n").alias("n"))
    live = np.zeros(1 << BITS, bool)
    live[[r["weight"] for r in counted.where(telling(grades)).select("weight").collect()]] = True  # < 2^BITS numbers, some thousands
    shipped = np.packbits(live).tobytes()

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.unpackbits(np.frombuffer(shipped, np.uint8)).astype(bool)
        for batch in batches:
            for at, doc, h, words in sliced(batch["text"].tolist(), on):
                cut = np.searchsorted(doc, np.arange(len(words) + 1))
                part = batch.iloc[at : at + len(words)]
                yield pd.DataFrame({"id": part["id"], "grade": part["grade"], "h": [h[i:j].view(np.int64) for i, j in zip(cut, cut[1:])]})

    got = rows.mapInPandas(tidy(featurize), "id long, grade int, h array<long>").toPandas().sort_values("id", kind="stable")  # <= sample rows
    drop(spark, rows)
    doc = np.repeat(np.arange(len(got)), got["h"].map(len).to_numpy())
    h = np.concatenate([np.asarray(x, dtype=np.int64) for x in got["h"]]).view(np.uint64)
    return CumulativeLink.fit(doc, h, got["grade"].to_numpy())


def sliced(texts: list[str | None], live: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The features of a batch in slices of bounded size, each with the place of its first text."""
    at, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= SLICE or k == len(texts) - 1:
            yield at, *features(texts[at : k + 1], live)
            at, held = k + 1, 0


def _tails(model: CumulativeLink | None):
    """A function of a batch of texts: P(grade >= k) of each; it ships only the weights that aren't 0."""
    live = np.flatnonzero(model.weights) if model else np.zeros(0, np.int64)
    values = model.weights[live].astype(np.float32) if model else np.zeros(0, np.float32)
    thresholds = model.thresholds if model else np.full(GRADES - 1, -40.0)

    def start():
        weights = np.zeros(1 << BITS)
        weights[live] = values
        link = CumulativeLink(weights, thresholds)

        def tails(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            parts = [(score := link.score(doc, h, len(words)), np.where(words[:, None] > 0, link.tails(score), 0.0)) for _, doc, h, words in sliced(texts, weights != 0)]
            return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0), np.zeros((0, GRADES - 1)))

        return tails

    return start


def grade_documents(docs: DataFrame, model: CumulativeLink | None, tail: float = TAIL) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability, kept."""
    start = _tails(model)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tails_of = start()
        for batch in batches:
            score, tails = tails_of(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "score": score, "expected_grade": tails.sum(1), "tail_probability": tails[:, -1], "kept": tails[:, -1] >= tail})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(tidy(rate), "doc_id long, score double, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: CumulativeLink | None, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs``, all columns, that the model keeps."""
    start = _tails(model)

    def good(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tails_of = start()
        for texts in series:
            yield pd.Series(tails_of(texts.tolist())[1][:, -1] >= tail)
        release()

    return docs.where(F.pandas_udf(good, "boolean")(F.col("text").cast("string")))

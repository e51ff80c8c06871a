"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every word from the two words on either side, its own place masked: the neighbours'
vectors (one table per place) are added and squashed, and a two-level softmax gives the word's class and its place in the class.
A document's score is the sum of the conditional log-probabilities of all its words; the mean makes lengths comparable.

Vocabulary: all words are counted over all documents and none is capped. The ``KNOWN`` most frequent have ids of their own; the others
are dealt by hash over ``HASHED`` buckets, and the network predicts the bucket. Ids are dealt by rank over ``CLASSES`` classes, so that
all classes hold about as many occurrences. A word's probability within its bucket is its share of the bucket's occurrences, with
``UNSEEN`` of an occurrence for words that weren't counted, so each word has a conditional probability of its own. The counts are a table
of any size: the counts of up to ``FREQUENT`` of the most frequent words are sent to the tasks (1 MB), all other words of the documents are joined
with the table and their log shares summed by document. As a neighbour, a word stands for its bucket.

Training (numpy, float32): documents are dealt by hash over ``ROUNDS`` rounds. In each, every partition runs Adagrad over its words
from the round's common start, and the results are averaged by words seen, block by block in two levels, so that no task holds
more than a ``LOTS``th of all copies of a block (20 KB each) and the driver holds one model of fixed size. All words of all documents
are counted, trained on and scored, and what is gathered grows with the corpus. As each partition trains on its own documents in their
order, the network depends on how the table is split into partitions, but not on the order in which tasks end: averages are
taken in the order of the partitions. The same files and settings give the same scores.

Defined cases: null and empty texts have no words, a sum of 0 and a null mean; places beyond a text's ends hold a padding id; a
null doc_id is carried through; repeated rows get equal scores and count in training as often as they stand there; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.bytehash import SPACED, Rolling, word_bounds
from brindle.llm.common import table, tidy

KNOWN, HASHED, CLASSES = 767, 256, 32
SIZE = KNOWN + HASHED + 1  # id 0 pads
SLOTS = SIZE // CLASSES
WIDTH, SIDES = 16, (-2, -1, 1, 2)
ROUNDS, STEP, RATE = 3, 4096, 0.2
BUFFER = 1 << 20
BLOCKS, LOTS = 16, 256
UNSEEN = 0.5
FREQUENT = 1 << 16


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and how many words each text has."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    start, stop = word_bounds(data, SPACED)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return Rolling(data).slices(start, stop), np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))


class Vocabulary:
    """Ids of word hashes: 0 pads, then the known words by rank, then the hashed ones."""

    def __init__(self, ranked: np.ndarray):
        ranked = ranked.view(np.uint64)
        order = np.argsort(ranked)
        self.sorted, self.rank = ranked[order], order + 1

    def ids(self, h: np.ndarray) -> np.ndarray:
        rest = (1 + KNOWN + (h >> np.uint64(20)) % np.uint64(HASHED)).astype(np.int64)
        if not len(self.sorted):
            return rest
        at = np.searchsorted(self.sorted, h)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == h, self.rank[at], rest)


def windows(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The neighbours of each word, a row for each of SIDES."""
    seq = np.zeros(len(ids) + 2 * (len(counts) + 1), np.int64)
    at = np.arange(len(ids)) + 2 * (np.repeat(np.arange(len(counts)), counts) + 1)
    seq[at] = ids
    return np.stack([seq[at + j] for j in SIDES])


class WindowNetwork:
    """Parameters as one float32 vector with named views."""

    SHAPES = (("near", (len(SIDES), SIZE, WIDTH)), ("top", (CLASSES, WIDTH)), ("top_bias", (CLASSES,)), ("low", (CLASSES, SLOTS, WIDTH)), ("low_bias", (CLASSES, SLOTS)))
    LENGTH = sum(math.prod(s) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            setattr(self, name, flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def start(cls) -> WindowNetwork:
        return cls(np.random.Generator(np.random.PCG64(3)).normal(0, 0.1, cls.LENGTH).astype(np.float32))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.near[0][near[0]]
        for j in range(1, len(SIDES)):
            total = total + self.near[j][near[j]]
        return np.tanh(total)

    @staticmethod
    def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, in place, and the logs of the sums."""
        most = logits.max(1, keepdims=True)
        np.subtract(logits, most, out=logits)
        np.exp(logits, out=logits)
        total = logits.sum(1, keepdims=True)
        logits /= total
        return logits, (np.log(total) + most)[:, 0]

    def log_probabilities(self, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids), np.float32)
        group, slot = ids % CLASSES, ids // CLASSES
        order = np.argsort(group.astype(np.int16), kind="stable")
        h = self.hidden(near[:, order])
        logits = h @ self.top.T + self.top_bias
        k = np.arange(len(ids))
        out[order] = logits[k, group[order]]
        out[order] -= self._softmax(logits)[1]
        ends = np.cumsum(np.bincount(group, minlength=CLASSES))
        for c, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                logits = h[a:b] @ self.low[c].T + self.low_bias[c]
                own = order[a:b]
                out[own] += logits[k[: b - a], slot[own]]
                out[own] -= self._softmax(logits)[1]
        return out

    def gradient(self, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of the mean log-probability."""
        g = WindowNetwork(np.zeros(self.LENGTH, np.float32))
        group, slot = ids % CLASSES, ids // CLASSES
        order = np.argsort(group.astype(np.int16), kind="stable")
        near, group, slot = near[:, order], group[order], slot[order]
        h, k, n = self.hidden(near), np.arange(len(ids)), np.float32(1 / len(ids))
        p, _ = self._softmax(h @ self.top.T + self.top_bias)
        p *= -n
        p[k, group] += n
        g.top[:], g.top_bias[:] = p.T @ h, p.sum(0)
        dh = p @ self.top
        ends = np.cumsum(np.bincount(group, minlength=CLASSES))
        for c, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                q, _ = self._softmax(h[a:b] @ self.low[c].T + self.low_bias[c])
                q *= -n
                q[k[: b - a], slot[a:b]] += n
                g.low[c], g.low_bias[c] = q.T @ h[a:b], q.sum(0)
                dh[a:b] += q @ self.low[c]
        dh *= 1 - h * h
        for j in range(len(SIDES)):
            for d in range(WIDTH):
                g.near[j][:, d] = np.bincount(near[j], weights=dh[:, d], minlength=SIZE)
        return g.flat


def _words(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Slices of a batch with the word hashes and counts of their texts."""
    for batch in batches:
        texts, at, held = batch[column].tolist(), 0, 0
        for k, text in enumerate(texts):
            held += len(text or "")
            if held >= BUFFER or k == len(texts) - 1:
                yield batch.iloc[at : k + 1], *hashes(texts[at : k + 1])
                at, held = k + 1, 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the corpus by its hash, with its count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, h, _ in _words(batches):
            word, n = np.unique(h, return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    return docs.select(F.col("text").cast("string")).mapInPandas(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, rows: int, whole: bool) -> DataFrame:
    """The words with the highest counts: as many as ``rows`` at most or, if ``whole``, the fewest by eighths of a doubling that hold the first ``rows``. The
    number of words in each eighth tells where to cut, so no task and not the driver gets more than about ``rows``."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    cut, total = None, 0
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("m")).orderBy(F.desc("s")).collect():  # 8 rows a doubling: some hundreds
        total += r["m"]
        if total > rows and not whole:
            break
        cut = r["s"]
        if total >= rows:
            break
    return counts.where(step >= F.lit(cut)) if cut is not None else counts.where("false")


def most_frequent(counts: DataFrame) -> np.ndarray:
    """The hashes of the KNOWN most frequent words, by rank."""
    top = _frequent(counts, KNOWN, True).orderBy(F.desc("n"), "word").limit(KNOWN).collect()  # KNOWN rows
    return np.array([r["word"] for r in top], dtype=np.int64)


def count_words(docs: DataFrame) -> np.ndarray:
    """The hashes of the KNOWN most frequent words of the whole corpus, by rank."""
    return most_frequent(word_counts(docs))


def _average(parts: pd.DataFrame) -> tuple[np.ndarray, int]:
    parts = parts.sort_values(parts.columns[1])
    words = parts["words"].to_numpy()
    total = np.zeros(len(parts["values"].iloc[0]) // 4)
    for values, n in zip(parts["values"], words):
        total += np.frombuffer(values, np.float32) * (n / words.sum())
    return total.astype(np.float32), int(words.sum())


def train(docs: DataFrame, ranked: np.ndarray, rounds: int = ROUNDS) -> WindowNetwork:
    network = WindowNetwork.start()
    cuts = np.linspace(0, WindowNetwork.LENGTH, BLOCKS + 1).astype(int)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for turn in range(rounds):
        start = network.flat

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            vocabulary, own = Vocabulary(ranked), WindowNetwork(start.copy())
            spread, words = np.full(own.LENGTH, 1e-6, np.float32), 0
            for _, h, counts in _words(batches):
                ids = vocabulary.ids(h)
                near = windows(ids, counts)
                for a in range(0, len(ids), STEP):
                    g = own.gradient(near[:, a : a + STEP], ids[a : a + STEP])
                    spread += g * g
                    own.flat += np.float32(RATE) * g / np.sqrt(spread)
                words += len(ids)
            if words:
                values = [own.flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pd.DataFrame({"block": range(BLOCKS), "part": TaskContext.get().partitionId(), "words": words, "values": values})

        def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            values, words = _average(parts)
            return pd.DataFrame({"block": [key[0]], "lot": [key[-1]], "words": [words], "values": [values.tobytes()]})

        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        parts = own.mapInPandas(tidy(fit), "block int, part int, words long, values binary")
        some = parts.groupBy("block", F.pmod("part", F.lit(LOTS)).alias("lot")).applyInPandas(merge, "block int, lot int, words long, values binary")
        done = some.groupBy("block").applyInPandas(merge, "block int, lot int, words long, values binary").orderBy("block").collect()  # BLOCKS rows
        if len(done) == BLOCKS:
            network = WindowNetwork(np.concatenate([np.frombuffer(r["values"], np.float32) for r in done]))
    return network


def _bucket(word: str = "word") -> Column:
    """Of a word's hash, as in :class:`Vocabulary`."""
    return F.pmod(F.shiftrightunsigned(word, 20), F.lit(HASHED)).cast("int")


class Shares:
    """The log shares of words in their buckets: of the FREQUENT most frequent words by a table, and what is needed for the others."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        """``words`` ascending, with their counts; ``sizes``: occurrences of each bucket."""
        self.words, self.counts, self.whole = words, counts, np.log(sizes + UNSEEN)

    @classmethod
    def of(cls, counts: DataFrame, ranked: np.ndarray) -> Shares:
        others = counts.where(~F.col("word").isin(ranked.tolist())) if len(ranked) else counts
        sizes = np.zeros(HASHED)
        for r in others.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n")).collect():  # HASHED rows
            sizes[r["bucket"]] = r["n"]
        top = _frequent(others, FREQUENT, False).toPandas()  # <= FREQUENT rows
        words = top["word"].to_numpy(dtype=np.int64)
        order = np.argsort(words)
        return cls(words[order], top["n"].to_numpy(dtype=np.int64)[order], sizes)

    def place(self, word: np.ndarray) -> np.ndarray:
        """Where each word stands in the table; -1 for the others."""
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)


def score_documents(docs: DataFrame, ranked: np.ndarray, network: WindowNetwork, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_probability (sum), mean_log_probability. ``counts`` are those of :func:`word_counts`, of ``docs`` themselves
    if none are given."""
    spark, flat = docs.sparkSession, network.flat
    counts = word_counts(docs) if counts is None else counts
    shares = Shares.of(counts, ranked)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        vocabulary, own, row = Vocabulary(ranked), WindowNetwork(flat), TaskContext.get().partitionId() << 40
        for part, h, n in _words(batches):
            ids = vocabulary.ids(h)
            near = windows(ids, n)
            each = [own.log_probabilities(near[:, a : a + 4 * STEP], ids[a : a + 4 * STEP]) for a in range(0, len(ids), 4 * STEP)]
            doc = np.repeat(np.arange(len(n)), n)
            total = np.bincount(doc, weights=np.concatenate(each) if each else None, minlength=len(n)).astype(float)
            at = np.flatnonzero(ids > KNOWN)
            word, owner = h[at].view(np.int64), doc[at]
            total -= np.bincount(owner, weights=shares.whole[ids[at] - KNOWN - 1], minlength=len(n))
            place = shares.place(word)
            told = place >= 0
            total += np.bincount(owner[told], weights=np.log(shares.counts[place[told]]), minlength=len(n))
            word, owner = word[~told], owner[~told]
            order = np.lexsort((word, owner))
            word, owner = word[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])[: len(word)])
            times, word, owner = np.diff(np.append(first, len(word))).astype(np.int32), word[first], owner[first]
            cut = np.searchsorted(owner, np.arange(len(n) + 1))
            lists = lambda v: [v[a:b] for a, b in zip(cut, cut[1:])]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "row": row + np.arange(len(n)), "n_words": n, "known": total, "words": lists(word), "times": lists(times)})
            row += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = table(spark, rows.mapInPandas(tidy(score), "doc_id long, row long, n_words long, known double, words array<long>, times array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    log_count = F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))  # no frequent word is left, so no word of the join is in a large share of the rows
    sums = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * log_count).alias("share"))
    scored = scored.select("doc_id", "row", "n_words", "known").join(sums, "row", "left")
    total = F.col("known") + F.coalesce("share", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words"))
    return scored.select("doc_id", "n_words", total.alias("log_probability")).withColumn("mean_log_probability", mean)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Counts words, trains and scores on all of ``docs``."""
    counts = table(docs.sparkSession, word_counts(docs), "words")
    ranked = most_frequent(counts)
    return score_documents(docs, ranked, train(docs, ranked), counts)

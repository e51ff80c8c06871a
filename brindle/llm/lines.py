"""Quality rules by line labelling: a linear-chain CRF marks each line as content or boilerplate.

Base statistics are those of the rule contract (words, symbols, repeated lines and windows). The verdict comes from the
labels: Viterbi decoding gives each line of a text its label, and a text is kept if content lines hold at least
``CONTENT_SHARE`` of the characters in its words.

Training: all lines of documents labelled good are content. Which lines of a document labelled bad are boilerplate isn't
known, but one is at least: the labels of its lines are hidden, start as boilerplate, and are estimated and learned from in turns
(``TURNS`` times): by forward-backward each line gets its probability, the likely ones and each document's likeliest stay
boilerplate, and the conditional likelihood of these labels is maximised again. Bad documents that the base rule rejects teach
nothing. One feature is the share of a line's words in a lexicon of at most ``LEXICON`` words that stand out in bad documents.

The sample is bounded by ``SAMPLE`` labelled documents (the smallest hashes of doc_id, half of either quality where there are
enough) and, going on in that order, by ``SAMPLE_LINES`` lines; these bounds are the only ones. Words are counted and lines described in Spark.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; words are those of the contract in lines as
in texts, lines without words are skipped; a null doc_id is carried through; repeated rows get equal answers, and of several
texts of a labelled doc_id the least is learned from; an empty table gives an empty result, and without labelled rows of both
qualities all lines are content; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop, table, tidy

SAMPLE, SAMPLE_LINES, LEXICON = 2000, 200_000, 256
TURNS = 4
STANDS_OUT, LEAST_DOCS = 5.0, 5  # of a lexicon's word: standard deviations above its share, documents
CONTENT_SHARE = 0.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_DROP = {ord(c): None for c in SYMBOLS}
FEATURES = ("bias", "symbols", "upper", "bars", "again", "stutter", "digits", "short", "stops", "lexicon")
#: White space of Unicode that parts no words here.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NO_WORDS: frozenset[str] = frozenset()
_BARE = {c: None for c in range(0x21, 0x7F) if not chr(c).isalnum()}


def words_in(text: str) -> list[str]:
    return WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def bare_words(text: str) -> list[str]:
    """Lower-cased words without ASCII marks, for the lexicon."""
    return text.lower().translate(_BARE).split()


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = words_in(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) >= 5:
        ids = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, four = np.unique(pair[:-2] * len(words) + pair[2:], return_inverse=True)
        _, five, n = np.unique(four[:-1] * len(ids) + w[4:], return_inverse=True, return_counts=True)
        twice = n[five] > 1
        cover = np.zeros(len(words) + 1, np.int64)
        starts = np.flatnonzero(twice)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + 5, -1)
        repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(words), sum(map(len, words)), len(text) - len(text.translate(_DROP)), dup, repeat


def line_features(text: str | None, lexicon: frozenset[str] = NO_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES and the characters in words, for each line with a word."""
    rows, sizes = [], []
    seen: set[str] = set()
    odd = _ODD_SPACE.search(text or "")
    for line in (text or "").split("\n"):
        words = WORD.findall(line) if odd else line.split()
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        marked = sum(1 for w in words if len(w.translate(_DROP)) < len(w))
        upper = sum(1 for w in words if len(w) > 1 and w.isupper())
        stutter = sum(map(str.__eq__, words, words[1:])) / n
        told = sum(map(lexicon.__contains__, bare_words(line))) / n if lexicon else 0.0
        rows.append((
            1.0, marked / n, upper / n, min(1.0, 2 * line.count("|") / n), float(line in seen), min(1.0, 2 * stutter),
            sum(map(str.isdigit, line)) / chars, float(n < 4), sum(1 for w in words if len(w) <= 3) / n, min(1.0, 4 * told),
        ))
        sizes.append(chars)
        seen.add(line)
    return np.array(rows).reshape(-1, len(FEATURES)), np.array(sizes, dtype=np.int64)


class ChainCrf:
    """Two labels (0 content, 1 boilerplate), line scores and a transition matrix; texts are decoded side by side."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(len(FEATURES)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    @staticmethod
    def _steps(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """t, the texts that have a line t (longest first), and where those lines are."""
        order = np.argsort(-lengths, kind="stable")
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ordered = -lengths[order]
        for t in range(int(lengths.max(initial=0))):
            live = order[: np.searchsorted(ordered, -t, side="left")]
            yield t, live, start[live] + t

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.zeros(len(x)), x @ self.weights])

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most likely labels of all lines; content wins ties."""
        score, back = self._scores(x), np.zeros((len(x), 2), np.int8)
        best, labels = np.zeros((len(lengths), 2)), np.zeros(len(x), np.int8)
        steps = list(self._steps(lengths))
        for t, live, at in steps:
            if t:
                ways = best[live][:, :, None] + self.moves[None]
                back[at] = ways.argmax(1)
                best[live] = ways.max(1) + score[at]
            else:
                best[live] = score[at]
        now = best.argmax(1).astype(np.int8)
        for t, live, at in reversed(steps):
            labels[at] = now[live]
            if t:
                now[live] = back[at, now[live]]
        return labels

    def posteriors(self, x: np.ndarray, steps: list, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of boilerplate of each line, and the expected moves, by forward-backward."""
        score, m = self._scores(x), self.moves
        ahead, behind = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t, _, at in steps:
            ahead[at] = score[at] + (np.logaddexp.reduce(ahead[at - 1][:, :, None] + m, axis=1) if t else 0)
        for t, _, at in reversed(steps):
            if t:
                behind[at - 1] = np.logaddexp.reduce(m[None] + (score[at] + behind[at])[:, None, :], axis=2)
        joint = ahead + behind
        total = np.logaddexp.reduce(joint, axis=1, keepdims=True)
        both = ahead[inner - 1][:, :, None] + m + (score[inner] + behind[inner])[:, None, :] - total[inner][:, :, None]
        return np.exp(joint - total)[:, 1], np.exp(both).sum(0)

    def fit(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 3.0, shrink: float = 1e-5) -> ChainCrf:
        """Gradient ascent on the conditional log-likelihood, with momentum."""
        steps, inner = list(self._steps(lengths)), self._inner(lengths)
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (y[inner - 1], y[inner]), 1)
        vw, vm = np.zeros_like(self.weights), np.zeros((2, 2))
        for _ in range(rounds):
            p, moves = self.posteriors(x, steps, inner)
            gw = x.T @ (y - p) / len(x) - shrink * self.weights
            gm = (pairs - moves) / len(x) - shrink * self.moves
            vw, vm = 0.9 * vw + gw, 0.9 * vm + gm
            self.weights, self.moves = self.weights + rate * vw, self.moves + rate * vm
        return self

    @staticmethod
    def _inner(lengths: np.ndarray) -> np.ndarray:
        """The lines that have one before them in their text."""
        inner = np.ones(int(lengths.sum()), bool)
        inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        return np.flatnonzero(inner)

    def learn(self, x: np.ndarray, lengths: np.ndarray, good: np.ndarray, turns: int = TURNS) -> ChainCrf:
        """From documents' labels alone: ``good`` has one for each text."""
        doc = np.repeat(np.arange(len(lengths)), lengths)
        bad = ~good[doc]
        y = bad.astype(np.int64)
        steps, inner = list(self._steps(lengths)), self._inner(lengths)
        for turn in range(turns):
            self.fit(x, lengths, y, rounds=100)
            if turn == turns - 1:
                break
            p = np.where(bad, self.posteriors(x, steps, inner)[0], 0.0)
            most = np.zeros(len(lengths))
            np.maximum.at(most, doc, p)
            y = (bad & ((p > 0.5) | (p == most[doc]))).astype(np.int64)
        return self


def lexicon_of(rows: DataFrame) -> frozenset[str]:
    """The words of ``rows(text, good)`` that stand out in bad documents, LEXICON at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: dict[str, list[int]] = {}
            for text, good in zip(batch["text"], batch["good"]):
                for w in set(bare_words(text)):
                    n.setdefault(w, [0, 0])[int(good)] += 1
            yield pd.DataFrame({"word": list(n), "bad": [v[0] for v in n.values()], "good": [v[1] for v in n.values()]})

    docs = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    share = docs.get(False, 0) / max(1, sum(docs.values()))
    n = F.col("bad") + F.col("good")
    z = (F.col("bad") - n * share) / F.sqrt(n * share * (1 - share) + F.lit(1e-9))
    counted = rows.mapInPandas(tidy(count), "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    told = counted.where((n >= LEAST_DOCS) & (z > STANDS_OUT)).orderBy(z.desc(), "word").limit(LEXICON).collect()  # <= LEXICON rows
    return frozenset(r["word"] for r in told)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[ChainCrf, frozenset[str]]:
    """A CRF and the lexicon of one feature, fit on at most ``sample`` labelled documents."""
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.min("quality") > 0).alias("good"))
    order = F.xxhash64("id")
    parts = [chosen.where(c).orderBy(order, "id").limit(sample // 2) for c in ("good", "not good")]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "id").groupBy("id", "good").agg(F.min("text").alias("text"))  # <= sample rows

    def usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            failed = [rejected(base_stats(t)) for t in batch["text"]]
            yield batch[batch["good"] | ~np.array(failed, bool)]

    rows = table(spark, rows.mapInPandas(tidy(usable), "id long, good boolean, text string"), "sample")
    lexicon = lexicon_of(rows)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [line_features(t, lexicon)[0] for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "good": batch["good"], "n": [len(v) for v in x], "x": [v.astype(np.float32).tobytes() for v in x]})

    lines = table(spark, rows.mapInPandas(tidy(describe), "id long, good boolean, n long, x binary").where("n > 0"), "lines")
    sizes = lines.select("id", "n").withColumn("order", order).toPandas().sort_values(["order", "id"])  # <= sample rows
    taken = sizes["id"][sizes["n"].cumsum() <= SAMPLE_LINES].tolist()
    got = lines.where(F.col("id").isin(taken)).toPandas().sort_values("id")  # <= SAMPLE_LINES rows of features
    drop(spark, rows, lines)
    crf = ChainCrf()
    if got["good"].nunique() < 2:
        return crf, lexicon
    x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, len(FEATURES)) for v in got["x"]]).astype(float)
    return crf.learn(x, got["n"].to_numpy(), got["good"].to_numpy().astype(bool)), lexicon


def rejected(stats: tuple[int, ...]) -> bool:
    """The base rule, of the statistics of :func:`base_stats`."""
    return stats[0] < 10 or 100 * stats[4] > 20 * stats[0]


def label_quality(docs: DataFrame, crf: ChainCrf, lexicon: frozenset[str] = NO_WORDS, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base statistics, base_failed, content_share, kept."""
    weights, moves = crf.weights, crf.moves

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ChainCrf(weights, moves)
        for batch in batches:
            stats = np.array([base_stats(t) for t in batch["text"]], dtype=np.int64).reshape(-1, 5)
            lines = [line_features(t, lexicon) for t in batch["text"]]
            n = np.array([len(x) for x, _ in lines], dtype=np.int64)
            label = model.decode(np.concatenate([x for x, _ in lines]), n)
            sizes, doc = np.concatenate([s for _, s in lines]), np.repeat(np.arange(len(n)), n)
            total = np.bincount(doc, weights=sizes, minlength=len(n))
            content = np.bincount(doc, weights=sizes * (label == 0), minlength=len(n)) / np.maximum(total, 1)
            failed = np.array([rejected(r) for r in stats.tolist()], bool)
            out = pd.DataFrame(stats, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy(), base_failed=failed, content_share=content, kept=~failed & (content >= share))[OUT]

    OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(tidy(rate), kinds)

"""Embedding of chunks by a given function, and exact cosine search.

The query set of a call is small against the chunks: it is collected in blocks of a fixed size, and every block streams over all
vectors with a partial top-k in each Arrow batch, so only k rows a query and batch are shuffled, ties or not.
:func:`near_buckets` is the approximate way for large query sets: only vectors that share a bucket of random hyperplanes are compared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle import config
from brindle.functions import text as T
from brindle.operators.graph import top_k

QUERY_BLOCK = 16_384  # queries sent to the tasks together
SCORES = 4_000_000  # computed together
DIMS = 128


@lru_cache(maxsize=100_000)
def _bucket(char: str) -> int:
    return int(hashlib.md5(char.encode(errors="surrogatepass")).hexdigest()[-2:], 16) % DIMS


@lru_cache(maxsize=1)
def _buckets() -> np.ndarray:
    """The bucket of each code point, -1 where it wasn't asked for yet."""
    return np.full(0x110000, -1, np.int16)


def character_bag(texts: list[str]) -> list[list[float]]:
    """A deterministic embedder that needs no model: hashed character counts, normalised; zeros for an empty text."""
    known = _buckets()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    for c in np.unique(codes[known[codes] < 0]):
        known[c] = _bucket(chr(c))
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    v = np.bincount(row * DIMS + known[codes], minlength=len(texts) * DIMS).reshape(-1, DIMS).astype(float)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm == 0, 1, norm)).tolist()


def embed(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]] = character_bag) -> DataFrame:
    """(key, embedding), the texts given to ``embedder`` in batches of EMBED_BATCH."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].fillna("").tolist()
            vectors = [v for a in range(0, len(texts), config.EMBED_BATCH) for v in np.asarray(embedder(texts[a : a + config.EMBED_BATCH]), dtype=float)]
            yield pd.DataFrame({"k": batch["k"], "embedding": vectors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, embedding array<double>").withColumnRenamed("k", key)


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=float) for v in column])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row; of equal scores the first columns."""
    k = min(k, scores.shape[1])
    edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
    over, level = scores > edge, scores == edge
    level &= np.cumsum(level, axis=1) <= k - over.sum(axis=1, keepdims=True)
    return np.nonzero(over | level)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "chunk_id", digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score) with the k best of each query among them; ``queries`` has query_id and embedding. Scores are rounded, and of
    equal ones each batch passes on those with the smallest keys, so a batch gives k rows a query however many vectors are equal.
    The vectors are read once for every QUERY_BLOCK queries."""
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    parts = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    ids, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    out = None
    for block in range(blocks):
        asked = parts.where(F.col("block") == block).orderBy("query_id").toPandas()  # about QUERY_BLOCK rows
        if asked.empty:
            continue
        names, q = asked["query_id"].to_numpy(), _matrix(asked["embedding"])

        def run(batches: Iterator[pd.DataFrame], names=names, q=q) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                batch = batch.sort_values("key")
                keys, v = batch["key"].to_numpy(), _matrix(batch["embedding"]).T
                step = max(1, SCORES // len(keys))
                for a in range(0, len(q), step):
                    scores = np.round(q[a : a + step] @ v, digits)
                    row, col = best_of(scores, k)
                    yield pd.DataFrame({"query_id": names[a + row], "key": keys[col], "score": scores[row, col]})

        found = vectors.select(F.col(key).alias("key"), "embedding").mapInPandas(run, f"query_id {ids}, key {kind}, score double")
        out = found if out is None else out.unionByName(found)
    spark = queries.sparkSession
    out = out if out is not None else spark.createDataFrame([], f"query_id {ids}, key {kind}, score double")
    return out.withColumnRenamed("key", "chunk_id")


def search(queries: DataFrame, vectors: DataFrame, embedder: Callable = character_bag, k: int = 10) -> DataFrame:
    """Hits of the vector path: cosine similarity, rounded to nine places so that equal texts tie."""
    asked = embed(queries.where(~T.is_blank(F.col("query"))), "query_id", "query", embedder)
    return top_k(nearest(asked, vectors, k), [F.desc("score")], "vector", k)


def near_buckets(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "chunk_id", tables: int = 48, bits: int = 6, flips: int = 2, digits: int = 9) -> DataFrame:
    """As :func:`nearest`, approximate: a vector lies in one bucket in each of ``tables`` tables, by the signs of its products with ``bits`` random
    directions, and a query is compared with the vectors of its own buckets and of those that differ in one of the ``flips`` signs whose
    products are smallest. Everything is an equi-join on (table, bucket); the probability to miss a vector falls with the number of tables."""
    dims = len(vectors.select("embedding").first()["embedding"])
    planes = np.random.Generator(np.random.PCG64(5)).normal(size=(tables * bits, dims))

    def signs(probe: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                unit = _matrix(batch["embedding"])
                dots = (unit @ planes.T).reshape(len(batch), tables, bits)
                own = ((dots > 0) << np.arange(bits)).sum(axis=2)
                buckets = own * tables + np.arange(tables)
                if probe:
                    weakest = np.abs(dots).argsort(axis=2)[:, :, :flips]
                    buckets = np.concatenate([buckets, *[(own ^ (1 << weakest[:, :, k])) * tables + np.arange(tables) for k in range(flips)]], axis=1)
                yield pd.DataFrame({"key": batch["key"], "embedding": list(unit), "buckets": list(buckets)})

        return run

    def bucketed(rows: DataFrame, name: str, probe: bool) -> DataFrame:
        kind = rows.schema[name].dataType.simpleString()
        return rows.select(F.col(name).alias("key"), "embedding").mapInPandas(signs(probe), f"key {kind}, embedding array<double>, buckets array<long>")

    asked, stored = bucketed(queries, "query_id", True), bucketed(vectors, key, False)
    pairs = asked.select(F.col("key").alias("query_id"), F.explode("buckets").alias("b")).join(stored.select(F.col("key").alias("chunk_id"), F.explode("buckets").alias("b")), "b")
    pairs = pairs.select("query_id", "chunk_id").distinct()
    both = pairs.join(asked.select(F.col("key").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(stored.select(F.col("key").alias("chunk_id"), "embedding"), "chunk_id")
    cosine = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return top_k(both.select("query_id", "chunk_id", F.round(cosine, digits).alias("score")), [F.desc("score")], "vector", k).drop("path", "rank")

"""Three-path retrieval: enabled paths, routed weights, fusion, metadata; failures of one path leave the others standing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, contextmanager, nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import config
from brindle.functions import text as T
from brindle.operators import fulltext, fusion, graph, vectors
from brindle.storage import table

HITS = "query_id {}, path string, chunk_id string, rank int, score double"


@dataclass
class Index:
    """The tables that a search reads."""

    chunks: DataFrame
    postings: DataFrame  # or a forward index, without ``size``
    size: DataFrame | None
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    entity_chunks: DataFrame
    aliases: DataFrame

    def texts(self, ids: DataFrame) -> DataFrame:
        """Texts and metadata of the chunks in ``ids`` (chunk_id)."""
        return ids.join(self.chunks, "chunk_id", "left")


@dataclass
class Result:
    hits: DataFrame
    fused: DataFrame
    degraded: dict[str, str] = field(default_factory=dict)


def enabled(paths: list[str] | None) -> list[str]:
    """The known paths that are asked for: all for None, none for an empty list, unknown names left out."""
    return [p for p in config.PATHS if paths is None or p in paths]


def path_hits(index: Index, queries: DataFrame, k: int, embedder: Callable, segment=None) -> dict[str, Callable[[], DataFrame]]:
    return {
        "fulltext": lambda: fulltext.search(queries, index.postings, index.size, k, segment),
        "graph": lambda: graph.search(queries, index.aliases, index.edges, index.entity_chunks, index.chunks, k),
        "vector": lambda: vectors.search(queries, index.vectors, embedder, k),
    }


Tracer = Callable[[str], AbstractContextManager]


@contextmanager
def span(spark: SparkSession, name: str, tracer: Tracer | None = None) -> Iterator[None]:
    """Names the jobs of a step in Spark's own records, and opens the span of a ``tracer`` if one is given."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.job.description")
    sc.setJobDescription(name)
    try:
        with tracer(name) if tracer else nullcontext():
            yield
    finally:
        sc.setLocalProperty("spark.job.description", before)


def run(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, paths: list[str] | None = None, weights: DataFrame | dict | str | None = "routed",
        embedder: Callable = vectors.character_bag, on_error: str = "degrade", extra: dict[str, Callable[[], DataFrame]] | None = None, segment=None, tracer: Tracer | None = None) -> Result:
    """Hits of every enabled path and their fusion. ``weights``: "routed", a table, a dict, or None for equal ones; ``extra`` adds or
    replaces paths. The paths run side by side, each in jobs and a span of its own, and its hits (k rows a query at most) are
    stored, so routing and fusion read them once. With ``on_error="degrade"`` a path that fails, while it is planned or while it
    runs, counts as empty and is named in ``degraded``."""
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    makers = {p: m for p, m in path_hits(index, queries, k, embedder, segment).items() if p in enabled(paths)} | (extra or {})
    kind = queries.schema["query_id"].dataType.simpleString()
    hits, degraded = spark.createDataFrame([], HITS.format(kind)), {}

    def one(path: str) -> DataFrame | Exception:
        try:
            with span(spark, f"path {path}", tracer):
                return table(spark, makers[path]().select("query_id", "chunk_id", "rank", "score"), f"hits_{path}")
        except Exception as e:  # one path must not take the others down
            return e

    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        found = dict(zip(sorted(makers), pool.map(one, sorted(makers))))
    for path, got in found.items():
        if isinstance(got, Exception):
            if on_error == "raise":
                raise got
            degraded[path] = f"{type(got).__name__}: {got}"
        else:
            hits = hits.unionByName(got.withColumn("path", F.lit(path)))
    routed = fusion.route(queries, hits) if isinstance(weights, str) else weights
    return Result(hits, fusion.fuse(hits, routed), degraded)


def endpoint(spark: SparkSession, index: Index, query: str, k: int = 10, paths: list[str] | None = None, **more) -> tuple[DataFrame, dict[str, str]]:
    """One query as a service would take it: a blank one and a k beyond 1 to 100 are refused, unknown paths are left out; the fused rows with
    their chunks' metadata, and the paths that failed."""
    if not query or not query.strip():
        raise ValueError("the query is blank")
    result = run(spark, index, spark.createDataFrame([("q", query)], "query_id string, query string"), k, paths, **more)
    return respond(result, index), result.degraded


def respond(result: Result, index: Index, limit: int | None = None) -> DataFrame:
    """Fused rows with the chunks' metadata; ``limit`` cuts each query's list, which is otherwise up to k rows for every path."""
    rows = result.fused if limit is None else result.fused.where(F.col("rank") <= limit)
    return rows.join(index.chunks.drop("order", "idx"), "chunk_id", "left")


def find_chunks(result: Result, index: Index, k: int = 10) -> DataFrame:
    """(query_id, rank, line): the first k fused chunks of each query as one readable line each, for labelling by hand."""
    rows = respond(result, index, k)
    return rows.select("query_id", "rank", T.snippet(F.col("chunk_id"), F.coalesce("doc_id", F.lit("?")), F.col("page"), F.coalesce("text", F.lit(""))).alias("line"))

"""Weighted reciprocal-rank fusion, query-adaptive weights, and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle import config
from brindle.functions import text as T


def dominant(hits: DataFrame) -> DataFrame:
    """(query_id, dominant): whether the best full-text hit stands far below the median score."""
    ranked = hits.where("path = 'fulltext'").groupBy("query_id").agg(F.count("*").alias("n"), F.median("score").alias("m"), F.min_by("score", "rank").alias("best"))
    return ranked.select("query_id", ((F.col("n") >= config.DOMINANCE_HITS) & (F.col("m") - F.col("best") > config.DOMINANCE_GAP)).alias("dominant"))


def route(queries: DataFrame, hits: DataFrame, static: dict[str, float] | None = None) -> DataFrame:
    """(query_id, path, weight) for the static paths and all that have hits. Queries that name code, or with a dominant full-text
    hit, shift weight from vector to full text, once; rewritten paths get a share of their path's weight."""
    static = config.STATIC_WEIGHTS if static is None else static
    base = F.create_map(*[x for p, w in static.items() for x in (F.lit(p), F.lit(float(w)))]) if static else F.create_map().cast("map<string,double>")
    named = F.explode(F.array(*[F.lit(p) for p in sorted(static)])) if static else F.explode(F.array().cast("array<string>"))
    paths = queries.select("query_id", named.alias("path")).unionByName(hits.select("query_id", "path")).distinct()
    asked = queries.select("query_id", T.lexical_signal(F.col("query")).alias("lexical")).join(dominant(hits), "query_id", "left")
    shift = F.col("lexical") | F.coalesce("dominant", F.lit(False))
    stem = F.regexp_replace("path", f"{config.REWRITTEN}$", "")
    weight = F.coalesce(F.try_element_at(base, stem), F.lit(1.0))
    factor = F.when(shift & (stem == "fulltext"), config.FULLTEXT_BOOST).when(shift & (stem == "vector"), config.VECTOR_DAMP).otherwise(1.0)
    discount = F.when(F.col("path").endswith(config.REWRITTEN), config.REWRITE_DISCOUNT).otherwise(1.0)
    return paths.join(asked, "query_id").select("query_id", "path", (weight * factor * discount).alias("weight"))


def fuse(hits: DataFrame, weights: DataFrame | dict[str, float] | None = None, k: int = config.RRF_K) -> DataFrame:
    """(query_id, chunk_id, rrf_score, sources, rank, contributions). Paths without a weight count 1, those at 0 or below don't
    take part. A chunk's parts are added in path order, whatever order the shuffle brings them in."""
    if isinstance(weights, DataFrame):
        weighted = hits.join(weights.select("query_id", "path", "weight"), ["query_id", "path"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    elif weights:
        given = F.create_map(*[x for p, w in weights.items() for x in (F.lit(p), F.lit(float(w)))])
        weighted = hits.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("path")), F.lit(1.0)))
    else:
        weighted = hits.withColumn("weight", F.lit(1.0))
    parts = weighted.where("weight > 0").select("query_id", "chunk_id", F.struct("path", (F.col("weight") / (F.lit(k) + F.col("rank"))).alias("part")).alias("p"))
    grouped = parts.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    scored = grouped.select(
        "query_id", "chunk_id", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["part"]).alias("rrf_score"),
        F.transform("parts", lambda p: p["path"]).alias("sources"), F.map_from_entries("parts").alias("contributions"),
    )
    at = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(at))


def rerank(fused: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], depth: int = config.RERANK_DEPTH) -> DataFrame:
    """(query_id, chunk_id, rank, score): the first ``depth`` fused chunks in the order of ``scorer``, then no others."""
    pairs = fused.where(F.col("rank") <= depth).select("query_id", "chunk_id", F.col("rank").alias("before")).join(queries.select("query_id", "query"), "query_id").join(texts.select("chunk_id", "text"), "chunk_id")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(scorer(list(zip(q, t))), dtype=float)

    scored = pairs.withColumn("score", F.pandas_udf(run, "double")("query", "text"))
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return scored.select("query_id", "chunk_id", F.row_number().over(at).alias("rank"), "score")

"""The tables as inputs of the engine: plain documents, a Markdown corpus rendered from the star schema, and query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import chunking, graph
from brindle.storage import table


SMALL = 32 << 20  # bytes a core below which a table is dealt out anew


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is small for the cluster may lie in one row group and would be read by one core: it is dealt over all of
    them. A table of any size that matters is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def settled(df: DataFrame) -> DataFrame:
    """A query set, which many places of a plan read: computed once, written and read again."""
    return table(df.sparkSession, df, "settled")


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.plain_chunks(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


CUSTOMERS = 1000  # numbers of customers that one page takes in


def handbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): Markdown pages for each nation, one for every CUSTOMERS customer numbers, each with the region as its title, a
    section with a customer table, and a signature heading. A page's size is bounded; their number grows with the customers."""
    customers = read(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / CUSTOMERS).alias("block"))
    customers = customers.agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rows"))
    regions = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    pages = customers.join(F.broadcast(regions), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations at any scale
    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", r["c_custkey"].cast("string"), r["c_name"], r["c_mktsegment"]), F.lit(" |"))
    table = F.concat_ws("\n", F.lit("| c_custkey | c_name | segment |"), F.lit("|---|:-:|---|"), F.transform("rows", line))
    key = F.col("n_nationkey").cast("string")
    text = F.concat(
        F.lit("---\nkind: handbook\n---\n# "), "r_name", F.lit("\n\n## "), "n_name", F.lit("\n\nHome of customers, see `"), F.lower("n_name"), F.lit("` and CODE_"), key, F.lit(".\n\n"), table,
        F.lit("\n\n### list_"), key, F.lit("(limit=10, *market)\n\nLists customers of "), "n_name", F.lit(" by market.\n"),
    )
    return pages.select(F.concat(F.lower("r_name"), F.lit("/"), key, F.lit("-"), F.col("block").cast("string"), F.lit(".md")).alias("doc_id"), text.alias("text"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the benchmark items, whole."""
    return read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): for each source, the first upper-case name of its documents."""
    names = spread(read(spark, sf_dir, "documents").select("source", "text")).select("source", F.array_min(graph.constants(F.col("text"))).alias("name"))
    first = names.where("name is not null").groupBy("source").agg(F.min("name").alias("name"))
    return first.select("source", "name").select(F.col("source").alias("query_id"), F.concat(F.lit("where is "), "name").alias("query"))


def whole_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the whole text of each benchmark item, and of each document whose id is divisible by 100."""
    items = benchmark_queries(spark, sf_dir)
    documents = read(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    return settled(items.unionByName(documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"), F.col("text").alias("query"))))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(benchmark_queries(spark, sf_dir).unionByName(name_queries(spark, sf_dir)))

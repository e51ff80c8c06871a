"""Incremental ingestion: a stream of documents is parsed, chunked and merged into a stored chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import chunking, markdown

DOCUMENT = "doc_id string, text string, version long"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON documents (doc_id, text, version) that arrive in a folder."""
    return spark.readStream.schema(DOCUMENT).json(folder)


def ingest(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Writes each micro-batch's chunks to ``path``/batch=<id>. A batch that is run again overwrites its own folder, so every document
    is chunked exactly once per version; :func:`current` picks the newest."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("version")))).where("_n = 1").drop("_n")
        chunks = chunking.chunk_elements(markdown.parse(newest)).join(newest.select("doc_id", "version"), "doc_id")
        chunks.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the newest version of each document."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("version", "batch")).alias("newest"))
    return rows.join(newest, "doc_id").where((F.col("version") == F.col("newest.version")) & (F.col("batch") == F.col("newest.batch"))).drop("newest")


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and type on a stream or a table, late ones dropped beyond the watermark."""
    kind = events.schema["ts"].dataType
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")

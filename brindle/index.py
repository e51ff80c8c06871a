"""Building, storing and opening an index: one chunk table feeds all three paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import schema
from brindle.operators import chunking, fulltext, graph, markdown, pdf, vectors
from brindle.operators import images as image_channels
from brindle.operators.search import Index
from brindle.sources import files
from brindle.storage import drop, file_system, table

TABLES = ("chunks", "postings", "size", "vectors", "nodes", "edges", "entity_chunks", "aliases")


def index_of(chunks: DataFrame, embedder: Callable = vectors.character_bag, segment=None) -> Index:
    """All index tables as plans over ``chunks``."""
    g = graph.Graph(chunks)
    return Index(
        chunks, fulltext.postings(chunks, segment), fulltext.corpus_size(chunks, segment), vectors.embed(chunks, "chunk_id", "text", embedder), g.nodes, g.edges, g.postings,
        graph.alias_map(g.nodes),
    )


def save(spark: SparkSession, index: Index, path: str) -> int:
    """Writes the tables and, last, the version; a rebuild overwrites. Without chunks nothing is written. Returns the chunks."""
    index.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    n = stored.count()
    if n:
        for name in TABLES[1:]:
            table = getattr(index, name)
            if name == "postings":
                table = table.repartitionByRange("term").sortWithinPartitions("term")  # a term's rows lie in few row groups
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(schema.INDEX_VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_version")
    return n


def build(spark: SparkSession, documents: DataFrame, path: str, embedder: Callable = vectors.character_bag, images: bool = False, **channels) -> int:
    """Parses, chunks and indexes Markdown documents (doc_id, text). The chunk table is written first and every other table reads
    it, so parsing is done once. ``channels``: what :func:`images.resolve` takes, for image elements."""
    return _build(spark, markdown.parse(documents, images), path, embedder, channels)


def build_folder(spark: SparkSession, folder: str, path: str, embedder: Callable = vectors.character_bag, read_pages: Callable[[bytes], list[dict]] | None = None,
                 render: Callable[[str, int], bytes] | None = None, images: bool = False, **channels) -> int:
    """A folder to an index in one call: Markdown files and, with ``read_pages`` (see :mod:`pdf`), PDF files by their suffix, all others left
    out; images resolved; chunks; all tables. Returns the number of chunks; without any, no index is written."""
    found = files.scan(spark, folder)
    elements = markdown.parse(files.markdown_documents(found), images).withColumn("image", F.lit(None).cast("binary"))
    if read_pages is not None:
        elements = elements.unionByName(pdf.documents(found.where(F.col("suffix").isin(*files.PDF)), read_pages, render))
    return _build(spark, elements, path, embedder, channels)


def _no_image(ref: str) -> bytes:
    raise OSError(ref)


def _build(spark: SparkSession, elements: DataFrame, path: str, embedder: Callable, channels: dict) -> int:
    given = {"fetch": _no_image, "read": _no_image, "enabled": bool(channels)} | channels
    chunks = chunking.chunk_elements(image_channels.resolve(elements, **given))
    chunks.write.mode("overwrite").parquet(f"{path}/_parsed")
    return save(spark, index_of(spark.read.parquet(f"{path}/_parsed"), embedder), path)


def update(spark: SparkSession, path: str, chunks: DataFrame, target: str, embedder: Callable = vectors.character_bag, segment=None) -> int:
    """The index at ``path`` with ``chunks`` put in (those of the same chunk_id replaced), written to ``target``, a folder of its own so that readers
    of the old one aren't disturbed; giving the same chunks again changes nothing. Postings and vectors of other chunks are taken
    over; the graph, in which chunks share nodes, is derived anew. Returns the number of chunks."""
    old = open_index(spark, path)
    new = table(spark, chunks.dropDuplicates(["chunk_id"]), "new_chunks")
    every = table(spark, upsert(old.chunks, new), "all_chunks")
    fresh = index_of(every, embedder, segment)
    fresh.postings = replaced(old.postings, new, fulltext.postings(new, segment))
    fresh.vectors = replaced(old.vectors, new, vectors.embed(new, "chunk_id", "text", embedder))
    n = save(spark, fresh, target)
    drop(spark, new, every)
    return n


def replaced(stored: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """``stored`` without what belongs to ``chunks``, and ``rows``."""
    return stored.join(chunks.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows)


def open_index(spark: SparkSession, path: str, rebuild: Callable[[], int] | None = None) -> Index:
    """The stored tables. An index of another version is removed and made again by ``rebuild``, and is an error without it."""
    version = spark.read.parquet(f"{path}/_version").first()["version"]
    if version != schema.INDEX_VERSION and rebuild is not None:
        fs, at = file_system(spark, path)
        fs.delete(at, True)
        rebuild()
    elif version != schema.INDEX_VERSION:
        raise ValueError(f"the index has version {version}, this engine reads {schema.INDEX_VERSION}; build it again")
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored rows without those that come again, and the new rows."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def statistics(index: Index) -> DataFrame:
    """(table, n): rows of each table."""
    out = None
    for name in TABLES:
        one = getattr(index, name).agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out

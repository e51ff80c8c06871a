"""Shared pieces: text columns, documents as nodes, salted groups, gapless ranks, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.storage import drop, own_folder, table

__all__ = ["NO_ID", "beside", "components", "drop", "fresh", "gapless", "id_of", "keyed", "node", "own_folder", "read", "release", "salted_join", "salts_in", "table", "tidy", "unkeyed"]

#: Stands for a null id inside an operator, so that joins and orders see a value; turned back at the end.
NO_ID = -(2**63)
#: Rows that one gapless-rank bucket is meant to hold.
RANK_ROWS = 100_000
#: Parts that the rows of one group are dealt over where each meets its group's answer.
SALTS = 48


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Gives memory that a task has freed back to the system; a worker that waits for its next task would keep it otherwise."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over Arrow or pandas batches that releases its memory when its task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def node(key: Column, text: Column) -> Column:
    """16 bytes that stand for a document, by doc_id and text: rows of one doc_id with other texts are other documents. In the order of the
    ids, null first, and for one id in the order of a hash of the text."""
    number = F.coalesce(key.cast("long"), F.lit(NO_ID)).bitwiseXOR(F.lit(NO_ID))
    half = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(half(number), half(F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))))


def id_of(name: str) -> Column:
    """The doc_id of a :func:`node`, null again for null."""
    number = F.conv(F.hex(F.substring(name, 1, 8)), 16, 10).cast("decimal(20,0)") + F.lit(NO_ID).cast("decimal(20,0)")
    return F.when(number != NO_ID, number.cast("long"))


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text)`` with null ids as NO_ID and null texts as empty; all other columns are left behind, so
    extra columns of any name do no harm."""
    return df.select(
        F.coalesce(df[key].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text")
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unkeyed(name: str = "id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def _bit(salt: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def salts_in(by: str) -> Column:
    """Aggregate: which salts a group has rows in."""
    return F.bit_or(_bit(_salt(by)))


def salted_join(df: DataFrame, keys: list[str], by: str, groups: DataFrame, mask: str) -> DataFrame:
    """``df`` joined with ``groups``, which has one row a group and in ``mask`` its :func:`salts_in`: a group's rows are dealt over SALTS by a hash of
    ``by``, and its row is copied to those salts, so no task needs all rows of a group."""
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.col(mask).bitwiseAND(_bit(k)) != 0)
    copies = groups.select(*[c for c in groups.columns if c != mask], F.explode(salts).alias("_salt"))
    return df.withColumn("_salt", _salt(by)).join(copies, [*keys, "_salt"]).drop("_salt")


def beside(df: DataFrame, keys: list[str], by: str, **found: Column) -> DataFrame:
    """``df`` with aggregates of each group as columns. They are combined in each map task first and come back by :func:`salted_join`."""
    groups = df.groupBy(*keys).agg(*[f.alias(n) for n, f in found.items()], salts_in(by).alias("_in"))
    return salted_join(df, keys, by, groups, "_in")


def gapless(df: DataFrame, group: list[str], order: list[str], rows: int, out: str = "rank") -> DataFrame:
    """Adds ``out``: 0, 1, ... without gaps inside each ``group``. Equal rows are counted in each map task and take successive places. A group may
    hold most rows, so each is split into hash buckets of about RANK_ROWS rows; a bucket's start is the sum of the bucket counts before
    it. The hash takes ``order``, so the result depends on the rows only and survives recomputation."""
    buckets = max(1, -(-rows // RANK_ROWS) * 2)
    parted = df.groupBy(*df.columns).agg(F.count("*").alias("_same")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    starts = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ahead = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parted.withColumn("_at", F.coalesce(F.sum("_same").over(ahead), F.lit(0)))
    first = F.col("_start") + F.col("_at")
    return inside.join(starts, [*group, "_bucket"]).select(*df.columns, F.explode(F.sequence(first, first + F.col("_same") - 1)).alias(out))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(id, component)`` for the ids in ``links(a, b)`` that aren't the smallest of their component; component is that id.

    Alternating large-star and small-star steps: each node's neighbours are hung under the smallest of them.
    Every step is an aggregation and an equi-join on ids, hubs being dealt over salts, written to the shared folder; nothing but
    the number and a checksum of the links comes to the driver. Ids are of any type with an order."""
    edges = table(spark, links.where("a <> b").select("a", "b").distinct(), "edges")
    last = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = beside(both, ["u"], "v", m=F.min("v")).where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = beside(down, ["u"], "v", m=F.min("v"))
        small = low.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        after = table(spark, small, "edges")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(spark, edges)
        edges = after
        if tuple(sign) == last:
            break
        last = tuple(sign)
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component"))

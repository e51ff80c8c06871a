"""Elements to chunks: paragraphs packed into sized groups, tables cut with their header, images whole.

All of it is Column expressions. The sequential packing of one section is a fold over its pieces inside the row, so a
chunk job is one narrow stage; only the running index within a document needs its rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle import config
from brindle.functions import text as T
from brindle.schema import CHUNK_COLUMNS


def heading_prefix(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n"))).otherwise(F.lit(""))


def pieces(body: Column, budget: Column) -> Column:
    """Paragraphs, those over the budget in slices of it."""
    paragraphs = F.filter(F.split(body, rf"\n{T.SPACE}*\n"), lambda p: ~T.is_blank(p))
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / budget).cast("int") - 1), lambda i: F.substring(p, i * budget + 1, budget))
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= budget, F.array(p)).otherwise(slices(p))))


def pack(parts: Column, budget: Column) -> Column:
    """Neighbouring pieces joined by an empty line while they fit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        return T.let(F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p)), lambda joined: place(acc, p, joined))

    def place(acc: Column, p: Column, joined: Column) -> Column:
        fits = F.length(joined) <= budget
        closed = F.when(fits | (acc["now"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(closed.alias("done"), F.when(fits, joined).otherwise(p).alias("now"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def _room(path: Column, most: int) -> tuple[Column, Column]:
    """The prefix to use and the characters left for the body; a prefix that leaves none is dropped."""
    prefix = heading_prefix(path)
    left = F.lit(most) - F.length(prefix)
    return F.when(left > 0, prefix).otherwise(F.lit("")), F.when(left > 0, left).otherwise(F.lit(most))


def text_parts(body: Column, path: Column, most: int = config.MAX_CHARS) -> Column:
    prefix, budget = _room(path, most)
    groups = F.when(F.length(body) <= budget, F.array(body)).otherwise(F.filter(pack(pieces(body, budget), budget), lambda g: ~T.is_blank(g)))
    return F.transform(groups, lambda g: F.concat(prefix, g))


def table_parts(table: Column, path: Column, most: int = config.MAX_CHARS) -> Column:
    """struct(parts, too_long): a table's rows in parts that each begin with its two header lines; a row over the budget is a
    part of its own."""
    prefix, budget = _room(path, most)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("long"))

    def fold(header: Column, rows: Column) -> Column:
        def step(acc: Column, row: Column) -> Column:
            return T.let(F.concat(F.coalesce(acc["now"], header), F.lit("\n"), row), lambda joined: place(acc, row, joined))

        def place(acc: Column, row: Column, joined: Column) -> Column:
            fits = F.length(joined) <= budget
            over = ~fits & (F.length(header) + 1 + F.length(row) > budget)
            alone = F.concat(header, F.lit("\n"), row)
            closed = F.when(fits | acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
            return F.struct(
                F.when(over, F.concat(closed, F.array(alone))).otherwise(closed).alias("done"),
                F.when(fits, joined).when(over, F.lit(None)).otherwise(alone).alias("now"),
                (acc["long"] | over).alias("long"),
            )

        def finish(acc: Column) -> Column:
            parts = F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
            return F.struct(F.transform(parts, lambda p: F.concat(prefix, p)).alias("parts"), acc["long"].alias("too_long"))

        return F.aggregate(rows, start, step, finish)

    def cut(all_lines: Column) -> Column:
        whole = F.struct(F.array(F.concat(prefix, table)).alias("parts"), F.lit(False).alias("too_long"))
        return F.when(F.size(all_lines) <= 2, whole).otherwise(fold(F.concat_ws("\n", F.slice(all_lines, 1, 2)), F.slice(all_lines, 3, F.greatest(F.size(all_lines), F.lit(3)))))

    return T.let(T.lines(table), cut)


def chunk_elements(elements: DataFrame, most: int = config.MAX_CHARS) -> DataFrame:
    """One row a chunk. ``part`` counts the pieces of an element, ``idx`` the chunks of a document."""
    path = F.col("heading_path")
    cut = elements.withColumn("_t", F.when(F.col("kind") == "table", table_parts(F.col("text"), path, most)))
    parts = (
        F.when(F.col("kind") == "table", F.col("_t.parts"))
        .when(F.col("kind") == "image", F.array(F.concat(heading_prefix(path), F.col("text"))))
        .otherwise(text_parts(F.col("text"), path, most))
    )
    codes = F.when(F.col("kind") == "table", F.when(F.col("_t.too_long"), F.array(F.lit("table_row_too_long"))).otherwise(F.array().cast("array<string>")))
    rows = cut.withColumn("degrade", F.coalesce(codes, F.col("degrade"))).select("*", F.posexplode(parts).alias("part", "_chunk")).where(~T.is_blank(F.col("_chunk")))
    at = Window.partitionBy("doc_id").orderBy("order", "part")
    rows = rows.withColumn("idx", F.row_number().over(at) - 1).withColumn("text", F.col("_chunk"))
    return rows.withColumn("chunk_id", T.chunk_key(F.col("doc_id"), path, F.col("idx"))).select(*CHUNK_COLUMNS)


def plain_elements(documents: DataFrame) -> DataFrame:
    """Documents without Markdown structure as one text element each."""
    null = F.lit(None)
    body = T.strip(T.one_line_end(F.col("text")))
    return documents.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("text").alias("kind"), F.lit(0).alias("order"), body.alias("text"), F.array().cast("array<string>").alias("heading_path"),
        null.cast("int").alias("page"), null.cast("struct<x0:double,top:double,x1:double,bottom:double>").alias("bbox"), null.cast("string").alias("image_ref"),
        null.cast("string").alias("image_path"), F.lit(True).alias("table_structured"), F.array().cast("array<string>").alias("degrade"),
    ).where(F.col("text") != "")


def plain_chunks(documents: DataFrame, most: int = config.MAX_CHARS) -> DataFrame:
    """Chunks of documents that are one element each: the index is the part's place, so no rows move."""
    whole = plain_elements(documents)
    rows = whole.select("*", F.posexplode(F.filter(text_parts(F.col("text"), F.col("heading_path"), most), lambda p: ~T.is_blank(p))).alias("part", "_chunk"))
    rows = rows.withColumn("text", F.col("_chunk")).withColumn("idx", F.col("part"))
    return rows.withColumn("chunk_id", T.chunk_key(F.col("doc_id"), F.col("heading_path"), F.col("idx"))).select(*CHUNK_COLUMNS)


def over_cap_ratio(sections: DataFrame, most: int = config.MAX_CHARS) -> DataFrame:
    """The share of non-empty sections (heading_path, text) that are longer than a chunk."""
    over = F.length(heading_prefix(F.col("heading_path"))) + F.length("text") > most
    return sections.where(~T.is_blank(F.col("text"))).agg(F.coalesce(F.avg(over.cast("double")), F.lit(0.0)).alias("over_cap_ratio"), F.count("*").alias("n_sections"))

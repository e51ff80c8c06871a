"""Corpus folders, label files and images as DataFrames."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN = (".md", ".markdown")
PDF = (".pdf",)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, suffix, content) of all files below ``folder``; doc_id is the relative path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + "/" + root.split(":", 1)[-1].strip("/") + "/", "")
    return files.select(relative.alias("doc_id"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"), "content")


def markdown_documents(files: DataFrame) -> DataFrame:
    """(doc_id, text) of the Markdown files."""
    return files.where(F.col("suffix").isin(*MARKDOWN)).select("doc_id", F.decode("content", "UTF-8").alias("text"))


def read_qaset(spark: SparkSession, path: str) -> DataFrame:
    """(line, question, answers, category, history) of a JSON-lines label file. Blank lines are skipped; a line that is no object
    or lacks a field fails the query and names itself."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "raw")).where(F.trim("raw") != "")
    kind = "struct<question:string,answer_chunk_ids:array<string>,category:string,history:array<struct<role:string,text:string>>>"
    parsed = F.from_json("raw", kind, {"mode": "PERMISSIVE"})
    line = F.col("at") + 1
    lacks = F.concat_ws(", ", *[F.when(parsed[f].isNull(), F.lit(f)) for f in ("question", "answer_chunk_ids", "category")])
    fail = F.raise_error(F.concat(F.lit("line "), line.cast("string"), F.lit(": not an object with "), lacks)).cast("string")
    return rows.select(
        line.alias("line"), F.when(lacks == "", parsed["question"]).otherwise(fail).alias("question"), parsed["answer_chunk_ids"].alias("answers"), parsed["category"].alias("category"),
        F.coalesce(parsed["history"], F.array()).alias("history"),
    )


def cache_name(ref: str) -> str:
    """A file name for an image: a hash of its address, with its suffix."""
    return hashlib.sha1(ref.encode()).hexdigest()[:16] + (os.path.splitext(urlparse(ref).path)[1] or ".png")


def fetch_images(elements: DataFrame, fetch: Callable[[str], bytes], read: Callable[[str], bytes], cache: str | None = None) -> DataFrame:
    """Adds image, image_path and fetch_code to elements with image_ref. ``fetch`` gets remote addresses, ``read`` local ones; remote
    images go through the ``cache`` folder, which all executors must reach (a path or URI of any of pyarrow's file systems), written under
    another name and renamed, as executors may fetch one image at once."""

    def store():
        if cache is None:
            return None, None
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(cache if "://" in cache else "file://" + cache.removeprefix("file:"))
        fs.create_dir(root, recursive=True)
        return fs, root.rstrip("/")

    def remote(ref: str, fs, root: str | None) -> tuple[bytes | None, str | None, str | None]:
        path = f"{root}/{cache_name(ref)}" if fs else None
        try:
            if path:
                with fs.open_input_stream(path) as f:
                    return f.read(), path, None
        except OSError:
            pass  # not there yet
        try:
            data = fetch(ref)
        except Exception:  # any failure of the network is this code
            return None, None, "image_fetch_failed"
        try:
            if path:
                draft = f"{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(data)
                fs.move(draft, path)
        except OSError:
            path = None
        return data, path, None

    def local(ref: str | None) -> tuple[bytes | None, str | None, str | None]:
        try:
            return read(ref), ref, None
        except Exception:  # whatever keeps a file from being read, it is missing
            return None, None, "image_missing"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for batch in batches:
            at = at or store()
            got = [remote(r, *at) if (r or "").startswith(("http://", "https://")) else local(r) for r in batch["image_ref"]]
            yield batch.assign(image=[g[0] for g in got], image_path=[g[1] for g in got], fetch_code=[g[2] for g in got])

    kept = elements.drop("image", "image_path", "fetch_code")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{kinds}, image binary, image_path string, fetch_code string")

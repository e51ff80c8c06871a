"""Markdown documents to ordered elements: headings, fenced code, tables, images, text.

Which line is what depends on all lines before it in the document, so a document is parsed as a whole, many documents to an
Arrow batch. Everything after this step is Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import tables
from brindle.schema import ELEMENT

#: The grammar of headings, images and references to images.
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_IMAGE = re.compile(r"!\[(?P<alt>[^\]]*)\]\((?P<ref>[^)]+)\)")  # without an address it is text
_LATER_IMAGE = re.compile(r"!\[[^\]]*\]\[[^\]]*\]")


def without_front_matter(text: str) -> str:
    rows = text.splitlines()
    if rows and rows[0].strip() == "---":
        end = next((k for k, r in enumerate(rows[1:], 1) if r.strip() == "---"), None)
        if end is not None:
            return "\n".join(rows[end + 1 :])
    return text


def is_fence(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def _marked(lines: list[str]) -> Iterator[tuple[str, str]]:
    """Each line with its kind before tables and images are looked at: code, heading or plain."""
    code = False
    for line in lines:
        if is_fence(line):
            code = not code
            yield "code", line
        elif not code and _HEADING.fullmatch(line):
            yield "heading", line
        else:
            yield ("code" if code else "plain"), line


def descend(path: tuple[str, ...], level: int, title: str) -> tuple[str, ...]:
    """The path below a new heading: it cuts the path to less than ``level`` entries, whatever their own levels were."""
    return (*path[: level - 1], title)


def blocks(text: str, images: bool = False) -> list[tuple[str, tuple[str, ...], str, str | None, list[str]]]:
    """(kind, heading path, text, image reference, codes) in reading order."""
    rows = list(_marked(without_front_matter(text).splitlines()))
    out: list[tuple] = []
    path: tuple[str, ...] = ()
    kept: list[str] = []
    codes: set[str] = set()

    def close() -> None:
        body = "\n".join(kept).strip()
        if body:
            out.append(("text", path, body, None, sorted(codes)))
        kept.clear()
        codes.clear()

    k = 0
    while k < len(rows):
        kind, line = rows[k]
        k += 1
        if kind == "heading":
            close()
            marks, title = _HEADING.fullmatch(line).groups()
            path = descend(path, len(marks), title.strip())
        elif kind == "plain" and images and (m := _IMAGE.fullmatch(line.strip())):
            close()
            out.append(("image", path, m["alt"].strip(), m["ref"].strip(), []))
        elif kind == "plain" and tables.is_row(line) and k < len(rows) and tables.is_separator(rows[k][1]):
            if images and _LATER_IMAGE.fullmatch(line.strip()):
                codes.add("image_ref_unresolved")
            end = k
            while end < len(rows) and tables.is_row(rows[end][1]):
                end += 1
            raw, k = [line, *(r for _, r in rows[k:end])], end
            table = tables.normal(raw)
            if table is None:
                kept.extend(raw)
            else:
                close()
                out.append(("table", path, table, None, []))
        else:
            if kind == "plain" and images and _LATER_IMAGE.fullmatch(line.strip()):
                codes.add("image_ref_unresolved")
            kept.append(line)
    close()
    return out


def sections(text: str) -> list[tuple[int, str, str]]:
    """(level, title, body) of each heading, and of what stands before the first as level 0 if there is any."""
    out, level, title, kept = [], 0, "", []
    for kind, line in [*_marked(without_front_matter(text).splitlines()), ("heading", "")]:
        if kind != "heading":
            kept.append(line)
            continue
        body = "\n".join(kept).strip()
        if body or level:
            out.append((level, title, body))
        kept = []
        if line:
            marks, title = _HEADING.fullmatch(line).groups()
            level, title = len(marks), title.strip()
    return out


def parse(documents: DataFrame, images: bool = False) -> DataFrame:
    """ELEMENT rows of Markdown documents (doc_id, text). With ``images``, image lines become image elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                for order, (kind, path, body, ref, codes) in enumerate(blocks(text or "", images)):
                    rows.append((doc, kind, order, body, list(path), None, None, ref, None, True, codes))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "order", "text", "heading_path", "page", "bbox", "image_ref", "image_path", "table_structured", "degrade"])

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, ELEMENT)


def section_table(documents: DataFrame) -> DataFrame:
    """(doc_id, section, level, title, heading_path, text) of every section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                path: tuple[str, ...] = ()
                for k, (level, title, body) in enumerate(sections(text or "")):
                    path = descend(path, level, title) if level else path
                    rows.append((doc, k, level, title, list(path), body))
            yield pd.DataFrame(rows, columns=["doc_id", "section", "level", "title", "heading_path", "text"])

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, section int, level int, title string, heading_path array<string>, text string")

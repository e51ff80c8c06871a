"""From a folder to a search: both kinds of files, images, updates, failing paths, spans; ties and approximate vectors; percentiles."""

import json
import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import index
from brindle.operators import evaluation, fulltext, search, vectors


def read_pages(content):
    """A stand-in for a PDF library: a JSON list of pages."""
    return json.loads(content)


def typed(text, top=0.0):
    return [{"text": c, "x0": 6.0 * k, "x1": 6.0 * k + 5, "top": top, "bottom": top + 10} for k, c in enumerate(text)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    (at / "sub").mkdir()
    (at / "a.md").write_text("# Admin Service\nSee SETUP_KEY.\n\n![Plan](plan.png)\n\n![]()\n\n## get(url)\nfetches pages")
    (at / "sub" / "b.markdown").write_text("# Deploy\nrolls out services")
    (at / "c.pdf").write_text(json.dumps([{"chars": typed("printed manual")}, {"chars": []}]))
    (at / "broken.pdf").write_text("no pdf")
    (at / "notes.txt").write_text("left out")
    return at


def test_folder_to_index_in_one_call(spark, folder, tmp_path):
    def seen(image):
        return '{"image_type": "图表", "content": "boxes and arrows", "data": null, "relations": ""}'

    n = index.build_folder(spark, str(folder), str(tmp_path / "i"), read_pages=read_pages, images=True, read=lambda ref: b"png", vision=seen)
    idx = index.open_index(spark, str(tmp_path / "i"))
    rows = {}
    for r in idx.chunks.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert n == sum(map(len, rows.values())) and set(rows) == {"a.md", "sub/b.markdown", "c.pdf", "broken.pdf"}
    image = next(r for r in rows["a.md"] if r["kind"] == "image")
    assert "Plan" in image["text"] and "boxes and arrows" in image["text"] and image["degrade"] == []
    assert any("![]()" in r["text"] for r in rows["a.md"])  # an image without an address is text
    assert any("printed manual" in r["text"] for r in rows["c.pdf"]) and any("pdf_page_no_text_layer" in r["degrade"] for r in rows["c.pdf"])
    assert [r["degrade"] for r in rows["broken.pdf"]] == [["pdf_open_failed"]]
    off = index.build_folder(spark, str(folder), str(tmp_path / "off"), images=True)
    marks = [r["degrade"] for r in index.open_index(spark, str(tmp_path / "off")).chunks.where("kind = 'image'").collect()]
    assert off == n - len(rows["c.pdf"]) - 1 and marks == [["vlm_unavailable"]]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    assert index.build_folder(spark, str(tmp_path / "empty"), str(tmp_path / "none")) == 0 and not (tmp_path / "none" / "_version").exists()


def test_update_replaces_chunks_everywhere(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    from brindle.operators import chunking, markdown

    index.build(spark, docs([("a", "# One\nalpha beta"), ("b", "# Two\ngamma")]), str(tmp_path / "i"))
    new = chunking.chunk_elements(markdown.parse(docs([("b", "# Two\ndelta OMEGA_KEY"), ("c", "# Three\nalpha")])))
    for source, target in (("i", "j"), ("j", "k")):  # the second time nothing changes
        assert index.update(spark, str(tmp_path / source), new, str(tmp_path / target)) == 3
        got = index.open_index(spark, str(tmp_path / target))
        want = index.index_of(got.chunks)
        for name in index.TABLES:
            have = [getattr(i, name) for i in (got, want)]
            rows = [sorted(map(str, (tuple(r) for r in t.select(*sorted(t.columns)).collect()))) for t in have]
            assert rows[0] == rows[1], name
    asked = spark.createDataFrame([("1", "delta"), ("2", "gamma")], "query_id string, query string")
    assert {r["query_id"] for r in fulltext.search(asked, got.postings, got.size).collect()} == {"1"}


def test_another_version_is_built_again(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# One\nalpha")], "doc_id string, text string")
    path = str(tmp_path / "i")
    index.build(spark, docs, path)
    spark.createDataFrame([(1,)], "version int").write.mode("overwrite").parquet(f"{path}/_version")
    with pytest.raises(ValueError):
        index.open_index(spark, path)
    assert index.open_index(spark, path, lambda: index.build(spark, docs, path)).chunks.count() == 1


def test_paths_that_fail_while_they_run_leave_the_others(spark, tmp_path):
    index.build(spark, spark.createDataFrame([("a", "# Admin Service\nintro\n## get(url)\nbody")], "doc_id string, text string"), str(tmp_path / "i"))
    idx = index.open_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([("1", "Admin Service get")], "query_id string, query string")
    spans = []

    @contextmanager
    def tracer(name):
        spans.append(name)
        yield

    def broken(texts):
        raise RuntimeError("no embedder here")

    result = search.run(spark, idx, asked, embedder=broken, tracer=tracer)
    assert set(result.degraded) == {"vector"} and "no embedder here" in result.degraded["vector"]
    assert {r["path"] for r in result.hits.collect()} == {"fulltext", "graph"} and result.fused.count() > 0
    assert sorted(spans) == ["path fulltext", "path graph", "path vector"]
    with pytest.raises(Exception, match="no embedder here"):
        search.run(spark, idx, asked, embedder=broken, on_error="raise")
    rows, degraded = search.endpoint(spark, idx, "Admin Service", paths=["fulltext", "unknown"])
    assert rows.count() > 0 and not degraded
    for bad in ({"query": " \n"}, {"query": ""}, {"query": "x", "k": 0}, {"query": "x", "k": 101}):
        with pytest.raises(ValueError):
            search.endpoint(spark, idx, **bad)
    assert search.endpoint(spark, idx, "Admin", paths=[])[0].count() == 0


def test_equal_vectors_give_k_rows(spark):
    rows = spark.range(3000).select(F.format_string("v%04d", "id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    asked = rows.limit(5).select(F.col("chunk_id").alias("query_id"), "embedding")
    got = vectors.nearest(asked, rows.coalesce(2), 10)
    assert got.count() <= 5 * 10 * 2
    best = vectors.top_k(got, [F.desc("score")], "vector", 10).collect()
    assert sorted({r["chunk_id"] for r in best}) == [f"v{k:04d}" for k in range(10)] and len(best) == 50
    scores = np.array([[1, 3, 3, 3, 2], [5, 5, 5, 5, 5]])
    assert sorted(zip(*(x.tolist() for x in vectors.best_of(scores, 2)))) == [(0, 1), (0, 2), (1, 0), (1, 1)]


def test_approximate_vectors_find_nine_in_ten(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    asked = e.where("cast(chunk_id as int) % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    rows = lambda df: {(r["query_id"], r["chunk_id"]) for r in vectors.top_k(df, [F.desc("score")], "vector", 10).collect()}
    exact, near = rows(vectors.nearest(asked, e)), rows(vectors.near_buckets(asked, e))
    assert len(exact & near) >= 0.9 * len(exact)


def test_percentiles_of_large_groups(spark):
    rnd = random.Random(4)
    rows = [(g, v) for g, n in (("a", 2500), ("b", 1), (None, 40)) for v in ([round(rnd.gauss(0, 9), 1) for _ in range(n)])] + [("c", None), ("a", None)]
    got = {r["g"]: (r["p0"], r["p50"], r["p95"], r["p100"], r["n"]) for r in evaluation.percentile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0, 50, 95, 100]).collect()}
    assert set(got) == {"a", "b", None}
    for g, found in got.items():
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert found == (*[v[round(p / 100 * (len(v) - 1))] for p in (0, 50, 95, 100)], len(v))


def test_phrases_equal_plain_search(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices("abcde", k=rnd.randint(0, 60))) for _ in range(60)]
    chunks = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(texts)], "chunk_id string, text string")
    asked = [".".join(rnd.choices("abcdef", k=n)) for n in (1, 2, 2, 3, 3, 4, 5)] + ["a.a", "a.b a.b"]
    queries = spark.createDataFrame([(str(k), q) for k, q in enumerate(asked)], "query_id string, query string")
    got = {(r["query_id"], r["phrase"], r["chunk_id"]): r["f"] for r in fulltext.matches(fulltext.query_phrases(queries), fulltext.postings(chunks)).collect()}
    want = {}
    for k, q in enumerate(asked):
        for phrase, token in enumerate(q.split()):
            p = token.split(".")
            for c, t in enumerate(texts):
                w = t.split()
                n = sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))
                if n:
                    want[str(k), phrase, f"c{c}"] = n
    assert got == want


def test_best_combination_falls_back(spark):
    grid = spark.createDataFrame([(0.0, 1.0, 0.0, 0.9), (0.5, 0.45, 0.05, 0.7), (0.4, 0.5, 0.1, 0.7)], "vector double, fulltext double, graph double, recall double")
    assert evaluation.best_combination(grid).first()["fulltext"] == 0.45
    assert evaluation.best_combination(grid.limit(1)).collect()[0]["fulltext"] == 1.0 and evaluation.best_combination(grid).count() == 1


def test_matrix_as_one_table(spark):
    of = spark.createDataFrame([("A", "vector", "mrr", 0.5), ("A", "fused", "mrr", 1.0), ("A", "fused", "recall@5", 0.25)], "category string, row string, metric string, value double")
    assert evaluation.pivot(of).split("\n") == ["| category | row | mrr | recall@5 |", "|---|---|---|---|", "| A | fused | 1.000 | 0.250 |", "| A | vector | 0.500 | - |"]


def test_whole_statistics_of_an_ingestion(spark, small):
    """Counted again from the chunks, line by line."""
    from brindle.operators import chunking, markdown
    from brindle.plans.corpus import handbook

    chunks = chunking.chunk_elements(markdown.parse(handbook(spark, small))).collect()
    want = {}
    for c in chunks:
        want["kind", c["kind"]] = want.get(("kind", c["kind"]), 0) + 1
        if c["kind"] == "table":
            key = ("table_part", "later" if c["part"] else "first")
            want[key] = want.get(key, 0) + 1
            whole = all(x.startswith("|") and x.endswith("|") for x in c["text"].split("\n")[1:])
            want["table_rows", "whole" if whole else "broken"] = want.get(("table_rows", "whole" if whole else "broken"), 0) + 1
    from brindle.plans import registry

    assert {(r["measure"], r["key"]): r["n"] for r in registry.chunk_statistics(spark, small).collect()} == want
    n = {r["table"]: r["n"] for r in registry.index_tables(spark, small).collect()}
    assert n["chunks"] == n["vectors"] == len(chunks) and n["size"] == 1 and set(n) == set(index.TABLES)


def test_question_sets_are_made_of_their_chunks(spark, small):
    from brindle.plans import registry

    rows = registry.question_sets(spark, small).collect()
    assert {r["category"] for r in rows} <= set("ABCD") and all(r["answers"] for r in rows)
    assert [(r["category"], r["question"]) for r in rows] == sorted((r["category"], r["question"]) for r in rows)

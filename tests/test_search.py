import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from brindle import config, index
from brindle.operators import fulltext, fusion, search, vectors
from brindle.plans import registry


def test_bm25_equals_sqlite(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["requests", "get", "foo", "bar", "naïve"]
    rows = [(f"c{i:03d}", " ".join(rnd.choice(words) + rnd.choice(["", ".", "_x"]) for _ in range(rnd.randint(1, 40)))) for i in range(200)]
    asked = ["w1 w2 w3", "requests.get", "foo_bar w5 w5", "??? w7", "NAIVE", "unknown", "w1.w2 w3"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, t, tokenize='unicode61')")
    con.executemany("INSERT INTO f VALUES (?, ?)", rows)
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    q = spark.createDataFrame([(str(i), a) for i, a in enumerate(asked)], "query_id string, query string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in fulltext.search(q, fulltext.postings(chunks), fulltext.corpus_size(chunks), 1000).collect()}
    want = {}
    for i, a in enumerate(asked):
        expression = " OR ".join(f'"{t}"' for t in a.split())
        for key, score in con.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (expression,)):
            want[str(i), key] = score
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)
    assert all(s < 0 for s in got.values())


def test_whole_texts_are_searched(spark, tmp_path):
    from brindle.plans import registry

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i * 25, " ".join(rnd.choices(words, k=rnd.randint(3, 40)))) for i in range(12)]
    items = [(1, "the first five words here then " + rows[5][1]), (2, " ".join(rnd.choices(words, k=20)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, t, tokenize='unicode61')")
    chunks = registry.plain_chunks(spark, str(tmp_path)).collect()
    con.executemany("INSERT INTO f VALUES (?, ?)", [(r["chunk_id"], r["text"]) for r in chunks])
    got = {}
    for r in registry.bm25_whole_texts(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    asked = {**{f"b{k}": t for k, t in items}, **{f"d{k}": t for k, t in rows if k % 100 == 0}}
    assert len(chunks) == len(rows) and got.keys() == asked.keys() and len(asked) == 5
    for key, text in asked.items():
        expression = " OR ".join(f'"{t}"' for t in text.split())
        best = [s for s, in con.execute("SELECT bm25(f) FROM f WHERE f MATCH ? ORDER BY 1 LIMIT 10", (expression,))]
        assert sorted(got[key]) == pytest.approx(best, abs=1e-8)


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, path string, chunk_id string, rank int, score double")


def test_fusion(spark):
    h = hits(spark, [("q", "vector", "a", 1, 0.9), ("q", "vector", "b", 2, 0.8), ("q", "graph", "b", 1, 2.0), ("q", "fulltext", "c", 1, -3.0)])
    rows = {r["chunk_id"]: r for r in fusion.fuse(h).collect()}
    assert rows["b"]["rank"] == 1 and rows["b"]["rrf_score"] == 1 / 61 + 1 / 62 and rows["b"]["sources"] == ["graph", "vector"]
    assert rows["b"]["contributions"] == {"graph": 1 / 61, "vector": 1 / 62}
    assert (rows["a"]["rank"], rows["c"]["rank"]) == (2, 3)  # equal scores go by id
    weighted = {r["chunk_id"]: r["rrf_score"] for r in fusion.fuse(h, {"vector": 0.0, "graph": 2.0, "unknown": 5.0}).collect()}
    assert weighted == {"b": 2 / 61, "c": 1 / 61}
    assert fusion.fuse(h, {}).count() == 3 and fusion.fuse(h.where("false")).count() == 0


def test_routing(spark):
    q = spark.createDataFrame([("lex", "foo_bar"), ("plain", "words only"), ("dom", "words")], "query_id string, query string")
    h = hits(spark, [("dom", "fulltext", c, i, s) for i, (c, s) in enumerate([("a", -9.0), ("b", -3.0), ("c", -3.0), ("d", -3.0)], 1)] + [("plain", "fulltext", "a", 1, -3.0), ("plain", "vector#rw", "a", 1, 0.5), ("plain", "other", "a", 1, 1.0)])
    w = {(r["query_id"], r["path"]): r["weight"] for r in fusion.route(q, h).collect()}
    s = config.STATIC_WEIGHTS
    for k in ("lex", "dom"):
        assert w[k, "fulltext"] == s["fulltext"] * 1.8 and w[k, "vector"] == s["vector"] * 0.6 and w[k, "graph"] == s["graph"]
    assert w["plain", "fulltext"] == s["fulltext"] and w["plain", "vector#rw"] == s["vector"] * 0.5 and w["plain", "other"] == 1.0


def small_index(spark):
    docs = spark.createDataFrame([("admin.md", "# Admin Service\nhow to run it\n## get(url)\nreads a page"), ("deploy.md", "# Deploy\n## Steps\nrun the Admin Service")], "doc_id string, text string")
    from brindle.operators import chunking, markdown

    return index.index_of(chunking.chunk_elements(markdown.parse(docs)))


@pytest.fixture(scope="module")
def admin(spark):
    return small_index(spark), spark.createDataFrame([("1", "Admin Service get"), ("2", "  ")], "query_id string, query string")


def test_three_paths(spark, admin):
    idx, q = admin
    result = search.run(spark, idx, q)
    rows = result.hits.collect()
    assert {r["path"] for r in rows} == set(config.PATHS) and {r["query_id"] for r in rows} == {"1"}
    for p in config.PATHS:
        ranks = sorted(r["rank"] for r in rows if r["path"] == p)
        assert ranks == list(range(1, len(ranks) + 1))
    best = search.respond(result, idx).where("rank = 1").first()
    assert best["doc_id"] == "admin.md" and best["sources"] == ["fulltext", "graph", "vector"]


def test_paths_can_be_switched_off(spark, admin):
    idx, q = admin
    assert {r["path"] for r in search.run(spark, idx, q, paths=["graph", "nonsense"]).hits.select("path").collect()} == {"graph"}
    assert search.run(spark, idx, q, paths=[]).fused.count() == 0
    with pytest.raises(ValueError):
        search.run(spark, idx, q, k=0)


@pytest.mark.parametrize("path", config.PATHS)
def test_a_failing_path_leaves_the_others(spark, admin, path):
    idx, q = admin

    def broken():
        raise RuntimeError("down")

    result = search.run(spark, idx, q, extra={path: broken})
    assert result.degraded == {path: "RuntimeError: down"}
    assert {r["path"] for r in result.hits.select("path").distinct().collect()} == set(config.PATHS) - {path}
    with pytest.raises(RuntimeError):
        search.run(spark, idx, q, extra={path: broken}, on_error="raise")


def test_late_failures_count_as_empty(spark, admin):
    idx, q = admin
    late = lambda: q.select("query_id", F.raise_error(F.lit("late")).cast("string").alias("chunk_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    assert "vector" in search.run(spark, idx, q, extra={"vector": late}).degraded


@pytest.mark.parametrize("name, path", [("fused_equal", "fulltext"), ("fused_equal", "graph"), *(("fused_search", p) for p in config.PATHS)])
@pytest.mark.parametrize("late", [False, True])
def test_queries_with_a_failing_path_fail(spark, small, monkeypatch, name, path, late):
    """Their results have no place that names a missing path, so rows of the others alone would look whole."""
    whole = search.path_hits

    def broken():
        if not late:
            raise RuntimeError("down")
        return spark.range(1).select(F.lit("q").alias("query_id"), F.raise_error(F.lit("down")).cast("string").alias("chunk_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))

    monkeypatch.setattr(search, "path_hits", lambda *a: whole(*a) | {path: broken})
    with pytest.raises(Exception, match="down"):
        registry.QUERIES[name](spark, small).collect()


def test_rerank_stays_within_its_depth(spark):
    fused = spark.createDataFrame([("q", c, i) for i, c in enumerate("abcd", 1)], "query_id string, chunk_id string, rank int")
    q = spark.createDataFrame([("q", "x")], "query_id string, query string")
    t = spark.createDataFrame([(c, c) for c in "abcd"], "chunk_id string, text string")
    got = fusion.rerank(fused, q, t, lambda pairs: [ord(b) for _, b in pairs], depth=3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c", "b", "a"]


def test_character_bag():
    a, b, c = vectors.character_bag(["abc", "cba", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and c == [0.0] * 128


def test_nearest_in_blocks_keeps_ties(spark, monkeypatch):
    v = spark.createDataFrame([(f"v{i}", [float(i % 3), 1.0]) for i in range(30)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", [1.0, float(i)]) for i in range(5)], "query_id string, embedding array<double>")
    whole = sorted(map(tuple, vectors.nearest(q, v, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, vectors.nearest(q, v, 3).collect())) == whole and len(whole) >= 15


def test_build_open_and_rebuild(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# A\nMAX_VALUE is set"), ("b.md", "# B\ntext")], "doc_id string, text string")
    path = str(tmp_path / "index")
    assert index.build(spark, docs, path) == 2 and index.build(spark, docs, path) == 2
    idx = index.open_index(spark, path)
    q = spark.createDataFrame([("1", "max_value")], "query_id string, query string")
    first = search.respond(search.run(spark, idx, q), idx).where("rank = 1").first()
    assert first["doc_id"] == "a.md" and first["heading_path"] == ["A"]
    assert idx.texts(spark.createDataFrame([("nope",)], "chunk_id string")).first()["text"] is None
    assert index.build(spark, docs.where("false"), str(tmp_path / "none")) == 0
    spark.createDataFrame([(1,)], "version int").write.mode("overwrite").parquet(f"{path}/_version")
    with pytest.raises(ValueError, match="build it again"):
        index.open_index(spark, path)


def test_upsert(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "chunk_id string, text string")
    b = spark.createDataFrame([("2", "z")], "chunk_id string, text string")
    assert sorted(map(tuple, index.upsert(a, b).collect())) == [("1", "x"), ("2", "z")]

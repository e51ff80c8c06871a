import pytest
from pyspark.sql import functions as F

from brindle.operators import chunking, evaluation, graph, markdown


def test_measures(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["c", "x", "c"]), ([], ["a"]), (["a"], [])], "r array<string>, a array<string>")
    got = df.select(evaluation.recall(F.col("r"), F.col("a"), 2), evaluation.recall(F.col("r"), F.col("a"), 3), evaluation.reciprocal_rank(F.col("r"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.5, 1 / 3), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


@pytest.fixture(scope="module")
def stub(spark):
    q = spark.createDataFrame([("1", "A", ["c1"]), ("2", "C", ["c2"])], "query_id string, category string, answers array<string>")
    h = spark.createDataFrame([("1", "vector", "c1", 1, 1.0), ("2", "graph", "c2", 1, 1.0), ("2", "vector", "c9", 1, 1.0)], "query_id string, path string, chunk_id string, rank int, score double")
    return q, h


def test_matrix_has_no_total(spark, stub):
    from brindle.operators import fusion

    q, h = stub
    m = evaluation.evaluate(q, h, fusion.fuse(h), [1, 5])
    values = {(r["category"], r["row"], r["metric"]): r["value"] for r in m.collect()}
    assert {k[0] for k in values} == {"A", "C"} and {k[1] for k in values} == {"vector", "fulltext", "graph", "fused"}
    assert values["A", "vector", "recall@5"] == 1.0 and values["C", "fused", "mrr"] == 1.0 and values["C", "fulltext", "mrr"] == 0.0
    assert "| A | fused | 1.000 | 1.000 | 1.000 |" in [r["line"] for r in evaluation.render(m).collect()]
    assert {r["category"]: r["warns"] for r in evaluation.discrimination(m).collect()} == {"A": False, "C": False}
    assert "Accepted: no" in evaluation.report(m)


def matrix(spark, rows):
    return spark.createDataFrame([(c, r, "recall@5", v) for c, r, v in rows], "category string, row string, metric string, value double")


def test_gains_and_verdict(spark):
    up = [("C", "fused", 0.9), ("C", "vector", 0.5), ("D", "fused", 0.8), ("D", "graph", 0.7), ("A", "fused", 0.5), ("A", "vector", 0.5)]
    assert {r["category"]: r["verdict"] for r in evaluation.gains(matrix(spark, up)).collect()} == {"A": "持平", "C": "提升", "D": "提升"}
    assert evaluation.accepted(evaluation.gains(matrix(spark, up))).first()["accepted"]
    for worse in (up[:2], up[:-2] + [("A", "fused", 0.4), ("A", "vector", 0.5)], []):
        assert not evaluation.accepted(evaluation.gains(matrix(spark, worse))).first()["accepted"]
    assert evaluation.discrimination(matrix(spark, [("A", "vector", 0.5), ("A", "fused", 0.5)])).count() == 0
    assert evaluation.discrimination(matrix(spark, [("A", "vector", 0.5), ("A", "graph", 0.52)])).first()["warns"]


def test_grid(spark):
    rows = evaluation.weight_grid(spark).collect()
    assert len(rows) == 231 and all(abs(r["vector"] + r["fulltext"] + r["graph"] - 1) < 1e-9 and min(r["vector"], r["fulltext"], r["graph"]) >= 0 for r in rows)


def test_grid_scores_as_fusing_one_by_one(spark, stub):
    from brindle.operators import fusion

    q, h = stub
    grid = evaluation.weight_grid(spark, 0.5)
    scored = {r["combo"]: (r["recall"], r["mrr"]) for r in evaluation.score_grid(q, h, grid).collect()}
    for g in grid.collect():
        w = {p: g[p] for p in ("vector", "fulltext", "graph")}
        lists = evaluation.ranked_lists(fusion.fuse(h, w), F.lit("x"))
        want = evaluation.measures(q, lists, ["x"], [5]).agg(F.avg("recall@5"), F.avg("mrr")).first()
        assert scored[g["combo"]] == pytest.approx(tuple(want))
    ranked = evaluation.rank_grid(evaluation.score_grid(q, h, grid)).collect()
    assert ranked[0]["recall"] == max(r["recall"] for r in ranked)


def test_criterion_takes_the_first_of_equal_paths(spark):
    t = spark.createDataFrame([("vector", 0.5), ("fulltext", 0.5), ("graph", 0.1), ("fused_routed", 0.5)], "row string, `recall@5` double")
    r = evaluation.criterion(t, "fused_routed").first()
    assert (r["best_row"], r["met"]) == ("vector", True)


def test_percentile_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)], "g string, v double")
    r = evaluation.percentile(df, ["g"], "v", [50, 100, 0]).first()
    assert (r["p50"], r["p100"], r["p0"], r["n"]) == (2.0, 5.0, 0.0, 6)


def test_question_generation(spark):
    text = "# requests 模块\nabout MAX_POOL\n## requests.get(url)\nx MAX_POOL\n## Notes\ny MAX_POOL"
    c = chunking.chunk_elements(markdown.parse(spark.createDataFrame([("a", text)], "doc_id string, text string")))
    g = graph.Graph(c)
    rows = evaluation.generate_questions(c, g, graph.alias_map(g.nodes), graph.neighbours(g.edges), 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["category"], {})[r["question"]] = r["answers"]
    assert set(by["A"]) == {"requests 模块 是什么？", "requests.get(url) 是什么？", "Notes 是什么？"}
    assert "我想了解 requests.get(地址) 相关的内容" in by["B"] and "我想了解 请求 模块 相关的内容" in by["B"]
    assert len(by["C"]["MAX_POOL 出现在哪些地方？"]) == 3 and len(by["D"]["requests 模块 下都讲了什么？"]) == 3


def test_ingest_report(spark):
    docs = spark.createDataFrame([("a", "# T\nx\n| a |\n|---|\n| 1 |"), ("b", "![i](gone.png)")], "doc_id string, text string")
    text = evaluation.ingest_report(chunking.chunk_elements(markdown.parse(docs, images=True)))
    assert "| kind | table | 1 |" in text and "| image | placeholder | 1 |" in text and "all whole" in text


def test_label_contract(spark):
    one = lambda k: spark.createDataFrame([(f"{k}{i}", "unanswerable" if i < 3 else "fact") for i in range(15)], "question string, category string")
    assert [r["ok"] for r in evaluation.qaset_contract(one("a"), one("b")).collect()] == [True, True]
    assert [r["ok"] for r in evaluation.qaset_contract(one("a"), one("a")).collect()] == [False, False]

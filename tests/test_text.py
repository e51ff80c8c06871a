import re
import unicodedata

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import graph


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *[c(F.col("x")) for c in columns]).orderBy("i").collect()]


def test_strip_and_lines_are_pythons(spark):
    inputs = ["  a b\t", "\u3000x\x1c", "", "a\nb\r\nc\x85d\u2028e\n", "\n", "a\n\nb", "no end", "\x0bq\x0c"]
    got = values(spark, inputs, lambda c: T.strip(c).alias("s"), lambda c: T.lines(c).alias("l"))
    for x, (s, found) in zip(inputs, got):
        assert s == x.strip()
        assert found == x.splitlines()


def test_terms_fold_case_and_accents(spark):
    inputs = ["Éléphant naïve", "foo_bar.baz-9", "ñandú ÜBER", "???", "ﬁn ½", "中文 abc"]
    (got,) = zip(*values(spark, inputs, T.terms))
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    for x, t in zip(inputs, got):
        assert t == re.findall(r"[^\W_]+", fold(x))


def test_phrases(spark):
    (got,) = zip(*values(spark, ["requests.get  timeout", "??? a", " ", "foo_bar x x"], T.phrases))
    assert got == ([["requests", "get"], ["timeout"]], [["a"]], [], [["foo", "bar"], ["x"], ["x"]])


def test_index_text_cuts_cjk_only(spark):
    (got,) = zip(*values(spark, ["用requests.get取 url", "abc  d", ""], T.index_text))
    assert got == ("用 requests.get 取 url", "abc d", "")


def test_graph_normal(spark):
    (got,) = zip(*values(spark, ["requests.get(url, a=1)?", "  A—B_c ", "前端(错误)!"], T.graph_normal))
    assert got == ("requests.get url a 1", "a b_c", "前端 错误")


def test_contains_phrase(spark):
    cases = [
        ("curling is fun", "url", False), ("the url is", "url", True), ("怎么处理前端错误呢", "2 前端错误", True), ("介绍", "介绍", True), ("这是介绍吗", "介绍", False),
        ("x requests 模块 y", "requests 模块", True), ("x", "", False),
    ]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(cases)], "i int, q string, a string")
    got = [r[0] for r in df.orderBy("i").select(T.contains_phrase(F.col("q"), F.col("a"))).collect()]
    assert got == [c[2] for c in cases]


def test_lexical_signal(spark):
    inputs = ["use `x`", "foo_bar", "camelCase", "the API", "an Api", "见API用", "A", "lower only"]
    (got,) = zip(*values(spark, inputs, T.lexical_signal))
    assert got == (True, True, True, True, False, False, False, False)


def test_synonyms_take_the_first_entry(spark):
    got = values(spark, ["timeout url", "配置 参数", "nothing"], lambda c: T.synonym(c)[0].alias("a"), lambda c: T.synonym(c)[1].alias("b"))
    assert got == [("timeout 地址", True), ("配置 选项", True), ("nothing", False)]


def test_snippet_and_table_rows(spark):
    df = spark.createDataFrame([("c", "d", None, "a\n b" * 60), ("c", "d", 3, "x")], "c string, d string, p int, t string")
    a, b = (r[0] for r in df.select(T.snippet(F.col("c"), F.col("d"), F.col("p"), F.col("t"))).collect())
    assert a.startswith("c · d · p? · a ba b") and a.endswith("…") and b == "c · d · p3 · x"
    (got,) = zip(*values(spark, ["h\n| a |\n| b |", "| a |\n| b", "no table"], T.rows_whole))
    assert got == (True, False, False)


def test_identifiers(spark):
    text = "MAX_URL HTTP GET FAQ ROUTER see src/app.ts and //example.com/x.ts, Config.JSON a.xyz `term one` ` ` `MAX_URL` URLPath"
    (got,) = values(spark, [text], graph.constants, graph.file_paths, graph.quoted_terms, graph.identifiers)
    assert got == (["MAX_URL", "ROUTER", "MAX_URL"], ["src/app.ts", "example.com/x.ts", "Config.JSON"], ["term one", "MAX_URL"], ["MAX_URL", "ROUTER", "src/app.ts", "example.com/x.ts", "Config.JSON", "term one"])


def test_chunk_key(spark):
    import hashlib

    got = spark.range(1).select(T.chunk_key(F.lit("a.md"), F.array(F.lit("H"), F.lit("K")), F.lit(3))).first()[0]
    assert got == hashlib.sha1(b"a.md|H/K|3").hexdigest()[:16]

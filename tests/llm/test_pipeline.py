import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from brindle import storage
from brindle.llm import minmax, ordinal
from tests.llm import brute

ROOT = Path(__file__).resolve().parents[2]


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_strings", "decontamination", "packing"]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """The documents before each stage and after the last, written and read again as the stages are run."""
    at, out = tmp_path_factory.mktemp("steps"), []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in P.STAGES:
        out.append(docs)
        stage(spark, docs, small).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return [*out, docs]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_but_the_last_return_documents(steps):
    for df in steps[:5]:
        assert df.columns == steps[0].columns and df.count() > 0


def test_quality_keeps_what_the_model_keeps(spark, small, steps):
    model = ordinal.train(spark, steps[0], spark.read.parquet(f"{small}/labels.parquet"))
    graded = rows(ordinal.grade_documents(steps[0], model))
    assert set(rows(steps[1])) == {k for k, r in graded.items() if r["kept"]}
    words = "idiot moron worthless pathetic disgusting trash clown stupid loser scum".split()
    toxic = lambda df: sum(sum(f" {w} " in r["text"] for w in words) >= 2 for r in df.collect())
    assert toxic(steps[1]) <= 0.2 * toxic(steps[0])  # from fewer than a hundred labels


def test_near_duplicates_keep_the_first_of_each_group(steps):
    texts = [(k, r["text"]) for k, r in rows(steps[1]).items()]
    groups = brute.near(texts, 5)
    assert set(rows(steps[2])) == {k for k, (_, c) in groups.items() if k == c}


def test_repeated_strings_are_cut(steps):
    before, after = rows(steps[2]), rows(steps[3])
    want = brute.removed([(k, r["text"]) for k, r in before.items()])
    assert set(before) == set(after)
    for k, (n, gone, spans, _) in want.items():
        left = len(after[k]["text"].encode())
        assert n - gone <= left <= n - gone + 6 * spans and after[k]["n_chars"] == len(after[k]["text"])


def test_contaminated_documents_go(spark, small, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaks = brute.leaks([(k, r["text"]) for k, r in rows(steps[3]).items()], items)
    assert set(rows(steps[4])) == {k for k, v in leaks.items() if not v}


def test_packing_takes_all_that_is_left(steps):
    packed = steps[5]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows(steps[4]))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_run_equals_the_stages(spark, small, steps):
    assert P.run(spark, small).select("doc_id", "piece", "ids_crc32").exceptAll(steps[5].select("doc_id", "piece", "ids_crc32")).count() == 0


def test_stages_take_odd_documents(spark, small):
    rnd = random.Random(3)
    long = " ".join(rnd.choices(brute.WORDS, k=40_000))
    rows = [(1, None, None), (2, "", "x"), (None, "words without an id", None), (3, "twice the same", "s"), (3, "twice the same", "s"), (3, "another text of this id", "s"), (4, long, "l"), (5, long, "l"), (6, long[:900], "t"), (7, long[:900] + " more", "t")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit(k).alias(n) for k, n in enumerate(("_bad", "_late", "_id", "_spans", "_t", "id", "component", "spans", "kept", "a.b"))])
    for frame in (odd, odd.where("false")):
        for name, stage in P.STAGES:
            out = stage(spark, frame, small)
            if name == "packing":
                assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in frame.select("doc_id").distinct().collect()}
                continue
            assert out.columns == frame.columns and out.count() <= frame.count()
            assert out.select(*[c for c in out.columns[5:] if "." not in c]).distinct().count() <= 1
            ids = sorted(str(r["doc_id"]) for r in out.collect())
            if frame is not odd:
                assert not ids
            elif name == "near_duplicates":  # of equal texts the smallest id, all rows of a repeated one
                assert ids == sorted(["1", "2", "None", "3", "3", "3", "4", "6"])
            elif name in ("repeated_strings", "decontamination"):
                assert len(ids) == len(rows)
                if name == "repeated_strings":
                    left = {r["doc_id"]: r["text"] for r in out.collect()}
                    assert left[4] == long and left[5] == "" and left[6] == "" and left[7] in (" more", "more")


def test_what_stages_wrote_is_removed(spark, small):
    from pathlib import Path as At

    folder = At(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    with storage.temporary(spark):
        before = set(folder.iterdir())
        P.run(spark, small).count()
        left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
        assert left <= {"pieces", "decontamination"}
    assert set(folder.iterdir()) == before


def test_keep_first_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", 1), (3, "A b c d e f g", 2), (9, None, 3), (8, "", 4)], "doc_id long, text string, n int")
    assert sorted(r["doc_id"] for r in minmax.keep_first(spark, df).collect()) == [3, 8, 9]


def test_everything_else_works_without_this_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)

from pyspark.sql import functions as F

from brindle.operators import chunking, markdown, tables


def elements(spark, text, images=False):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return markdown.parse(df, images).orderBy("order").collect()


def chunks(spark, text, most=1200):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return chunking.chunk_elements(markdown.parse(df), most).orderBy("idx").collect()


def test_heading_path_goes_by_depth_not_level():
    found = markdown.blocks("# H1\na\n### H3a\nb\n### H3b\nc\n### H3c\nd\n## H2\ne")
    assert [b[1] for b in found] == [("H1",), ("H1", "H3a"), ("H1", "H3a", "H3b"), ("H1", "H3a", "H3c"), ("H1", "H2")]


def test_fences_hide_structure():
    found = markdown.blocks("# A\n```\n# not\n| a |\n|---|\n```\ntail\n~~~\n# open")
    assert len(found) == 1 and found[0][1] == ("A",) and "# not" in found[0][2] and "# open" in found[0][2]


def test_front_matter():
    assert markdown.without_front_matter("---\na: 1\n---\nx") == "x"
    assert markdown.without_front_matter("---\nno end") == "---\nno end"
    assert markdown.without_front_matter("x\n---\ny\n---") == "x\n---\ny\n---"


def test_sections_keep_empty_headings_and_the_start():
    assert markdown.sections("pre\n# A #\n## B\nb") == [(0, "", "pre"), (1, "A #", ""), (2, "B", "b")]
    assert markdown.sections("\n\n# A") == [(1, "A", "")]


def test_tables():
    found = markdown.blocks("x\n| a | b |\n|---|---|\n| 1 |\n| 1 | 2 | 3 |\ny\n| a | b |\n|---|\n| z |")
    assert [f[0] for f in found] == ["text", "table", "text"]
    assert found[1][2] == "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"
    assert found[2][2] == "y\n| a | b |\n|---|\n| z |"


def test_cells():
    assert tables.cells(r"| a \| b | c:\temp | \d+ | \\ |") == ["a | b", r"c:\temp", r"\d+", "\\"]
    assert tables.cells("a|b\\") == ["a", "b\\"]
    assert tables.cells("| |") == [""]
    assert tables.normal(["| a |"]) is None and tables.normal(["| a |", "| b |"]) is None
    assert tables.from_rows([["a"], ["b", "c"]]) == "| a |  |\n| --- | --- |\n| b | c |"


def test_images_only_with_engines(spark):
    text = "# H\nintro\n![Alt](a.png)\n![later][x]\nend"
    assert [e["kind"] for e in elements(spark, text)] == ["text"]
    found = elements(spark, text, images=True)
    assert [(e["kind"], e["image_ref"]) for e in found] == [("text", None), ("image", "a.png"), ("text", None)]
    assert found[2]["degrade"] == ["image_ref_unresolved"] and found[2]["text"] == "![later][x]\nend"


def test_chunks_pack_paragraphs(spark):
    body = "a" * 10 + "\n\n" + "b" * 10 + "\n \n" + "c" * 50
    got = chunks(spark, f"# T\n{body}", most=26)
    assert [c["text"] for c in got] == ["T\n" + "a" * 10 + "\n\n" + "b" * 10, "T\n" + "c" * 24, "T\n" + "c" * 24, "T\n" + "c" * 2]
    assert [c["idx"] for c in got] == [0, 1, 2, 3] and [c["part"] for c in got] == [0, 1, 2, 3]


def test_body_that_fits_stays_verbatim(spark):
    (got,) = chunks(spark, "# T\na\n\n\n\nb")
    assert got["text"] == "T\na\n\n\n\nb" and got["heading_path"] == ["T"]


def test_prefix_over_the_cap_is_dropped(spark):
    got = chunks(spark, f"# {'h' * 30}\n{'x' * 25}", most=20)
    assert [c["text"] for c in got] == ["x" * 20, "x" * 5]


def test_table_parts_repeat_the_header(spark):
    rows = "\n".join(f"| r{i} | v |" for i in range(6))
    got = chunks(spark, f"# T\n| a | b |\n|---|---|\n{rows}", most=60)
    assert len(got) > 1 and all(c["text"].startswith("T\n| a | b |\n| --- | --- |\n") and len(c["text"]) <= 60 for c in got)
    assert [line for c in got for line in c["text"].split("\n")[3:]] == rows.split("\n")
    assert {c["kind"] for c in got} == {"table"}


def test_long_row_is_alone_and_marked(spark):
    got = chunks(spark, f"| a |\n|---|\n| s |\n| {'x' * 80} |\n| t |", most=40)
    assert [len(c["text"].split("\n")) for c in got] == [3, 3, 3] and all(c["degrade"] == ["table_row_too_long"] for c in got)
    (only,) = chunks(spark, "| a |\n|---|")
    assert only["text"] == "| a |\n| --- |"


def test_over_cap_ratio(spark):
    df = spark.createDataFrame([(["T"], "x" * 30), ([], "y"), ([], "  ")], "heading_path array<string>, text string")
    assert chunking.over_cap_ratio(df, 20).first()["over_cap_ratio"] == 0.5
    assert chunking.over_cap_ratio(df.where("false"), 20).first()["over_cap_ratio"] == 0.0


def test_plain_chunks_equal_parsed_chunks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = chunking.plain_chunks(docs).select("chunk_id", "text")
    b = chunking.chunk_elements(markdown.parse(docs.select(F.col("doc_id").cast("string"), "text"))).select("chunk_id", "text")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

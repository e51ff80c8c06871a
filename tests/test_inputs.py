import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import images, pdf
from brindle.sources import files
from brindle.streaming import ingest


def test_scan_and_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MD").write_text("# é")
    (tmp_path / "b.txt").write_text("no")
    found = files.scan(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["suffix"]) for r in found.collect()) == [("b.txt", ".txt"), ("sub/a.MD", ".md")]
    assert files.markdown_documents(found).first()["text"] == "# é"


def test_qaset(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    good = {"question": "q", "answer_chunk_ids": ["a"], "category": "fact", "history": [{"role": "user", "text": "t"}]}
    p.write_text(json.dumps(good) + "\n\n" + json.dumps({k: v for k, v in good.items() if k != "history"}) + "\n")
    assert [(r["line"], len(r["history"])) for r in files.read_qaset(spark, str(p)).collect()] == [(1, 1), (3, 0)]
    p.write_text(json.dumps(good) + '\n{"question": "q"}\n')
    with pytest.raises(Exception, match="line 2"):
        files.read_qaset(spark, str(p)).collect()


def element(spark, refs):
    rows = [("alt", r, []) for r in refs]
    return spark.createDataFrame(rows, "text string, image_ref string, degrade array<string>")


def test_fetch_and_cache(spark, tmp_path):
    (tmp_path / "here.png").write_bytes(b"x")
    cache = str(tmp_path / "cache")

    def fetch(url):
        if "bad" in url:
            raise OSError(url)
        return url.encode()

    def read(path):
        with open(path, "rb") as f:
            return f.read()

    refs = [str(tmp_path / "here.png"), str(tmp_path / "gone.png"), "https://e/x.jpg", "https://e/bad.png"]
    got = {r["image_ref"]: r for r in files.fetch_images(element(spark, refs), fetch, read, cache).collect()}
    assert got[refs[0]]["image"] == b"x" and got[refs[1]]["fetch_code"] == "image_missing"
    assert got[refs[2]]["image_path"].endswith(files.cache_name(refs[2])) and got[refs[3]]["fetch_code"] == "image_fetch_failed"
    down = lambda url: 1 / 0
    assert files.fetch_images(element(spark, refs[2:3]), down, read, cache).first()["image"] == refs[2].encode()


def routed(spark, ocr, vision, ref="x.png", image=b"x", code=None):
    rows = spark.createDataFrame([("alt", ref, ref, image, code, [])], "text string, image_ref string, image_path string, image binary, fetch_code string, degrade array<string>")
    return images.route_images(images.run_channels(rows, ocr, vision)).first()


def see(kind, content="content", raw=""):
    return lambda b: {"image_type": kind, "content": content, "data": "", "relations": "r", "raw": raw}


def fails(b):
    raise RuntimeError


def test_routing_table(spark):
    text = lambda b: ("long enough text", 0.9)
    r = routed(spark, text, see("图表"))
    assert r["text"] == "[图片] alt\n类型: 图表\n内容: content\n关系: r\n文字: long enough text" and r["degrade"] == []
    assert routed(spark, text, see("截图"))["text"] == "[图片] alt\n文字: long enough text"
    assert routed(spark, lambda b: ("s", 0.9), see("截图"))["text"].startswith("[图片] alt\n类型: 截图")
    r = routed(spark, lambda b: ("long enough text", 0.1), None)
    assert (r["text"], r["degrade"]) == ("[图片] alt", ["ocr_low_conf", "vlm_unavailable"])
    assert routed(spark, None, None)["degrade"] == ["ocr_empty", "vlm_unavailable"]
    assert routed(spark, fails, fails)["degrade"] == ["ocr_failed", "vlm_failed"]
    assert routed(spark, fails, see("照片"))["degrade"] == ["ocr_failed"]
    r = routed(spark, None, see("其他", "", "raw words"))
    assert "内容: raw words" in r["text"] and r["degrade"] == ["vlm_bad_json"]
    r = routed(spark, text, see("图表"), image=None, code="image_missing")
    assert (r["text"], r["degrade"], r["image_path"]) == ("[图片] alt", ["image_missing"], None)


def test_vision_answers(spark):
    said = ['well ```json\n{"image_type": "图表", "content": null, "data": {"a": 1}}\n```', "[1]", "{bad}", "x" * 300, "{}", None, 'so {"content": "c"} it is']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").select("k", images.vision_answer(F.col("t")).alias("v")).collect()
    got = {r["k"]: tuple(r["v"])[:4] for r in rows}
    assert got[0] == ("图表", "", '{"a":1}', "") and got[1] == ("其他", "[1]", "", "") and got[2] == ("其他", "{bad}", "", "") and got[3][1] == "x" * 200
    assert got[4] == ("", "", "", "") and got[5] == ("其他", "", "", "") and got[6] == ("", "c", "", "")


def test_recognized_lines():
    assert images.recognized([("a", "0.5"), (" ", 1), ("b", None), ("c", 1.0)]) == ("a\nb\nc", 0.75)
    assert images.engine({"e": lambda: fails}, "e") is fails and images.engine({}, "none") is None and images.engine({}, None) is None


def chars(text, top, x=0.0, h=10.0):
    return [{"text": c, "x0": float(x + i), "top": float(top), "x1": float(x + i + 1), "bottom": float(top + h)} for i, c in enumerate(text)]


def box(x0, top, x1, bottom):
    return {"x0": float(x0), "top": float(top), "x1": float(x1), "bottom": float(bottom)}


def test_pdf_layout(spark):
    page = chars("head", 0) + chars("gone", 105, x=2) + chars("near", 20) + chars("far", 200)
    rows = [
        ("d", 1, page, [{"bbox": box(0, 100, 50, 120), "rows": [["a", "b"], ["c", None]]}], [{"bbox": box(0, 300, 9, 309), "data": None}]),
        ("d", 2, [], [], []),
        ("d", 3, chars("t", 0), [{"bbox": box(0, 50, 9, 60), "rows": []}], [{"bbox": box(0, 90, 9, 99), "data": b"i"}]),
    ]
    pages = spark.createDataFrame(rows, pdf.PAGE)
    found = pdf.elements(pdf.regions(pages)).orderBy("order").collect()
    assert [(r["kind"], r["text"], r["page"], r["degrade"]) for r in found] == [
        ("text", "head\nnear", 1, []), ("table", "| a | b |\n| --- | --- |\n| c |  |", 1, []), ("text", "far", 1, []), ("image", pdf.PICTURE, 1, ["pdf_render_failed"]),
        ("text", pdf.NO_RENDERER, 2, ["pdf_page_no_text_layer"]), ("text", "t", 3, []), ("text", pdf.NOT_A_TABLE, 3, ["pdf_table_bbox_missing", "table_unstructured"]), ("image", pdf.PICTURE, 3, []),
    ]
    assert found[3]["image_ref"] == "pdf://d/p1" and found[0]["bbox"]["bottom"] == 30
    drawn = pdf.regions(pages.where("page = 2"), lambda doc, page: b"png").first()
    assert drawn["image"] == b"png" and drawn["degrade"] == ["pdf_page_no_text_layer"]
    assert pdf.regions(pages.where("page = 2"), lambda doc, page: 1 / 0).first()["text"] == pdf.NOT_RENDERED
    assert pdf.unopened(spark.createDataFrame([("x.pdf",)], "doc_id string")).first()["text"] == "[PDF 无法解析] x.pdf"


def test_lines_follow_their_first_character():
    drifting = [{"text": c, "x0": float(i), "top": 4.0 * i, "x1": i + 1.0, "bottom": 4.0 * i + 10} for i, c in enumerate("abcd")]
    assert [t for _, t in pdf.text_lines(drifting)] == ["ab", "cd"]


def test_stream_of_documents(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("doc_id", "text", "version"), r))) + "\n" for r in rows))

    def run():
        ingest.ingest(ingest.documents(spark, src), out, check).awaitTermination()

    put("1.json", [("a", "# A\nold", 1), ("b", "# B\nb", 1), ("a", "# A\nmid", 2)])
    run()
    put("2.json", [("a", "# A\nnew", 3)])
    run()
    assert sorted(r["text"] for r in ingest.current(spark, out).collect()) == ["A\nnew", "B\nb"]


def test_event_windows_on_a_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").where(F.col("event_type").isNotNull())
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    name = "windowed_events"
    ingest.event_counts(stream, late="3650 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = ingest.event_counts(events)
    assert spark.table(name).agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0] == events.count()

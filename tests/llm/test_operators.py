import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bytehash, common, decontaminate, htmltext, lines, lmscore, minmax, ordinal, packing, queries, sharding, suffix, tokens, warc
from tests.compare import duck, same
from tests.llm import brute

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "same text here"), (5, "same text here"), (None, "no id"), (6, "word " * 30_000), (7, "é\x00\U0001f600 #*$")]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that the operators use themselves
        for name in ("id", "rank", "n", "length", "source", "_bucket", "spans", "kept", "h", "_id", "_bad", "_late"):
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def table_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# shared pieces


def test_sliding_min_and_rolling():
    x = np.random.Generator(np.random.PCG64(1)).integers(0, 100, 200, dtype=np.uint64)
    for size in (1, 2, 7, 50):
        assert (bytehash.sliding_min(x, size) == [x[i : i + size].min() for i in range(len(x) - size + 1)]).all()
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    h = bytehash.Rolling(data).windows(3)
    assert h[0] == h[3] == h[7] and len({*h.tolist()}) == 6
    assert bytehash.Rolling(np.frombuffer(b"zzabc", np.uint8)).windows(3)[2] == h[0]


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(45)] + [(500, 500)]
    up = {x: x for a in links for x in a}
    for _ in range(100):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(map(tuple, common.components(spark, spark.createDataFrame(links, "a long, b long")).collect()))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: up[x] for x in linked if x != up[x]}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_ranks(spark, monkeypatch):
    monkeypatch.setattr(common, "RANK_ROWS", 10)
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 30).alias("k"))  # each row ten times
    got = common.gapless(df, ["g"], ["k"], 300).collect()
    for g in range(3):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(100))
    assert sorted((r["g"], r["k"]) for r in got) == sorted(map(tuple, df.collect()))


# 1. quality classifier


def test_ordinal_learns_grades(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        grade = i % 3
        w = rnd.choices(brute.WORDS, k=80)
        if grade == 0:
            w[rnd.randrange(80)] = rnd.choice(["vile", "awful"])
        if grade == 1:
            w = [x + rnd.choice(["***", "$$$"]) for x in w]
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(grade != 1), int(grade == 0)))
    d = docs(spark, rows)
    model = ordinal.train(spark, d, spark.createDataFrame(labels + [(None, 1, 0), (3, None, 1), (0, 1, None)], "doc_id long, quality int, toxic int"))
    assert model.thresholds[0] < model.thresholds[1]
    got = table_of(ordinal.grade_documents(d, model))
    held = [i for i in range(400, 600)]
    assert sum(got[i]["kept"] == (i % 3 == 2) for i in held) >= 0.97 * len(held)
    means = [np.mean([got[i]["expected_grade"] for i in held if i % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    odd = ordinal.grade_documents(docs(spark, ODD, extra=True), model).collect()
    assert len(odd) == len(ODD) and not any(r["kept"] for r in odd if r["doc_id"] in (1, 2, 3))
    kept = ordinal.keep_good(docs(spark, ODD, extra=True), model)
    assert kept.columns == docs(spark, ODD, extra=True).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in odd if r["kept"])


def test_ordinal_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, [(1, "a b"), (2, None)])
    model = ordinal.train(spark, d, none)
    assert model is None and {k: r["kept"] for k, r in table_of(ordinal.grade_documents(d, model)).items()} == {1: True, 2: False}
    assert ordinal.grade_documents(docs(spark, []), model).count() == 0


def test_ordinal_likelihood_gradient():
    rnd = np.random.Generator(np.random.PCG64(2))
    grade = rnd.integers(0, 3, 300)
    h = np.array([5, 6, 7], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = ordinal.CumulativeLink.fit(np.arange(300), h[grade], grade)
    p = model.tails(model.score(np.arange(300), h[grade], 300))
    assert [int(round(p[grade == g].sum(1).mean())) for g in range(3)] == [0, 1, 2]


# 2. suffix dedup


@pytest.mark.parametrize("hall", [2048, 3])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, hall):
    monkeypatch.setattr(suffix, "HALL", hall)
    rows = brute.passages() + [(None, brute.passages()[0][1]), (-5, brute.passages()[1][1])]
    want = brute.removed(rows)
    got = table_of(suffix.removed_bytes(spark, docs(spark, rows, extra=True)))
    assert {k: tuple(r)[1:] for k, r in got.items()} == want
    assert suffix.removed_bytes(spark, docs(spark, [])).count() == 0


def test_runs_equal_plain_prefix_doubling(spark):
    rnd = random.Random(6)
    shared = "".join(rnd.choices("abc d\u00e9", k=150))
    rows = [(i, "".join(rnd.choices("ab ", k=rnd.randint(0, 60))) + shared[rnd.randint(0, 30) : rnd.randint(120, 150)] + "x" * rnd.choice([0, 5, 130])) for i in range(25)] + [(None, shared), (3, None), (77, shared + shared)]
    d = docs(spark, rows, extra=True)
    groups = {}
    for r in suffix.position_ranks(spark, d).collect():
        groups.setdefault(r["rank"], []).append((r["id"], r["t"], r["at"]))
    assert groups and all(len(g) > 1 for g in groups.values())
    later = {p for g in groups.values() for p in sorted(g)[1:]}
    spans, _ = suffix.repeated_spans(spark, d)
    got = set()
    for r in spans.collect():
        got |= {(r["id"], r["t"], at) for s in r["spans"] for at in range(s["a"], s["b"] - 99)}
    assert got == later


def test_one_id_with_several_texts_loses_only_what_repeats(spark):
    rnd = random.Random(7)
    own = ["".join(rnd.choices("abcdefgh ", k=240)) for _ in range(4)]
    rows = [(5, own[0]), (5, own[1]), (9, own[0][:120]), (5, own[2]), (None, own[3]), (None, own[3][50:] + own[2][:60]), (5, own[1])]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix.removed_bytes(spark, docs(spark, rows)).collect())
    assert [g for g in got if g[0] == 5] == [(5, 240, 0)] * 4 and [g for g in got if g[0] == 9] == [(9, 120, 120)]
    none = [g for g in got if g[0] == -1]  # which of the two is first goes by a hash
    assert sorted(n for _, n, _ in none) == [240, 250] and sum(x for _, _, x in none) == 190


def test_cut_documents_keep_columns_of_any_name(spark):
    shared = "".join(random.Random(2).choices("abcdefgh ", k=200))
    names = ("id", "t", "spans", "_id", "_t", "_spans", "_spans_", "_ID_", "a.b", "off")
    rows = [(1, shared), (2, "x" + shared), (2, "y"), (3, None), (4, "z" * 40_000)]
    df = docs(spark, rows).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    out = suffix.cut_documents(spark, df)
    assert out.columns == df.columns
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
    assert sorted((r["doc_id"], r["text"] and r["text"][:100]) for r in out.collect() if r["text"]) == [(1, shared[:100]), (2, "x"), (2, "y"), (4, "z")]


def test_runs_join_over_segments(monkeypatch):
    import pyarrow as pa

    text = " ".join(random.Random(1).choices(brute.WORDS, k=2000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["id", "text"]).append_column("t", pa.array([9]))
    whole = [b.to_pydict() for b in suffix._scan(iter([batch]))]
    monkeypatch.setattr(suffix, "SEGMENT", 500)
    parts = [b.to_pydict() for b in suffix._scan(iter([batch]))]
    windows = lambda bs: {(h, lo + i) for b in bs for h, lo, c in zip(b["h"], b["lo"], b["code"]) for i in range(abs(c) >> 7)}
    assert windows(whole) == windows(parts) and len(windows(whole)) == len(text.encode()) - 99


def test_cut_documents_keep_characters_whole(spark):
    tail = "".join(random.Random(1).choices("üäöéèñ", k=80))
    rows = [(1, f"start {tail}ä"), (2, f"other {tail}ß end"), (3, None), (4, "")]  # ä and ß share their first byte
    df = docs(spark, rows, extra=True).withColumn("n_chars", F.lit(0))
    out = table_of(suffix.cut_documents(spark, df))
    assert out[1]["text"] == rows[0][1] and out[3]["text"] is None and out[4]["text"] == ""
    assert out[2]["text"] == "otherß end" and out[2]["n_chars"] == 10


# 3. quality rules


def test_base_statistics_equal_brute_force():
    rnd = random.Random(4)
    texts = [None, "", " ", "a a a a a a a", "x\nx\ny\n\nx \n", "a b c d e f a b c d e", "#*$%&|<>\x0b#"]
    texts += ["\n".join(" ".join(rnd.choices("abcde", k=rnd.randint(0, 9))) for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    for t in texts:
        assert lines.base_stats(t) == brute.stats(t)


def test_viterbi_equals_enumeration():
    rnd = np.random.Generator(np.random.PCG64(1))
    crf = lines.ChainCrf(rnd.normal(size=len(lines.FEATURES)), rnd.normal(size=(2, 2)))
    lengths = np.array([0, 1, 5, 3, 0, 6])
    x = rnd.normal(size=(lengths.sum(), len(lines.FEATURES)))
    got, at = crf.decode(x, lengths), 0
    for n in lengths:
        s = x[at : at + n] @ crf.weights
        best = max(itertools.product((0, 1), repeat=int(n)), key=lambda y: sum(s[i] * y[i] for i in range(n)) + sum(crf.moves[y[i - 1], y[i]] for i in range(1, n)))
        assert tuple(got[at : at + n]) == best
        at += n


def test_crf_learns_and_decides(spark):
    rnd = random.Random(2)
    clean = lambda: "\n".join(" ".join(rnd.choices(brute.WORDS, k=12)) for _ in range(6))
    junk = lambda: "\n".join(" ".join(w + "***" for w in rnd.choices(brute.WORDS, k=12)) for _ in range(6))
    rows = [(i, clean() if i % 2 else junk()) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + ODD[:4], extra=True).where("doc_id is not null")
    got = table_of(lines.label_quality(d, *lines.train(d, labels)))
    assert all(got[i]["kept"] == bool(i % 2) for i in range(100, 200))
    assert lines.label_quality(docs(spark, ODD, extra=True), lines.ChainCrf()).count() == len(ODD)
    assert lines.label_quality(docs(spark, []), lines.ChainCrf()).count() == 0


def test_crf_gradient_raises_the_likelihood():
    rnd = np.random.Generator(np.random.PCG64(3))
    n = np.full(40, 8)
    x = rnd.normal(size=(n.sum(), len(lines.FEATURES)))
    y = (x[:, 1] > 0).astype(int)
    crf = lines.ChainCrf(np.zeros(len(lines.FEATURES)), np.zeros((2, 2))).fit(x, n, y)
    assert (crf.decode(x, n) == y).mean() > 0.97 and np.argmax(np.abs(crf.weights)) == 1


# 4. WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("id", F.lit(2)).withColumn("row", F.lit(3))


def test_archives_round_trip(spark, monkeypatch, tmp_path):
    big, mid = "é<p>" * 5000, "m" * 100
    rows = [(5, "u5", big), (2, "u2", mid), (9, "u9", big), (7, None, None), (3, "u\r\n3", ""), (4, "u4", "m" * 99), (8, "u8", "m" * 99), (11, "u11", mid), (None, "n", "x"), (11, "u11", mid)]
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(spark, pages(spark, rows), folder, chunk=1000)
    got = warc.read_archives(archives, folder, chunk=1000).collect()
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    by = {}
    for r in sorted(got, key=lambda r: r["chunk"]):
        by.setdefault(r["id"], []).append(r)
    assert b"".join(r["data"] for r in by[5]).decode() == big and max(len(r["data"]) for r in got) == 1000
    running = hashlib.sha256()
    for r in by[5]:
        running.update(r["data"])
        assert r["digest"] == running.hexdigest()
    assert by[9][0]["record_type"] == "revisit" and by[9][0]["refers_to"] == 5 and by[9][0]["length"] == len(big.encode())
    out = table_of(warc.archive_round_trip(spark, pages(spark, rows)), "page_id")
    assert (out[11]["record_type"], out[11]["refers_to"]) == ("revisit", 2) and out[8]["record_type"] == out[4]["record_type"] == "response"
    assert out[7]["payload_bytes"] == 0 and out[None]["payload_digest"] == hashlib.sha256(b"x").hexdigest()
    assert warc.archive_round_trip(spark, pages(spark, [])).count() == 0


def test_revisits_go_by_id_and_payload(spark, tmp_path):
    a, b, c = "a" * 120, "b" * 130, "c" * 10
    rows = [(2, "u", a), (5, "u", a), (5, "u", b), (5, "u", a), (6, "u", b), (6, "u", a), (None, "u", b), (8, None, c), (9, None, c), (8, "u", None)]
    got = warc.archive_round_trip(spark, pages(spark, rows)).collect()
    want = []
    for key, _, html in rows:
        same_ = [k for k, _, x in rows if x == html]
        first = None if None in same_ else min(same_)
        again = html is not None and len(html) >= 100 and key != first
        want.append((key, len(html or ""), hashlib.sha256((html or "").encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(spark, pages(spark, rows), folder)
    stored = {bytes(r["data"]).decode() for r in warc.read_archives(archives, folder).where("record_type = 'response'").collect()}
    assert stored == {a, b, c, ""}


def test_beside_gives_each_row_its_groups_answer(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = common.beside(df, ["g"], "k", least=F.min("k"), most=F.max("k")).collect()
    assert len(got) == 500 and all((r["least"], r["most"]) == (r["g"], max(range(r["g"], 500, 3))) for r in got)


def test_archives_are_gzip_members(spark, tmp_path):
    archives = warc.write_archives(spark, pages(spark, [(1, "http://e/", "<p>x")]), f"file://{tmp_path}/w")
    raw = open(archives.first()["archive"], "rb").read()
    text = zlib.decompress(raw, 31).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("\r\n\r\n<p>x\r\n\r\n")


# 5. sharding


def test_rendezvous_moves_rows_only_into_the_new_shard(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_documents(d).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert 350 < sum(r["grown_shard"] == 8 for r in rows) < 540
    for s in range(8):
        own = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(own) == list(range(len(own))) and 400 < len(own) < 600
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(d, 9).collect()}
    assert grown == {r["doc_id"]: r["grown_shard"] for r in rows}


def test_weights_and_odd_rows(spark):
    d = spark.range(9000)
    counts = dict(map(tuple, d.groupBy(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0])).count().collect()))
    assert set(counts) == {0, 1} and 1.8 < counts[1] / counts[0] < 2.2
    got = sharding.shard_documents(docs(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] == 7:
            raw = ODD[-1][1].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert [r["size"] for r in got if r["doc_id"] == 1] == [1]
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [0.0])


# 6. language model


def test_network_gradient():
    rnd = np.random.Generator(np.random.PCG64(1))
    ids = rnd.integers(1, lmscore.SIZE, 200)
    near = lmscore.windows(ids, np.array([120, 0, 80]))
    assert near[1][0] == 0 and near[1][1] == ids[0] and near[2][119] == 0 and near[0][120] == 0
    net = lmscore.WindowNetwork.start()
    g = net.gradient(near, ids)
    for i in [int(np.argmax(np.abs(g))), *rnd.choice(np.flatnonzero(np.abs(g) > 1e-4), 5)]:
        side = []
        for e in (1e-2, -1e-2):
            flat = net.flat.copy()
            flat[i] += e
            side.append(lmscore.WindowNetwork(flat).log_probabilities(near, ids).astype(float).mean())
        assert g[i] == pytest.approx((side[0] - side[1]) / 2e-2, rel=0.05, abs=1e-5)


def test_probabilities_add_up_to_one():
    net = lmscore.WindowNetwork.start()
    near = np.array([[1], [2], [3], [4]]).repeat(lmscore.SIZE, axis=1)
    assert np.exp(net.log_probabilities(near, np.arange(lmscore.SIZE)).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_scores_tell_language_from_shuffles(spark):
    rnd = random.Random(5)
    grammar = {w: rnd.choices(brute.WORDS, k=3) for w in brute.WORDS}

    def sentence(n):
        out = [rnd.choice(brute.WORDS)]
        while len(out) < n:
            out.append(rnd.choice(grammar[out[-1]]))
        return out

    rows = [(i, " ".join(sentence(60))) for i in range(1500)]
    d = docs(spark, rows + ODD, extra=True)
    ranked = lmscore.count_words(d)
    net = lmscore.train(d, ranked)
    held = [" ".join(sentence(60)) for _ in range(60)]
    mixed = [" ".join(rnd.sample(t.split(), 60)) for t in held]
    got = table_of(lmscore.score_documents(docs(spark, list(enumerate(held + mixed))), ranked, net))
    good, bad = ([got[i]["mean_log_probability"] for i in r] for r in (range(60), range(60, 120)))
    assert np.mean(good) > np.mean(bad) + 0.2 and np.mean([g > b for g, b in zip(good, bad)]) > 0.9
    odd = lmscore.score_documents(docs(spark, ODD, extra=True), ranked, net).collect()
    assert len(odd) == len(ODD)
    none = next(r for r in odd if r["doc_id"] == 1)
    assert none["log_probability"] == 0 and none["mean_log_probability"] is None
    assert lmscore.pseudo_likelihood(docs(spark, [])).count() == 0


def plain_score(net, text, known, n):
    """The sum of log-probabilities of a text, word by word. ``known``: hash -> id, ``n``: hash -> count."""
    hashed = [int(h) for w in (text or "").split() for h in lmscore.hashes([w])[0]]
    bucket = lambda h: 1 + lmscore.KNOWN + (h >> 20) % lmscore.HASHED
    ids, total = [known.get(h, bucket(h)) for h in hashed], 0.0
    for i, (h, x) in enumerate(zip(hashed, ids)):
        near = [ids[i + j] if 0 <= i + j < len(ids) else 0 for j in lmscore.SIDES]
        hidden = np.tanh(sum(net.near[j][y].astype(float) for j, y in enumerate(near)))
        c, slot = x % lmscore.CLASSES, x // lmscore.CLASSES
        for logits, k in ((net.top @ hidden + net.top_bias, c), (net.low[c] @ hidden + net.low_bias[c], slot)):
            total += logits[k] - np.log(np.exp(logits).sum())
        if h not in known:
            whole = sum(v for g, v in n.items() if g not in known and bucket(g) == x)
            total += np.log(n.get(h, lmscore.UNSEEN)) - np.log(whole + lmscore.UNSEEN)
    return total


@pytest.mark.parametrize("frequent", [1 << 16, 3])
def test_scores_equal_plain_python(spark, monkeypatch, frequent):
    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choices(brute.WORDS[:120], k=rnd.randint(1, 40)))) for i in range(80)] + [(900, None), (901, ""), (3, "again w1 w1"), (3, "again w1 w1"), (None, "rare rare typo")]
    d = docs(spark, rows, extra=True)
    ranked = lmscore.count_words(d)[:40]
    net = lmscore.train(d, ranked)
    n = {r["word"] & (2**64 - 1): r["n"] for r in lmscore.word_counts(d).collect()}
    known = {int(h) & (2**64 - 1): k + 1 for k, h in enumerate(ranked)}
    asked = rows + [(5000, "w1 neverseen w2 neverseen"), (5001, "w300x")]
    got = lmscore.score_documents(docs(spark, asked), ranked, net, lmscore.word_counts(d)).collect()
    want = sorted((str(k), round(plain_score(net, t, known, n), 2)) for k, t in asked)
    assert [k for k, _ in want] == [k for k, _ in sorted((str(r["doc_id"]), r["log_probability"]) for r in got)]
    assert np.allclose([v for _, v in want], [v for _, v in sorted((str(r["doc_id"]), r["log_probability"]) for r in got)], atol=0.05)


def test_words_of_one_bucket_are_told_apart(spark):
    known = [f"k{i}" for i in range(lmscore.KNOWN)]
    buckets = {}
    for w in (f"x{i}" for i in range(400)):
        buckets.setdefault(int(lmscore.hashes([w])[0][0] >> np.uint64(20)) % lmscore.HASHED, []).append(w)
    often, once = next(v for v in buckets.values() if len(v) > 1)[:2]
    rows = [(i, " ".join(known)) for i in range(20)] + [(100 + i, often) for i in range(9)] + [(200, once), (300, None), (301, ""), (200, once)]
    out = lmscore.pseudo_likelihood(docs(spark, rows, extra=True)).collect()
    got = {r["doc_id"]: r["log_probability"] for r in out}
    assert len(out) == len(rows) and got[100] - got[200] == pytest.approx(np.log(9 / 2)) and got[300] == got[301] == 0
    assert len({r["log_probability"] for r in out if r["doc_id"] == 200}) == 1


# 7. near duplicates


@pytest.mark.parametrize("k, block, shingles", [(2, 2048, 2_000_000), (5, 8, 2_000_000), (2, 2048, 500)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, block, shingles):
    monkeypatch.setattr(minmax, "BLOCK", block)
    monkeypatch.setattr(minmax, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(minmax, "SALTS", 3)
    rows = brute.near_copies()
    got = table_of(minmax.near_duplicates(spark, docs(spark, rows, extra=True), k))
    assert {key: (r["n_shingles"], r["component_id"]) for key, r in got.items()} == brute.near(rows, k)
    assert all(r["kept"] == (key == r["component_id"]) for key, r in got.items())


def test_one_id_with_several_texts_is_several_documents(spark):
    long = brute.near_copies()[3][1]
    rows = [(5, "alpha beta gamma delta"), (5, "one two three four five six"), (5, "one two three four five six"), (9, "ONE two three four five six"), (None, long), (None, "alpha beta gamma delta"), (7, long)]
    got = [tuple(r) for r in minmax.near_duplicates(spark, docs(spark, rows), k=2).collect()]
    by = {(r[0], r[1]): (r[2], r[3]) for r in got}
    assert by[5, 5] == (5, True) and by[9, 5] == (5, False) and by[5, 3] == (None, False) and by[None, 3] == (None, True)
    kept = minmax.keep_first(spark, docs(spark, rows), k=2).collect()
    assert sorted(str(r["text"]) for r in kept) == sorted(["one two three four five six"] * 2 + [long, "alpha beta gamma delta"])


def test_near_duplicates_of_nothing(spark):
    assert minmax.near_duplicates(spark, docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        minmax.near_duplicates(spark, docs(spark, []), percent=50)


def test_estimate_is_unbiased():
    rnd = np.random.Generator(np.random.PCG64(9))
    shared, a, b = (rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([shared, x])) for x in (a, b)]
    sig = minmax.signatures(bytehash.mix(np.concatenate(sets)), np.array([len(s) for s in sets]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12


# 8. decontamination


def test_masks_survive_any_two_replacements():
    for pair in itertools.combinations(range(decontaminate.WINDOW), decontaminate.MISSES):
        assert any(not {o + p for p in m} & set(pair) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1]))


def test_contamination_equals_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "the"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 6, 9, 12, 13, 14, 20, 30])))) for i in range(25)] + [(99, None)]
    rows = []
    for k in range(120):
        w = [x if rnd.random() > 0.12 else "zz" for x in rnd.choice(items[:-1])[1].split()]
        rows.append((k, ", ".join([*rnd.choices(vocabulary, k=rnd.randint(0, 20)), *w, *rnd.choices(vocabulary, k=rnd.randint(0, 20))]).upper()))
    rows += [(500, None), (501, ""), rows[0]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = table_of(decontaminate.contamination(spark, docs(spark, rows, extra=True), bench))
    want = brute.leaks(rows, items)
    assert {k: r["item_ids"] for k, r in got.items()} == want and sum(map(bool, want.values())) > 20
    kept = decontaminate.clean_documents(spark, docs(spark, rows, extra=True), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in rows if not want[k])
    assert decontaminate.contamination(spark, docs(spark, ODD, extra=True), bench.where("false")).where("kept").count() == len(ODD)
    assert decontaminate.contamination(spark, docs(spark, []), bench).count() == 0


def test_items_of_every_length_are_searched(spark):
    rnd = random.Random(8)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 14)] + [(50, "水の沸点は何度ですか？"), (51, "中国"), (52, "¿Qué «color» tiene—hoy?"), (53, "？！"), (54, None)]
    rows, want = [], {}

    def put(text, *found):
        rows.append((len(rows), text))
        want[len(rows) - 1] = sorted(found)

    for n in range(1, 14):
        w, allowed = items[n - 1][1].split(), 2 if n == 13 else int(n >= 7)
        for gone in range(min(n, 3) + 1):
            for places in itertools.islice(itertools.combinations(rnd.sample(range(n), n), gone), 6):
                out = ["zz" if k in places else x for k, x in enumerate(w)]
                put(" ".join(["aa", *out, "bb"]), *([n] if gone <= allowed else []))
    put("答えは水の沸点は何度ですか。", 50), put("問：水の融点は何度ですか", 50), put("水の温度は何度ですか"), put("在中国。", 51), put("中 和 国")
    put("dice: qué color tiene hoy", 52), put("qué flor tiene hoy"), put("？！"), put(None), put("")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = table_of(decontaminate.contamination(spark, docs(spark, rows, extra=True), bench))
    assert {k: r["item_ids"] for k, r in got.items()} == want
    kept = decontaminate.clean_documents(spark, docs(spark, rows, extra=True), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in want.items() if not v)


def test_query_and_pipeline_search_every_item(spark, tmp_path):
    import corpus_pipeline

    d = docs(spark, [(1, "so what is two plus two then"), (2, "nothing of it")])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Two plus two?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = table_of(queries.QUERIES["op8_spaced_seed_decontamination"](spark, str(tmp_path)))
    assert (got[1]["item_ids"], got[2]["item_ids"]) == ([7], [])
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, d, str(tmp_path)).collect()] == [2]


# 9. packing


def fewest(sizes, capacity):
    """The optimum of a tiny instance, by branch and bound."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j, r in enumerate(rooms):
            if r >= sizes[i] and r not in rooms[:j]:
                place(i + 1, [*rooms[:j], r - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def filled(counts, plan):
    bins = {}
    for w, n in counts.items():
        for rank in range(n):
            first, q, sequence, offset = plan[w][np.searchsorted(plan[w][:, 0], rank, side="right") - 1]
            bins.setdefault(sequence + (rank - first) // q, []).append((offset + (rank - first) % q * w, w))
    return bins


def test_plans_are_gapless_and_reduction_never_costs_a_bin():
    for seed in range(150):
        rnd = random.Random(seed)
        capacity = rnd.choice([10, 20, 50])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        counts = {w: sizes.count(w) for w in sizes}
        for own in filled(counts, packing.plan(counts, capacity)).values():
            at = 0
            for offset, w in sorted(own):
                assert offset == at
                at += w
            assert at <= capacity
        fixed, left = packing.reduce_instance(counts, capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        taken = [w for p, n in fixed for w in p * n]
        assert sorted(taken + rest) == sorted(sizes)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)


def test_ids_equal_the_tokenizers():
    encoder = tokens.ChunkEncoder(tokenizer(), cache=50)
    texts = ["don't I'll 'S <|endoftext|> x", "İstanbul ΣΑΣ", "a\x1cb \x85 c", "é é", "", "½ ² ª º 12 3.4 a_b", "ﬁ", "!''s'll''x 's", "ǅ ß ſ", "Ünïcode*** (x), y's " * 20, "中文 text"]
    want = [np.asarray(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder.encode([t])[0] for t in texts] == want and encoder.encode(texts) == want


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(brute.WORDS, k=rnd.choice([0, 5, 300, 900])))) for i in range(100, 160)] + ODD
    got = packing.pack(spark, docs(spark, rows, extra=True), tokenizer(), 1024).collect()
    t = Tokenizer.from_file(tokenizer())
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    for key, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = {(k, a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes())) for k, a in enumerate(range(0, len(ids), 1024))}
        assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[key]} == want and len(pieces[key]) == len(want) * [k for k, _ in rows].count(key)
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.pack(spark, docs(spark, []), tokenizer()).count() == 0


# 10. HTML


HTML = [
    ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>z", "- x\n- y\n  3. p\n  4. q\n\nz"),
    ("<table><tr><th>Name<th>N<tr><td>apple pie<td>3<tr><td colspan=2>sum<td>t</table>", "Name       N\napple pie  3\nsum           t"),
    ("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>", "r  a\n   b"), ("<pre> x\n   y</pre>", " x\n   y"),
    ("<div hidden>n</div><p style='display: none'>n</p><script>'<p>'</script><style>b</style><title>t</title>x<!-- c -->y", "xy"),
    ("<b>one</b> <i> two</i>three", "one twothree"), ("&lt;ok&gt; a<3 &amp;", "<ok> a<3 &"), ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("</p>x</div>", "x"), ("<td>loose", "loose"),
    ("<p>un<b>closed", "unclosed"), ("<a href='x>y'>link</a>", "link"), ("<textarea>&lt;</textarea>", "<"), ("", ""),
]


@pytest.mark.parametrize("html, text", HTML)
def test_html(html, text):
    assert htmltext.visible_text(html) == text


SHOWN = [
    ("<p>so <math><mi>x</mi> <mo>=</mo> <mfrac><mrow><mi>a</mi><mo>+</mo><mn>1</mn></mrow><mn>2</mn></mfrac></math> holds", "so x=(a+1)/2 holds"),
    ("<math><semantics><msup><mi>c</mi><mn>2</mn></msup><annotation>c^{2}</annotation></semantics></math>", "c^2"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd></mtr></mtable></math>", "1 2\n3"),
    ("a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><style>s</style><path d='x'/><text x='1'>North <tspan>5</tspan></text><text>South</text></svg>b", "a\nNorth 5\nSouth\nb"),
    ("<svg><defs/><g><text>label</text><text display='none'>no</text></g></svg>", "label"), ("<svg><defs><path><p>after", "after"),
    ("<svg><foreignObject><div>in</div></foreignObject></svg>", "in"),
    ("Size<select name=s><option>S<option selected>M<option>L</select>now", "Size M now"), ("<select><option disabled>pick<option>one<option>two</select>", "one"),
    ("x<select multiple><optgroup label='Fruit'><option>fig<option>pear<optgroup label='Nut'><option label='oak nut'>o</select>y", "x\nFruit\nfig\npear\nNut\noak nut\ny"),
    ("<select size=3><option>a<option hidden>b<option>c</select>", "a\nc"), ("<datalist><option>a</datalist>x", "x"), ("<select><option>a<input>x", "a x"),
    ("<svg style='display:none'><text>no</text></svg>x", "x"),
]


@pytest.mark.parametrize("html, text", SHOWN)
def test_formulas_drawings_and_choices_are_shown(html, text):
    assert htmltext.visible_text(html) == text


READ = [
    ("<p class=it's>Hello world</p><p>second</p>", "Hello world\n\nsecond"), ("<p don't>a</p>b", "a\n\nb"), ("<!-->text", "text"), ("<!--->text", "text"), ("<!-- a --!>b", "b"),
    ("<a href='x>y' title=\"a>b\">link</a>", "link"), ("<p a=>x", "x"), ("a</ foo>b</>c", "abc"), ("x<a b='y", "x"), ("<![CDATA[x>y", "y"), ("<svg><text><![CDATA[a<b]]></text></svg>", "a<b"),
    ("<script>a</scripts>b</script >c", "c"), ("<head><title>t</title><p>Hello", "Hello"), ("<html><head>x<body>y", "x\ny"),
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"), ("<p style='display:none;display:block'>a", "a"), ("<p style='display:none !important;display:block'>a", ""),
    ("<div hidden style='display:block'>s</div>", "s"), ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"), ("<ol type=i start=4><li>a</ol>", "iv. a"), ("<ol type=A start=27><li>a</ol>", "AA. a"),
    ("<table><tr><td>\u4e2d\u6587<td>b<tr><td>a<td>c</table>", "\u4e2d\u6587  b\na     c"), ("<table><tr><td>" + "x" * 130 + "<tr><td>a<td>b</table>", "x" * 120 + "\n" + "x" * 10 + "\na" + " " * 121 + "b"),
    ("<table><tr><td>a<td>" + "x" * 300 + "</table>", "a  " + "x" * 300), ("<table><tr><td colspan=2>longer<td>z<tr><td>a<td>b<td>c</table>", "longer  z\na  b    c"),
    ("<table><tr><td>" + "word " * 40 + "<td>r</table>", ("word " * 24).strip() + "  r\n" + ("word " * 16).strip()),
]


@pytest.mark.parametrize("html, text", READ)
def test_tags_styles_and_lists_as_browsers_have_them(html, text):
    assert htmltext.visible_text(html) == text


def page(rnd, seen):
    """A random page with most optional end tags left out; its visible words go to ``seen`` in order."""
    fresh = itertools.count()

    def words(shown):
        own = [f"w{next(fresh)}x{rnd.choice(['', '\u4e2d', '\u00e9'])}" for _ in range(rnd.randint(1, 6))]
        seen.extend(own if shown else [])
        return rnd.choice([" ", "\n ", "&#32;"]).join(own)

    def part(depth, shown):
        kind = rnd.choice(["p", "div", "ul", "table", "hide", "note", "b", "show"]) if depth < 4 else "p"
        attribute = rnd.choice(["", " class=it's", " title='a>b'", " a=\"<p>\"", " don't", " x=y/"])
        inner = lambda s=shown: "".join(part(depth + 1, s) for _ in range(rnd.randint(1, 2)))
        if kind == "p":
            return f"<p{attribute}>{words(shown)}" + rnd.choice(["", "</p>"])
        if kind == "div":
            return f"<DIV{attribute}>{inner()}</div>"
        if kind == "b":
            return f"<p><b{attribute}>{words(shown)}</b> "
        if kind == "ul":
            return "<ul>" + "".join(f"<li{attribute}>{words(shown)}" for _ in range(rnd.randint(1, 4))) + "</ul>"
        if kind == "table":
            rows = rnd.randint(1, 3), rnd.randint(1, 3)
            return "<table>" + "".join("<tr>" + "".join(f"<td{attribute}>{words(shown)}" for _ in range(rows[1])) for _ in range(rows[0])) + "</table>"
        if kind == "hide":
            return rnd.choice([f"<div hidden>{inner(False)}</div>", f"<div style='display:none'>{inner(False)}</div>"])
        if kind == "show":
            return f"<div style='visibility:hidden'>{words(False)}<div style='visibility:visible'>{inner()}</div>{words(False)}</div>"
        return "<!--" + words(False) + "-->" + "<!-->" + "<script>'<p>'</script>"

    return "<!doctype html><html><head><title>t</title><style>p {}</style>" + "".join(part(0, True) for _ in range(rnd.randint(1, 5)))


def test_generated_pages_show_all_visible_words_and_no_others():
    for seed in range(400):
        rnd, seen = random.Random(seed), []
        text = htmltext.visible_text(page(rnd, seen))
        assert [w for w in text.split() if w != "-"] == seen or sorted(w for w in text.split() if w != "-") == sorted(seen), seed


def test_generated_tables_keep_their_columns():
    """Against a grid that is laid out here by plain rules."""
    for seed in range(200):
        rnd = random.Random(seed)
        grid = [["".join(rnd.choices("ab\u4e2d\u00e9", k=rnd.randint(1, 12))) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 5))]
        wide = lambda t: sum(2 if c == "\u4e2d" else 1 for c in t)
        width = [max([wide(r[c]) for r in grid if len(r) > c], default=0) for c in range(4)]
        want = []
        for r in grid:
            line, at = "", 0
            for c, cell in enumerate(r):
                place = sum(width[:c]) + 2 * c
                line, at = line + " " * (place - at) + cell, place + wide(cell)
            want.append(line)
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in grid) + "</table>"
        assert htmltext.visible_text(html).split("\n") == want, seed


def test_html_never_recurses_or_fails():
    assert htmltext.visible_text("<div>" * 30_000 + "deep") == "deep" and htmltext.visible_text(None) is None
    rnd = random.Random(1)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<!--", "-->", "<", ">", "x", " ", "&amp;", "<script>", "</script>", "\"", "<td colspan=9 rowspan=3>", "<ol start=-2>"]
    for _ in range(500):
        htmltext.visible_text("".join(rnd.choices(parts, k=40)))


def test_html_query_rows(spark):
    rows = spark.createDataFrame([(1, "<p>a"), (2, None), (None, ""), (1, "<p>a")], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(rows).collect()), key=str)
    assert got == sorted([(1, "a", 1), (2, None, 0), (None, "", 0), (1, "a", 1)], key=str)
    assert htmltext.extract(rows.where("false")).count() == 0


# the registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), duck(small), queries.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_covers_its_table(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    key, source = ("page_id", "pages") if "page_id" in df.columns else ("doc_id", "documents")
    assert df.select(key).distinct().count() == spark.read.parquet(f"{small}/{source}.parquet").count()


def test_sharding_query_equals_plain_python(spark, small):
    """Each shard by the law of highest random weight, from Spark's hashes alone; sizes, checksums and slots recomputed."""
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    hashed = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.array(*[F.xxhash64(F.lit(f"shard:{j}"), F.col("doc_id").cast("string")) for j in range(9)]).alias("h")).collect()}
    score = {k: [-1 / np.log(((x & (2**64 - 1)) >> 11) / 2**53 + 0.5 / 2**53) for x in h] for k, h in hashed.items()}
    got = table_of(queries.QUERIES["op5_rendezvous_sharding"](spark, small))
    assert got.keys() == rows.keys()
    for k, r in got.items():
        raw = rows[k].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (int(np.argmax(score[k][:8])), int(np.argmax(score[k])))
    for s in range(8):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))


def test_packing_query_equals_the_tokenizer(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    got, bins, pieces = queries.QUERIES["op9_dominance_packing"](spark, small).collect(), {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    total = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert sorted(pieces[r["doc_id"]]) == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert len(bins) <= 1.02 * -(-total // 4096) + 1


def test_queries_equal_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {k: tuple(r)[1:] for k, r in table_of(queries.QUERIES["op2_suffix_dedup"](spark, small)).items()}
    assert got == brute.removed(rows)
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in table_of(queries.QUERIES["op7_minmax_near_duplicates"](spark, small)).items()}
    assert got == brute.near(rows, 2)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {k: r["item_ids"] for k, r in table_of(queries.QUERIES["op8_spaced_seed_decontamination"](spark, small)).items()}
    assert got == brute.leaks(rows, items)
    for k, r in table_of(queries.QUERIES["op3_crf_line_quality"](spark, small)).items():
        want = brute.stats(dict(rows)[k])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])



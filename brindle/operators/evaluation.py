"""Measures of ranked lists, matrices by category and path, weight search, question generation, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle import config
from brindle.functions import text as T

SINGLES = ("vector", "fulltext", "graph")
#: The questions' wording by category, and the verdicts.
QUESTIONS = {"A": ("", " 是什么？"), "B": ("我想了解 ", " 相关的内容"), "C": ("", " 出现在哪些地方？"), "D": ("", " 下都讲了什么？")}
CUTS = 64
WORSE, BETTER, SAME = "回退", "提升", "持平"


def recall(ranked: Column, answers: Column, k: int) -> Column:
    """The share of distinct answers among the first k; 0 without answers."""
    n = F.size(F.array_distinct(answers))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), answers)) / n).otherwise(F.lit(0.0))


def reciprocal_rank(ranked: Column, answers: Column) -> Column:
    """One over the place of the first answer; 0 without one."""
    first = F.array_position(F.transform(ranked, lambda c: F.array_contains(answers, c)), True)
    return F.when(first > 0, F.lit(1.0) / first).otherwise(F.lit(0.0))


def ranked_lists(hits: DataFrame, row: Column) -> DataFrame:
    """(query_id, row, ranked): the chunk ids of each list by rank."""
    return hits.groupBy("query_id", row.alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("ranked"))


def measures(questions: DataFrame, lists: DataFrame, rows: list[str], ks: list[int]) -> DataFrame:
    """(query_id, category, row, recall@k ..., mrr) for each question and row, lists that are missing being empty."""
    named = F.explode(F.array(*[F.lit(r) for r in rows])).alias("row")
    all_rows = questions.select("query_id", "category", "answers", named).join(lists, ["query_id", "row"], "left")
    ranked = F.coalesce("ranked", F.array().cast("array<string>"))
    cols = [F.coalesce(recall(ranked, F.col("answers"), k), F.lit(0.0)).alias(f"recall@{k}") for k in ks]
    return all_rows.select("query_id", "category", "row", *cols, reciprocal_rank(ranked, F.col("answers")).alias("mrr"))


def matrix(measured: DataFrame, ks: list[int]) -> DataFrame:
    """Means by category and row: (category, row, metric, value). There is no mean over categories, by design."""
    names = [*[f"recall@{k}" for k in ks], "mrr"]
    means = measured.groupBy("category", "row").agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{n}`") for n in names]))).alias("metric", "value")
    return means.select("category", "row", pairs)


def evaluate(questions: DataFrame, hits: DataFrame, fused: DataFrame, ks: list[int]) -> DataFrame:
    """The matrix of the single paths and the fused list."""
    lists = ranked_lists(hits, F.col("path")).unionByName(ranked_lists(fused, F.lit("fused")))
    return matrix(measures(questions, lists, [*SINGLES, "fused"], ks), ks)


def render(of: DataFrame) -> DataFrame:
    """A line of Markdown for each category and row, three decimals."""
    wide = of.groupBy("category", "row").agg(F.array_sort(F.collect_list(F.struct("metric", F.format_number("value", 3).alias("v")))).alias("m"))
    return wide.select("category", "row", F.concat(F.lit("| "), F.concat_ws(" | ", "category", "row", F.transform("m", lambda s: s["v"])), F.lit(" |")).alias("line"))


def pivot(of: DataFrame) -> str:
    """The matrix as one Markdown table, a column a metric, three decimals; missing values are dashes."""
    metrics = sorted(r["metric"] for r in of.select("metric").distinct().collect())  # a few names
    wide = of.groupBy("category", "row").pivot("metric", metrics).agg(F.format_number(F.first("value"), 3)).orderBy("category", "row")
    rows = ["| " + " | ".join([r["category"], r["row"], *(r[m] or "-" for m in metrics)]) + " |" for r in wide.collect()]  # a row a category and list
    return "\n".join(["| " + " | ".join(["category", "row", *metrics]) + " |", "|" + "---|" * (2 + len(metrics)), *rows])


def discrimination(of: DataFrame, metric: str = "recall@5") -> DataFrame:
    """(category, spread, warns): categories in which the single paths hardly differ. Less than two paths: no row."""
    singles = of.where((F.col("metric") == metric) & F.col("row").isin(*SINGLES))
    spread = singles.groupBy("category").agg((F.max("value") - F.min("value")).alias("spread"), F.count("*").alias("n")).where("n >= 2")
    return spread.select("category", "spread", (F.col("spread") < config.DISCRIMINATION_GAP).alias("warns"))


def gains(of: DataFrame, metric: str = "recall@5") -> DataFrame:
    """(category, fused, best, gain, verdict): fusion against the best single path."""
    value = lambda c: F.max(F.when(c, F.col("value")))
    rows = of.where(F.col("metric") == metric).groupBy("category").agg(value(F.col("row") == "fused").alias("fused"), value(F.col("row").isin(*SINGLES)).alias("best"))
    gain = F.col("fused") - F.col("best")
    verdict = F.when(gain < 0, WORSE).when(gain > 0, BETTER).otherwise(SAME)
    return rows.where("fused is not null and best is not null").select("category", "fused", "best", gain.alias("gain"), verdict.alias("verdict"))


def accepted(gain: DataFrame, must: tuple[str, ...] = ("C", "D")) -> DataFrame:
    """One row: whether the categories in ``must`` are there and improve, and none falls back."""
    there = [F.coalesce(F.bool_and(F.when(F.col("category") == c, F.col("gain") > 0)), F.lit(False)) for c in must]
    ok = F.coalesce(F.bool_and(F.col("gain") >= 0), F.lit(False))
    for t in there:
        ok = ok & t
    return gain.agg(ok.alias("accepted"), F.count("*").alias("n_categories"))


def weight_grid(spark, step: float = 0.05) -> DataFrame:
    """(combo, vector, fulltext, graph): all weights on a grid that add up to 1."""
    n = round(1 / step)
    pairs = spark.range(n + 1).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n) - F.col("id").cast("int"))).alias("f"))
    clean = lambda c: F.round(c * step, 10)
    return pairs.select((F.col("v") * (n + 1) + F.col("f")).cast("int").alias("combo"), clean(F.col("v")).alias("vector"), clean(F.col("f")).alias("fulltext"), clean(n - F.col("v") - F.col("f")).alias("graph"))


def score_grid(questions: DataFrame, hits: DataFrame, grid: DataFrame, k: int = config.RRF_K, cut: int = 5) -> DataFrame:
    """(combo, weights, recall, mrr): mean measures of each combination, all fused from the same hits in one job. The hits of a
    question are one row, every combination fuses it in place, so nothing but means is shuffled."""
    ranks = hits.groupBy("query_id", "chunk_id").agg(*[F.max(F.when(F.col("path") == p, F.col("rank"))).alias(p) for p in config.PATHS])
    packed = ranks.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", *config.PATHS)).alias("chunks"))
    asked = questions.select("query_id", "answers").join(packed, "query_id", "left")
    weights = [F.struct("combo", "fulltext", "graph", "vector")]
    combos = grid.agg(F.collect_list(*weights).alias("combos"))  # a fixed number of combinations
    rows = asked.join(F.broadcast(combos)).select("query_id", "answers", "chunks", F.explode("combos").alias("w"))

    def part(w: Column, c: Column, p: str) -> Column:
        return F.when((w[p] > 0) & c[p].isNotNull(), w[p] / (F.lit(k) + c[p])).otherwise(F.lit(0.0))

    def live(w: Column, c: Column) -> Column:
        return F.exists(F.array(*[(w[p] > 0) & c[p].isNotNull() for p in config.PATHS]), lambda x: x)

    scored = F.transform(F.filter(F.coalesce("chunks", F.array()), lambda c: live(F.col("w"), c)), lambda c: F.struct((-(F.lit(0.0) + part(F.col("w"), c, "fulltext") + part(F.col("w"), c, "graph") + part(F.col("w"), c, "vector"))).alias("s"), c["chunk_id"].alias("chunk_id")))
    ranked = rows.withColumn("ranked", F.transform(F.array_sort(scored), lambda s: s["chunk_id"]))
    top = F.slice("ranked", 1, cut)
    each = ranked.select("w", recall(F.col("ranked"), F.col("answers"), cut).alias("r"), reciprocal_rank(top, F.col("answers")).alias("m"))
    means = each.groupBy("w.combo", "w.fulltext", "w.graph", "w.vector").agg(F.avg("r").alias("recall"), F.avg("m").alias("mrr"))
    return means


def rank_grid(scored: DataFrame, least: float = 0.0) -> DataFrame:
    """Combinations by recall, then by their weights, with every weight at least ``least``."""
    rows = scored.where((F.col("fulltext") >= least) & (F.col("graph") >= least) & (F.col("vector") >= least))
    return rows.orderBy(F.desc("recall"), "fulltext", "graph", "vector")


def best_combination(scored: DataFrame, least: float = 0.05) -> DataFrame:
    """The one best combination that uses all paths with a weight of ``least`` or more; the best of all where none does."""
    all_paths = (F.col("fulltext") >= least) & (F.col("graph") >= least) & (F.col("vector") >= least)
    return scored.orderBy(F.when(all_paths, 0).otherwise(1), F.desc("recall"), "fulltext", "graph", "vector").limit(1)


def percentile(rows: DataFrame, group: list[str], value: str, percents: list[float]) -> DataFrame:
    """Nearest-rank percentiles whose place is rounded half to even.

    A group may hold most rows, so it isn't sorted as a whole: equal values are counted, CUTS approximate quantiles part each group
    into ranges, the counts of the ranges tell which of them hold the places that are asked for, and only those ranges are sorted."""
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_g")
    kept = rows.where(F.col(value).isNotNull()).select(key, *group, F.col(value).alias("_v"))
    counted = kept.groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    cuts = kept.groupBy("_g").agg(F.percentile_approx("_v", [k / CUTS for k in range(1, CUTS)], F.lit(100 * CUTS)).alias("_cuts"), F.count("*").alias("n"), *[F.first(g).alias(g) for g in group])
    ranged = counted.join(cuts.select("_g", "_cuts"), "_g").select("_g", "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_g", "_range").agg(F.sum("_c").alias("_m")).withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    place = lambda p: F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0).cast("long")
    places = cuts.select("_g", F.explode(F.array(*[F.struct(F.lit(f"p{p:g}").alias("name"), place(p).alias("at")) for p in percents])).alias("p")).select("_g", "p.name", "p.at")
    asked = sums.join(places, "_g").where((F.col("at") >= F.col("_first")) & (F.col("at") < F.col("_first") + F.col("_m")))
    held = asked.select("_g", "_range", "_first").distinct()
    upto = F.sum("_c").over(Window.partitionBy("_g", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = ranged.join(held, ["_g", "_range"]).select("_g", "_range", "_v", (F.col("_first") + upto).alias("_hi"), (F.col("_first") + upto - F.col("_c")).alias("_lo"))
    found = asked.select("_g", "_range", "name", "at").join(inside, ["_g", "_range"]).where((F.col("at") >= F.col("_lo")) & (F.col("at") < F.col("_hi")))
    picked = found.groupBy("_g").agg(*[F.max(F.when(F.col("name") == f"p{p:g}", F.col("_v"))).alias(f"p{p:g}") for p in percents])
    return cuts.drop("_cuts").join(picked, "_g").select(*group, *[f"p{p:g}" for p in percents], "n")


def load_summary(requests: DataFrame, group: list[str], wall: str = "wall_s") -> DataFrame:
    """(group, n, errors, p50, p95, p99, qps) of ``requests`` (group, latency, ok): percentiles of those that went well; qps is all requests
    over the run's wall time."""
    sizes = requests.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), (F.count("*") / F.max(wall)).alias("qps"))
    well = percentile(requests.where("ok"), group, "latency", [50, 95, 99]).drop("n")
    return sizes.join(well, group, "left")


def rerank_comparison(base: DataFrame, reranked: DataFrame) -> DataFrame:
    """(category, pooled, metric means of both) by category and over all questions, from two tables of measures."""
    names = [c for c in base.columns if c.startswith("recall@") or c == "mrr"]
    both = base.select("query_id", "category", *[F.col(f"`{n}`").alias(f"base_{n}") for n in names]).join(reranked.select("query_id", *[F.col(f"`{n}`").alias(f"rerank_{n}") for n in names]), "query_id")
    means = [F.avg(F.col(f"`{side}_{n}`")).alias(f"{side}_{n}") for n in names for side in ("base", "rerank")]
    return both.groupingSets([[F.col("category")], []], F.col("category")).agg(F.grouping("category").cast("boolean").alias("pooled"), *means, F.count("*").alias("n"))


def six_rows(questions: DataFrame, hits: DataFrame, fused: dict[str, DataFrame], ks: list[int]) -> DataFrame:
    """Measures of the three paths and of three fusions (equal, static, routed), lists cut at the largest k."""
    most = max(ks)
    lists = ranked_lists(hits.where(F.col("rank") <= most), F.col("path"))
    for name, df in fused.items():
        lists = lists.unionByName(ranked_lists(df.where(F.col("rank") <= most), F.lit(name)))
    rows = [*SINGLES, *fused]
    measured = measures(questions.where("category <> 'unanswerable'"), lists, rows, ks)
    names = [*[f"recall@{k}" for k in ks], "mrr"]
    return measured.groupBy("row").agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names], F.count("*").alias("n"))


def criterion(table: DataFrame, fused: str, metric: str = "recall@5") -> DataFrame:
    """One row: the best single path (the first of SINGLES on a tie) and whether the fused row reaches it."""
    order = F.create_map(*[x for k, r in enumerate(SINGLES) for x in (F.lit(r), F.lit(-k))])
    value = F.col(f"`{metric}`")
    single = F.col("row").isin(*SINGLES)
    best = F.max(F.when(single, F.struct(value.alias("v"), F.try_element_at(order, F.col("row")).alias("o"), F.col("row").alias("r"))))
    mine = F.max(F.when(F.col("row") == fused, value))
    return table.agg(best["r"].alias("best_row"), best["v"].alias("best"), mine.alias("fused"), (mine >= best["v"]).alias("met"))


def generate_questions(chunks: DataFrame, graph, aliases: DataFrame, neighbour: DataFrame, per_category: int) -> DataFrame:
    """(category, question, answers): A by leaf heading, B by a synonym of it, C by entities with many chunks and their
    neighbours, D by everything under a heading path; so many of each."""
    headed = chunks.where(F.size("heading_path") > 0).withColumn("leaf", F.try_element_at("heading_path", F.lit(-1)))
    one = F.array("chunk_id").alias("answers")
    ask = lambda c, x: F.concat(F.lit(QUESTIONS[c][0]), x, F.lit(QUESTIONS[c][1])).alias("question")
    a = headed.orderBy("chunk_id").limit(per_category).select(F.lit("A").alias("category"), ask("A", F.col("leaf")), one)
    new, changed = T.synonym(F.col("leaf"))
    b = headed.where(changed).orderBy("chunk_id").limit(per_category).select(F.lit("B").alias("category"), ask("B", new), one)
    canonical = aliases.where("alias = canonical").select(F.col("canonical").alias("entity"))
    many = graph.postings.join(canonical, "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= config.MIN_CHUNKS_C)
    many = many.orderBy("entity").limit(per_category).select("entity")
    around = many.join(neighbour, "entity").select("entity", F.col("neighbour").alias("of")).unionByName(many.select("entity", F.col("entity").alias("of"))).distinct()
    wide = around.join(graph.postings.select(F.col("entity").alias("of"), "chunk_id"), "of").groupBy("entity").agg(F.array_sort(F.collect_set("chunk_id")).alias("answers"))
    c = wide.select(F.lit("C").alias("category"), ask("C", F.col("entity")), "answers")
    size = F.size("heading_path")
    above = headed.where(size > 1).select(F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.slice("heading_path", F.lit(1), i))).alias("prefix")).distinct()
    above = above.orderBy("prefix").limit(per_category)
    under = headed.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.slice("heading_path", F.lit(1), i))).alias("prefix"))
    d = above.join(under, "prefix").groupBy("prefix").agg(F.array_sort(F.collect_set("chunk_id")).alias("answers"))
    d = d.select(F.lit("D").alias("category"), ask("D", F.try_element_at("prefix", F.lit(-1))), "answers")
    return a.unionByName(b).unionByName(c).unionByName(d).orderBy("category", "question")


def qaset_contract(dev: DataFrame, test: DataFrame, least: int = 15, unanswerable: int = 3) -> DataFrame:
    """(dataset, n, n_unanswerable, n_shared, ok) of two label sets that must be large enough and share no question."""
    shared = dev.select("question").intersect(test.select("question")).agg(F.count("*").alias("n_shared"))
    both = dev.select(F.lit("dev").alias("dataset"), "category").unionByName(test.select(F.lit("test").alias("dataset"), "category"))
    sizes = both.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "unanswerable").alias("n_unanswerable"))
    return sizes.join(F.broadcast(shared)).select("*", ((F.col("n") >= least) & (F.col("n_unanswerable") >= unanswerable) & (F.col("n_shared") == 0)).alias("ok"))


def ingest_statistics(chunks: DataFrame) -> DataFrame:
    """(measure, key, n): chunks by kind, codes, table parts, rows, and images that brought text or a description."""
    count = lambda df, measure, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "key", "n")
    tables = chunks.where("kind = 'table'")
    images = chunks.where("kind = 'image'")
    whole = F.when(T.rows_whole(F.regexp_replace("text", "^[^|][^\n]*\n", "")), "whole").otherwise("broken")
    return (
        count(chunks, "kind", F.col("kind")).unionByName(count(chunks.select(F.explode("degrade").alias("c")), "degrade", F.col("c")))
        .unionByName(count(tables, "table_part", F.when(F.col("part") > 0, "later").otherwise("first"))).unionByName(count(tables, "table_rows", whole))
        .unionByName(count(images, "image", F.when(F.col("text").contains("文字: "), "ocr").when(F.col("text").contains("内容: "), "vision").otherwise("placeholder")))
    )


def report(of: DataFrame, metric: str = "recall@5") -> str:
    """The acceptance report as Markdown, from a matrix of a few rows."""
    table = gains(of, metric).orderBy("category").collect()
    verdict = accepted(gains(of, metric)).first()
    warned = {r["category"] for r in discrimination(of, metric).where("warns").collect()}
    rows = [f"| {r['category']} | {r['fused']:.3f} | {r['best']:.3f} | {r['gain']:+.3f} | {r['verdict']}{' (paths hardly differ)' if r['category'] in warned else ''} |" for r in table]
    head = f"| category | fused {metric} | best single | gain | verdict |\n|---|---|---|---|---|"
    return "\n".join(["# Acceptance", "", head, *rows, "", f"Accepted: {'yes' if verdict['accepted'] else 'no'}", ""])


def ingest_report(chunks: DataFrame) -> str:
    """What came of an ingestion, as Markdown: the counts of :func:`ingest_statistics`, tables over the cap, and whether all rows are whole."""
    counts = {(r["measure"], r["key"]): r["n"] for r in ingest_statistics(chunks).collect()}  # a row a kind, code or state
    size = chunks.where("kind = 'table'").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("longest"), F.count_if(F.length("text") > config.MAX_CHARS).alias("over")).first()
    lines = [f"| {m} | {k} | {n} |" for (m, k), n in sorted(counts.items())]
    broken = counts.get(("table_rows", "broken"), 0)
    return "\n".join(
        ["# Ingestion", "", "| measure | key | chunks |", "|---|---|---|", *lines, "", f"Longest table chunk: {size['longest']} of {config.MAX_CHARS}; over the cap: {size['over']}.",
         f"Table rows: {'all whole' if not broken else f'{broken} chunks with broken rows'}.", ""]
    )

"""The operators of this package as named queries over the tables, and their SQL where there is one."""

from __future__ import annotations

from brindle.llm.common import read


def op1_ordinal_quality(spark, sf_dir):
    from brindle.llm.ordinal import grade_documents, train

    docs = read(spark, sf_dir, "documents")
    return grade_documents(docs, train(spark, docs, read(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark, sf_dir):
    from brindle.llm.suffix import removed_bytes

    return removed_bytes(spark, read(spark, sf_dir, "documents"))


def op3_crf_line_quality(spark, sf_dir):
    from brindle.llm.lines import label_quality, train

    docs = read(spark, sf_dir, "documents")
    return label_quality(docs, *train(docs, read(spark, sf_dir, "labels")))


def op4_warc_chunk_table(spark, sf_dir):
    from brindle.llm.warc import archive_round_trip

    return archive_round_trip(spark, read(spark, sf_dir, "pages"))


def op5_rendezvous_sharding(spark, sf_dir):
    from brindle.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"))


def op6_pseudo_likelihood(spark, sf_dir):
    from brindle.llm.lmscore import pseudo_likelihood

    return pseudo_likelihood(read(spark, sf_dir, "documents"))


def op7_minmax_near_duplicates(spark, sf_dir):
    from brindle.llm.minmax import near_duplicates

    return near_duplicates(spark, read(spark, sf_dir, "documents"), k=2, percent=80)


def op8_spaced_seed_decontamination(spark, sf_dir):
    from brindle.llm.decontaminate import contamination

    return contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_dominance_packing(spark, sf_dir):
    import public_tokenizers
    from brindle.llm.packing import pack

    return pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_layout_html_text(spark, sf_dir):
    from brindle.llm.htmltext import extract

    return extract(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_suffix_dedup, op3_crf_line_quality, op4_warc_chunk_table, op5_rendezvous_sharding, op6_pseudo_likelihood, op7_minmax_near_duplicates, op8_spaced_seed_decontamination, op9_dominance_packing, op10_layout_html_text)}
ORACLES: dict[str, str] = {
    "op4_warc_chunk_table": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (d)
""",
}

"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with all their columns; the last returns the placed
token pieces. ``run`` writes each stage's result to the shared folder and reads it again for the next; what a stage wrote meanwhile is removed.

1. ``quality``: an ordinal model, trained on the labelled documents, rejects toxic and poor documents.
2. ``near_duplicates``: one document of each group of similar 5-word shingle sets (J >= 0.8) stays.
3. ``repeated_strings``: 100-byte strings that also start earlier are cut out of the texts.
4. ``decontamination``: documents that hold a benchmark passage go.
5. ``packing``: the remaining texts are tokenized and packed into sequences of 4096 tokens.

Defined cases, stage by stage. Null and empty texts: rejected by 1, as they have no words (if they come to a later stage, 2 to 4 keep them
as they are and 5 gives them one token). Very long texts are processed whole in all stages. Ties: equal scores are judged alike by 1;
of equal documents 2 and 3 take the smallest doc_id as the first (null before all), and of several texts of one doc_id the first by a
hash. Repeated rows (same doc_id and text) are one document to 2 and 3, which keep or change all of them alike, are judged alike by 1
and 4, and are packed each by 5. Rows of one doc_id with other texts are documents of their own. Empty tables give empty results. Columns of any other names are kept by 1 to 4 as they are; 3 sets n_chars anew.
"""

from __future__ import annotations

from brindle.llm import decontaminate, minmax, ordinal, packing, suffix
from brindle.llm.common import read
from brindle.storage import drop, kept, table, temporary

TOKENIZER = "word_bpe_49k.json"


def quality(spark, docs, sf_dir):
    return ordinal.keep_good(docs, ordinal.train(spark, docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    return minmax.keep_first(spark, docs, k=5, percent=80)


def repeated_strings(spark, docs, sf_dir):
    return suffix.cut_documents(spark, docs)


def decontamination(spark, docs, sf_dir):
    return decontaminate.clean_documents(spark, docs, read(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: No stage but the last could be written in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            done = kept(table(spark, stage(spark, docs, sf_dir), name))
        drop(spark, docs)  # the last stage's table; the input stays
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

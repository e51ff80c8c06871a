"""Rendezvous (highest random weight) sharding of stable keys over weighted shards, in DataFrame functions only.

Every key scores every shard with ``-weight / ln(u)``, u being a hash of (key, shard) in (0, 1), and goes to the
highest score. A further shard only adds one score, so the keys that move all move into it: a share of
``weight / total``. No state, no shuffle: the shard is a projection of the row.

Defined cases: a null key is a key of its own; repeated rows go to one shard and take separate slots; a null
text counts as no bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import gapless


def rendezvous(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """The shard (int) of ``key``; a shard of weight 0 gets nothing. The lower shard wins a tie."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative and one must be positive")
    named = F.coalesce(key.cast("string"), F.lit("\x00"))

    def score(j: int) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(F.lit(f"{salt}:{j}"), named), 11)  # 53 bits
        u = (h.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((F.lit(-float(weights[j])) / F.ln(u)).alias("s"), F.lit(-j).alias("j"))

    live = [score(j) for j, w in enumerate(weights) if w > 0]
    best = live[0] if len(live) == 1 else F.greatest(*live)
    return (-best["j"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the shard of each row, its place in the shard and
    its shard once there is one more (of weight 1)."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(docs["doc_id"], weights).alias("shard"),
        rendezvous(docs["doc_id"], [*weights, 1.0]).alias("grown_shard"),
    )
    ranked = gapless(rows, ["shard"], ["doc_id", "text_crc32", "size"], docs.count(), out="slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

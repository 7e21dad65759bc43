"""Contiguous shards of near equal bytes.

Rows are put in the order of their key. A row's place is the sum of the sizes before it: a prefix sum inside its range
partition plus the totals of the partitions before. The whole is cut at equal targets, and a row goes to the side of
a cut on which its middle lies, so a shard misses its target by half a row's size at each end at most. Only keys,
sizes and checksums are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text
from .ordering import BEFORE, POS, placed

SHARDS = 8


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = SHARDS) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text and one more. law is `bytes`; grown_shard belongs to another law and is null. slot
    counts the rows of a shard from 0 without gaps, in the order of keys. Null texts are empty. Null keys come
    first; rows that repeat a key are in the order of their texts' hashes, and rows equal in both are
    interchangeable. One law holds, so equal texts don't attract each other: each goes where its key stands. With
    fewer rows than shards some shards are empty; an empty table gives no rows. Other columns are ignored.
    """
    told = whole_text(text)
    rows = cut(docs.select(F.col(key).alias("__key"), (F.octet_length(told) + 1).cast("long").alias("__size"), F.crc32(told).alias("__crc"), F.xxhash64(told).alias("__hash")))
    total = rows.agg(F.coalesce(F.sum("__size"), F.lit(1)).cast("long")).first()[0]
    # all whole numbers: twice the middle of a row, times the shards, over twice the total
    at = F.expr(f"CAST(({BEFORE} * 2 + __size) * {count} div {2 * total} AS INT)")
    dealt = cut(placed(rows, [F.col("__key").asc_nulls_first(), F.col("__hash")], size="__size").withColumn("shard", at))
    first = dealt.groupBy("shard").agg(F.min(POS).alias("__first"))  # a row per shard
    return dealt.join(F.broadcast(first), "shard").select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col(POS) - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

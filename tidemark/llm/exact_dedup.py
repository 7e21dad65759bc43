"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition makes one run: a row per digest with its count and the row that stays. Runs
then meet in rounds. In round r the nodes that differ only in digit r of their number (base `radix`)
exchange their runs so that a node ends with the digests whose own digit r equals the node's, and a
sort-merging aggregate folds the runs that arrive. The sort aggregate is the merge: its map side sorts each
task's rows by node and digest and folds equal ones, which makes the run that is sent, and its reduce side
merges the runs in that order. After the last round each digest lives on one node and nothing ever passes
through a single task. A digest held by a third of all rows costs each node
at most `radix` rows a round. Digests are verified at every level: rows merge only if a second,
independent hash and the length of the normalised text agree too.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

WHITE = " \t\n\u000b\u000c\r"
KEY = ["__digest", "__check", "__length"]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, length in code points and digest of each row's normalised text, with the run it belongs to."""
    bare = F.translate(whole_text(text), WHITE, "")
    return docs.select(
        F.col(key).alias("__id"),
        F.length(whole_text(text)).cast("long").alias("__chars"),
        F.unhex(F.sha2(bare, 256)).alias("__digest"),
        F.xxhash64(bare).alias("__check"),
        F.length(bare).alias("__length"),
        F.spark_partition_id().alias("__run"),
    )


def merge_runs(rows: DataFrame, radix: int = 16) -> DataFrame:
    """One row per digest: `__keep`, the row with most code points and then the least key, and `__size`."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(2, math.ceil(math.log(max(parts, 2), radix)))
    nodes = radix**rounds
    slot = F.pmod(F.col("__check"), F.lit(nodes))
    runs = rows.select(
        *KEY,
        F.pmod(F.col("__run"), F.lit(nodes)).cast("long").alias("__node"),
        F.struct((-F.col("__chars")).alias("less"), F.col("__id").isNull().alias("null"), F.col("__id").alias("id")).alias("__best"),
        F.lit(1).cast("long").alias("__count"),
    )
    for r in range(rounds):
        unit = radix**r
        mine, wanted = F.floor(F.col("__node") / unit) % radix, F.floor(slot / unit) % radix
        runs = (
            runs.withColumn("__node", (F.col("__node") + (wanted - mine) * unit).cast("long"))
            .groupBy("__node", *KEY)
            .agg(F.min("__best").alias("__best"), F.sum("__count").alias("__count"))
        )
    return runs.select(*KEY, F.col("__best.id").alias("__keep"), F.col("__count").alias("__size"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radix: int = 16) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting tab, newline, vertical tab, form feed, carriage
    return and space. Null texts are empty; empty texts are equal to each other. A null key sorts
    last. Rows that repeat a key are counted one by one and, where that key is the one that stays,
    all of them are `kept` (see `drop_duplicates` for one row each). Other columns are ignored.
    """
    rows = cut(digests(docs, key, text))
    groups = merge_runs(rows, radix)
    return rows.join(groups, KEY).select(
        F.col("__id").alias(key),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat a key and a text, one."""
    every = cut(exact_duplicates(docs, key, text).select(F.col(key).alias("__kept_id"), "text_sha256", "kept"))
    found = every.where("kept").select("__kept_id", "text_sha256")
    match = F.col(key).eqNullSafe(F.col("__kept_id"))
    again = every.groupBy("__kept_id").count().where("count > 1").select("__kept_id")
    if again.isEmpty():
        return docs.join(found.select("__kept_id"), match, "left_semi")
    # keys of several rows are told apart by their texts too; of a key's equal texts the longest stays
    twice = docs.join(again, match, "left_semi").withColumn("__sha", F.sha2(F.translate(whole_text(text), WHITE, ""), 256))
    held = twice.join(found.distinct(), match & (F.col("__sha") == F.col("text_sha256")), "left_semi")
    one = held.groupBy(key, "__sha").agg(F.max_by(F.struct(*docs.columns), F.struct(F.length(whole_text(text)), whole_text(text))).alias("__row")).select("__row.*")
    other = again.withColumnRenamed("__kept_id", "__again")
    once = found.join(other, F.col("__kept_id").eqNullSafe(F.col("__again")), "left_anti")
    return docs.join(once, match, "left_semi").unionByName(one.select(docs.columns))

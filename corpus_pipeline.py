"""The corpus pipeline: toxicity, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Near-duplicate
sampling, the learned stages and packing have no SQL form, so ORACLE_SQL is None and tests/llm holds the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.common import cut, fold, table
from tidemark.llm.exact_dedup import drop_duplicates
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import best_fit
from tidemark.llm.secrets import redact
from tidemark.llm.toxicity import toxicity


ROW = "__stage_row"


def numbered(docs):
    """The rows with a number of their own, written once, so that a row is dropped by itself and not by its doc_id."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def drop_toxic(spark, docs, sf_dir):
    """Rows that score below one half. A row goes through the scoring whole, so each is kept or dropped by itself,
    null and repeated keys too, and nothing is joined or shuffled."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias(ROW))
    return toxicity(whole, labels, row=ROW).where("predicted = 0").select(f"{ROW}.*")


def drop_exact(spark, docs, sf_dir):
    """Of equal texts, the row with the longest original, then the least doc_id."""
    return drop_duplicates(docs)


def drop_near(spark, docs, sf_dir):
    """Of near duplicates, one row of the least doc_id, null last."""
    rows = numbered(docs)
    gone = near_duplicates(rows, row=ROW).where("NOT kept").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def mask_secrets(spark, docs, sf_dir):
    """Every document, its secrets replaced. Null texts stay null, texts without a secret stay as they are, and
    rows that repeat a key each stay."""
    return redact(docs)


def pack_documents(spark, docs, sf_dir):
    """The bins of the training sequences: a row per piece of a document. Null and empty texts have one piece
    without tokens, and rows that repeat a key are packed each for itself."""
    return best_fit(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("secret_scan", mask_secrets), ("packing", pack_documents)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks cut points, so an insertion moves the cuts near it and no
others. Chunk sizes are normalised: below `NORMAL` bytes a cut needs a stricter mask, above it a looser
one, never under `LEAST` or over `MOST`. A fingerprint is the sorted set of chunk digests, each with its
chunk's length; the likeness of A to B is the length of A's chunks that B has over the length of A's.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .tokens import mix, span_hashes

LEAST, NORMAL, MOST, STRICT, LOOSE = 16, 48, 192, 6, 4
#: Bytes of text for a task, and buckets of consecutive keys in it, so that chance evens out what tasks get.
TASK, SPREAD = 64_000_000, 8
NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_GEAR = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, start: int = 0) -> list[int]:
    """Chunk ends of data[start:], where start is itself a cut (or 0)."""
    low = max(0, start - 32)
    h = _GEAR[data[low:]]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            more = h.copy()
            more[s:] += h[:-s] << np.uint32(s)
            h = more
    # the high bits have seen all 32 bytes
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0]
    loose, strict = (loose + low + 1).tolist(), (strict + low + 1).tolist()
    out, at, end = [], start, len(data)
    i = j = 0
    while end - at > LEAST:
        i = bisect_left(strict, at + LEAST, i)
        if i < len(strict) and strict[i] < at + NORMAL:
            cut = strict[i]
        else:
            j = bisect_left(loose, at + NORMAL, j)
            cut = min(loose[j] if j < len(loose) else end, at + MOST)
        at = min(cut, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def chunk_set(data: np.ndarray, ends: list[int]) -> np.ndarray:
    """48 bits of each distinct chunk's digest and 16 of its length, sorted."""
    if not ends:
        return np.zeros(0, np.uint64)
    stops = np.array(ends, np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    return np.unique((span_hashes(data, starts, stops) & ~np.uint64(0xFFFF)) | (stops - starts).astype(np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's chunk length that b has; 1 if both are empty."""
    if not len(a):
        return float(not len(b))
    size = lambda x: int((x & np.uint64(0xFFFF)).sum())
    return size(np.intersect1d(a, b, assume_unique=True)) / size(a)


def name(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return name(chunk_set(data, cuts(data)))


def fingerprints_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many, or
    all, of the next document by ascending key; after the last comes the first. Null texts are empty. A
    null key comes first, rows of one key by their text. Keys are numbers. Other columns are ignored.

    Rows are dealt to buckets of consecutive keys and sorted there; each bucket also gets a copy of the
    first row of the bucket after it. So a text is shuffled once, whatever its neighbours are. There are tasks
    as Spark is set to shuffle, or more where these would get over `TASK` bytes each, and `SPREAD` buckets a task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text")).withColumn("__at", F.coalesce(F.col("__id").cast("double"), F.lit(float("-inf"))))
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TASK))
    parts = SPREAD * tasks
    bounds = rows.agg(F.percentile_approx("__at", [k / parts for k in range(1, parts)], 10 * parts).alias("q")).first().q or []
    splits = [float("-inf"), *sorted({b for b in bounds if b > float("-inf")}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="__at", outputCol="__bucket").transform(rows).drop("__at") if len(splits) > 2 else rows.withColumn("__bucket", F.lit(0.0)).drop("__at")
    order = F.struct(F.col("__id").isNotNull(), F.col("__id"), F.col("__text"))
    firsts = rows.groupBy("__bucket").agg(F.min(order).alias("o")).select("__bucket", F.col("o.__text").alias("__text"))
    held = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
    before = spark.createDataFrame(list(zip(held, [held[-1], *held[:-1]], strict=True)) if held else [], "__bucket double, before double")
    ahead = firsts.join(F.broadcast(before), "__bucket").select(F.lit(None).cast(rows.schema["__id"].dataType).alias("__id"), "__text", F.col("before").alias("__bucket"), F.lit(True).alias("__ahead"))
    dealt = rows.withColumn("__ahead", F.lit(False)).unionByName(ahead).repartition(tasks, "__bucket").sortWithinPartitions("__bucket", "__ahead", F.col("__id").asc_nulls_first(), "__text")
    kind = docs.schema[key].dataType.simpleString()

    def compare(batches):
        waiting = None
        for batch in batches:
            out = []
            for i, text, bucket, ahead in zip(*(batch.column(c).to_pylist() for c in ("__id", "__text", "__bucket", "__ahead")), strict=True):
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                ends = cuts(data)
                own = (i, text, data, ends, chunk_set(data, ends), bucket)
                if waiting is not None and waiting[5] == bucket:
                    out.append(_row(*waiting[:5], text, own[4]))
                waiting = None if ahead else own
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, (batch.schema.field("__id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)], [key, *NAMES])

    return dealt.mapInArrow(compare, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(i, text: str, data: np.ndarray, ends: list[int], own: np.ndarray, after: str, next_set: np.ndarray) -> tuple:
    quarter = len(text) // 4
    head = text[: len(text) - quarter]
    kept = len(head.encode("utf-8", "replace"))
    edited = np.frombuffer((head + after[:quarter]).encode("utf-8", "replace"), np.uint8)
    # cuts depend on what is before them only: those inside the kept part stay
    same = ends[: bisect_left(ends, min(kept, len(data) - 1) + 1)] if quarter else ends
    changed = chunk_set(edited, [*same, *cuts(edited, same[-1] if same else 0)]) if quarter else own
    return (i, len(text), hashlib.sha256(edited).hexdigest(), name(own), name(changed), likeness(own, changed), likeness(own, next_set))

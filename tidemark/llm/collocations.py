"""Phrases whose words stand together more often than apart, counted level by level.

A first pass counts words, and hashes every pair of neighbours into a bucket. In the second pass a pair is counted
by itself only if both its words are frequent and its bucket is, and triples made of such pairs are hashed into buckets in turn. The
third pass counts triples whose two pairs are frequent and whose bucket is. A bitmap only ever lets through
too much, never too little, and what passes is counted exactly over all texts, so the buckets save work and
change no result. Bitmaps have `BUCKETS` bits whatever the input is; only they are broadcast.

Tasks count inside Arrow batches, about `CHUNK` bytes of text of a language at a time, words as numbers of that chunk; Spark adds
the counts up.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_text

BUCKETS, CHUNK, LEAST, MOST, HELD, UNKNOWN = 1 << 24, 2 << 20, 10, 2000, 50, "und"
#: Breaks between pieces become a byte that UTF-8 never has, A-Z go to lower case, a tab is a blank.
BREAK = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)
COUNTS = "lang string, phrase string, bucket long, n long"
_OUT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])


class Words:
    """A chunk's words as numbers in order of their places; 0 stands for a break."""

    def __init__(self, lang: str, texts: list[bytes]):
        tokens = BREAK.join(texts).replace(BREAK, b" " + BREAK + b" ").split()
        number = defaultdict(count(1).__next__)
        number[BREAK] = 0
        self.lang, self.at = lang, np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        self.words = list(number)
        salt = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in self.words), np.uint64, len(self.words))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n words stand together, and their numbers, a row for each such place."""
        m = max(len(self.at) - n + 1, 0)
        at = np.stack([self.at[k : k + m] for k in range(n)], 1)
        where = np.flatnonzero((at > 0).all(1))
        return where, at[where]

    def bucket(self, grams: np.ndarray, buckets: int) -> np.ndarray:
        return mixed(self.hash[grams], buckets)

    def counted(self, grams: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Each distinct phrase among the places and how often it stands there."""
        if not len(grams):
            return [], np.zeros(0, np.int64)
        # numbers of phrases, made word by word: a phrase's number and the next word's number make one key
        ids = grams[:, 0]
        for k in range(1, grams.shape[1]):
            ids = np.unique(ids * len(self.words) + grams[:, k], return_inverse=True)[1]
        _, first, n = np.unique(ids, return_index=True, return_counts=True)
        return [b" ".join(self.words[w] for w in row).decode() for row in grams[first].tolist()], n


def mixed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each row of word hashes."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(hashes.shape[1]):
        out = (out ^ hashes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out % np.uint64(buckets)).astype(np.int64)


def has(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def pieces(text: bytes, chunk: int, words: int = 3) -> Iterator[tuple[bytes, bytes]]:
    """A folded text in parts of about a chunk, each with what it repeats of the part before: parts end at a break,
    or, where none is near, between words, and the next one then begins with the last words again."""
    start, repeat = 0, b""
    while len(text) - start > chunk:
        end = text.find(BREAK, start + chunk, start + 2 * chunk)
        if end >= 0:
            yield text[start:end], repeat
            start, repeat = end, b""
            continue
        end = text.find(b" ", start + chunk)
        if end < 0:
            break
        yield text[start:end], repeat
        repeat = b" ".join((repeat + text[start:end]).rsplit(BREAK, 1)[-1].split()[-(words - 1) :]) + b" "
        start = end
    yield text[start:], repeat


def chunks(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, list[bytes], bytes]]:
    """Language, texts and, for a part of a long text, what it repeats."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, lang in enumerate(langs):
            text = texts[i].as_py().translate(_FOLD)
            if len(text) > chunk:
                for part, repeat in pieces(text, chunk):
                    yield lang, [part], repeat
                continue
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size > chunk:
                for own, parts in held.items():
                    yield own, parts, b""
                held, size = {}, 0
    for own, parts in held.items():
        yield own, parts, b""


def rows(lang: str | None, phrases: list[str] | None, buckets: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts as Arrow batches of bounded length."""
    for a in range(0, len(n), 1 << 17):
        part = n[a : a + (1 << 17)]
        none = pa.nulls(len(part))
        yield pa.record_batch(
            [none.cast(pa.string()) if lang is None else pa.array([lang] * len(part), pa.string()), none.cast(pa.string()) if phrases is None else pa.array(phrases[a : a + len(part)], pa.string()),
             none.cast(pa.int64()) if buckets is None else pa.array(buckets[a : a + len(part)]), pa.array(part.astype(np.int64))], schema=_OUT,
        )


def counting(n: int, buckets: int, chunk: int, most: int, words=None, shorter=None, own=None):
    """A pass: phrases of n words that the bitmaps let through are counted, and phrases of n + 1 words (up to `most`)
    hashed into buckets. words: bitmap of frequent words; shorter: of the frequent phrases of n - 1 words;
    own: of the frequent buckets of phrases of n words. Each is a broadcast or None."""

    def passes(w: Words) -> tuple[np.ndarray, np.ndarray]:
        where, grams = w.grams(n)
        keep = np.ones(len(where), bool)
        if words is not None:
            frequent = has(words.value, w.bucket(np.arange(len(w.words))[:, None], buckets))
            keep &= frequent[grams].all(1)
        if shorter is not None:
            keep &= has(shorter.value, w.bucket(grams[:, 1:], buckets)) & has(shorter.value, w.bucket(grams[:, :-1], buckets))
        if own is not None:
            keep[keep] = has(own.value, w.bucket(grams[keep], buckets))
        return where[keep], grams[keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = np.zeros(buckets, np.int32) if n < most else None
        for lang, texts, repeat in chunks(batches, chunk):
            w = Words(lang, [repeat + texts[0], *texts[1:]])
            again = len(repeat.split())  # places of words that the part before has counted
            where, grams = passes(w)
            new = where + n > again
            phrases, times = w.counted(grams[new])
            yield from rows(lang, phrases, None, times)
            if hashed is not None:
                # a longer phrase can only be frequent if both its parts may be
                follows = np.flatnonzero(np.diff(where) == 1)
                longer = np.concatenate([grams[follows], grams[follows + 1][:, -1:]], 1)[where[follows] + n + 1 > again]
                b, times = np.unique(w.bucket(longer, buckets), return_counts=True)
                hashed[b] = np.minimum(hashed[b].astype(np.int64) + times, 1 << 30)
        if hashed is not None:
            for a in range(0, buckets, 1 << 20):
                found = a + np.flatnonzero(hashed[a : a + (1 << 20)])
                yield from rows(None, None, found, hashed[found])

    return run


def bitmap(frequent: DataFrame, buckets: int):
    """Bits of the `bucket`s of a table, as an array of bytes on all executors: buckets / 8 bytes, whatever the input is."""
    word = frequent.groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bucket % 64 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros((buckets + 63) // 64, "<i8")
    bits[word["word"].to_numpy()] = word["bits"].to_numpy()
    bits = bits.view(np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def bucketed(phrases: DataFrame, buckets: int) -> DataFrame:
    """The bucket of each phrase of a table, as the passes find it."""

    def run(batches):
        for batch in batches:
            langs, said = batch.column(0).to_pylist(), [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            if said:
                salts = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
                hashes = np.array([[xxhash.xxh3_64_intdigest(w, salts[x]) for w in p] for x, p in zip(langs, said, strict=True)], np.uint64)
                yield pa.record_batch([pa.array(mixed(hashes, buckets))], names=["bucket"])

    return phrases.select("lang", "phrase").mapInArrow(run, "bucket long")


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = 3, least: int = LEAST, buckets: int = BUCKETS, chunk: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """The phrases of 1, 2, ... words that occur `least` times in their language (lang, phrase, a), a table for each
    number of words, and the count of all words (lang, n)."""
    told = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text(text).cast("binary").alias("text"))
    levels, own, vocabulary, shorter, all_ = [], None, None, None, None
    for n in range(1, words + 1):
        found = told.mapInArrow(counting(n, buckets, chunk, words, vocabulary if n == 2 else None, shorter if n > 2 else None, own), COUNTS)
        summed = cut(found.groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n")))
        counts = summed.where("bucket IS NULL")
        if n == 1:
            all_ = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        levels.append(counts.where(F.col("n") >= least).select("lang", "phrase", F.col("n").alias("a")))
        if n < words:
            own = bitmap(summed.where(F.col("bucket").isNotNull() & (F.col("n") >= least)).select("bucket"), buckets)
            frequent = bitmap(bucketed(levels[-1], buckets), buckets)
            vocabulary, shorter = (frequent, None) if n == 1 else (None, frequent)
    return levels, all_


def closest_cuts(levels: list[DataFrame]) -> DataFrame:
    """Each phrase of two words and more with the cut of its least score: lang, phrase, a, l, r, score."""
    known, phrases = levels[0], levels[1]
    for more in levels[1:-1]:
        known = known.unionByName(more)
    for more in levels[2:]:
        phrases = phrases.unionByName(more)
    part = lambda c, a, n: F.array_join(F.slice(c, a, n), " ")
    cuts = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part("w", F.lit(1), F.col("k")).alias("left"), part("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(n)), ["lang", side])
    # whole numbers of up to 38 digits; a is at most l and r, so the outcome is a million at most
    wide = {c: f"CAST({c} AS DECIMAL(18,0))" for c in "alr"}
    scored = cuts.withColumn("score", F.expr(f"({wide['a']} * {wide['a']} * 1000000BD) div ({wide['l']} * {wide['r']})"))
    return scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def held_phrases(levels: list[DataFrame], held: int) -> DataFrame:
    """The phrases (lang, phrase) that stand in a longer one at least `held` times of a hundred."""
    inner = None
    for m, longer in enumerate(levels[2:], 3):
        words, spans = F.split("phrase", " "), [(a, n) for n in range(2, m) for a in range(1, m - n + 2)]
        each = longer.select("lang", F.col("a").alias("longer"), F.explode(F.array(*[F.array_join(F.slice(words, a, n), " ") for a, n in spans])).alias("phrase"))
        inner = each if inner is None else inner.unionByName(each)
    if inner is None:
        return levels[0].select("lang", "phrase").where("false")
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = levels[1]
    for more in levels[2:-1]:
        own = own.unionByName(more)
    return own.join(most, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("a") * held).select("lang", "phrase")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = 3, least: int = LEAST, most: int = MOST, held: int = HELD, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """The `most` closest phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are folded (A-Z only), cut into pieces at `[.,;:!?\\n-\\r]` and into words at blanks and tabs. A phrase of 2
    to `words` words that occurs a >= `least` times, overlaps counted, is scored at its weakest cut, floor(1000000 a a
    / (l r)), of equal cuts the first. Phrases inside a longer one that is as frequent (`held` of a hundred)
    are left out. Order: score and a, falling, then the phrase by its bytes. Null texts are empty, a null language is
    `und`; rows that repeat count each time; other columns are ignored. An empty table gives no rows.
    """
    levels, all_ = phrase_counts(docs, lang, text, words, least, buckets, chunk)
    found = closest_cuts(levels).join(held_phrases(levels, held), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language may hold most phrases: each of its parts sends its best ones only
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    best = found.withColumn("__part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(all_, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

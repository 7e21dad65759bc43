"""Toxicity by the nearest labelled examples: exact TF-IDF cosine under block-max inverted indexes.

A text's vector has all its lower-cased words. A word weighs (1 + ln tf) * ln(1 + N / df) * relevance, with
document frequencies over all documents; relevance is 1 plus the deviations (shrunk, at least 0) by which
the word's examples are more often positive than the mean, so no word is dropped and labels only stretch
the axes. The examples are a bounded sample of labelled rows (`EXAMPLES` of them, with `WORDS` words at most);
equal vectors are one entry with its counts of either label. A word that no example has is in no dot product; it lengthens its text by the
weight of a word in one text of so many as there are examples.

Entries lie in blocks. Words of few entries have posting lists, which are summed whole; a word of many
entries has its largest weight in every block and is read only in blocks whose bound (the exact part plus
these maxima) reaches the k-th similarity, best bounds first, which leaves the result exact. Neighbours
vote by nearness; votes are calibrated by a logistic curve fitted on leave-one-out votes of the examples.
An index holds at most `POSTINGS` of them; more examples, or longer ones, make more indexes, which the
documents pass one after another, keeping their best.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut, whole_text
from .tokens import LOOSE, span_hashes, texts_of, word_spans

EXAMPLES, WORDS, NEIGHBOURS, BLOCK_SIZE, FREQUENT, SHRINK, POSTINGS = 4096, 8_000_000, 32, 64, 16, 4.0, 2_000_000
ARRAYS = pa.list_(pa.int64())


def _counts(batch: pa.RecordBatch, text: str):
    """Each text's distinct words, sorted hashes, and how often it has them."""
    for _, data, bounds in texts_of(batch, text):
        starts, ends = word_spans(data, bounds, LOOSE)
        hashes = span_hashes(data, starts, ends)
        at = np.searchsorted(starts, bounds)
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield np.unique(hashes[i:j], return_counts=True)


def _places(found: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words, which are in the space, and their places there."""
    if not len(space):
        return np.zeros(len(found), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(space, found), len(space) - 1)
    inside = space[at] == found
    return inside, at[inside]


def example_words(train: DataFrame, most: int = WORDS) -> tuple[list, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ids, labels, words and counts of the examples, by id: as many of them, by a hash of their ids, as have at
    most `most` different words, each counted for itself."""
    kind = train.schema["__id"].dataType.simpleString()

    def counted(batches):
        for batch in batches:
            found = list(_counts(batch, "__text"))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())], ["__id", "label", "words", "counts"])

    every = cut(train.mapInArrow(counted, f"__id {kind}, label int, words binary, counts binary"))
    # a row for each example: the turn it has and how many words it brings
    sizes = sorted(tuple(r) for r in every.select(F.xxhash64(F.lit(7), "__id"), "__id", F.octet_length("words") / 8).collect())
    total, last = 0, None
    for turn, _, n in sizes:
        if total + n > most:
            break
        total, last = total + n, turn
    got = every.where(F.xxhash64(F.lit(7), "__id") <= F.lit(last)).orderBy("__id").toArrow()
    of = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in got.column(name)]
    return got.column("__id").to_pylist(), np.array(got.column("label").to_pylist(), float), of("words", np.uint64), of("counts", np.int32)


def document_frequencies(rows: DataFrame, space: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of all rows, and of those that have each word of the space."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def counted(batches):
        total, df = 0, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            total += batch.num_rows
            for found, _ in _counts(batch, "__text"):
                df[_places(found, shared.value)[1]] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], total))], ["place", "n"])

    got = rows.select("__text").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    df, place, n = np.ones(len(space)), got.column("place").to_numpy(), got.column("n").to_numpy()
    df[place[place >= 0]] = n[place >= 0]
    return max(int(n[place < 0].sum()), 1), df


class Weights:
    """The space of the examples' words and the weight of each."""

    def __init__(self, space: np.ndarray, weight: np.ndarray, unseen: float):
        self.space, self.weight, self.unseen = space, weight, unseen

    def vector(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's words in the space, by the length of the whole text."""
        inside, at = _places(found, self.space)
        at = at.astype(np.int32)
        tf = 1 + np.log(counts)
        w = tf[inside] * self.weight[at]
        length = np.sqrt((w * w).sum() + ((tf[~inside] * self.unseen) ** 2).sum())
        return at, (w / length if length else w).astype(np.float32)


def relevance(words: list[np.ndarray], labels: np.ndarray, space: np.ndarray) -> np.ndarray:
    n, good = np.zeros(len(space)), np.zeros(len(space))
    for found, y in zip(words, labels, strict=True):
        at = np.searchsorted(space, found)
        n[at] += 1
        good[at] += y
    share = labels.mean()
    return 1 + np.maximum((good - n * share) / np.sqrt(n * share * (1 - share) + SHRINK), 0)


class Index:
    """Vectors under a block-max inverted index. first: the number of its first entry."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int, first: int = 0):
        self.first, self.n = first, len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK_SIZE))
        entry = np.repeat(np.arange(self.n, dtype=np.int32), [len(at) for at, _ in vectors])
        term = np.concatenate([at for at, _ in vectors]) if vectors else np.zeros(0, np.int32)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0, np.float32)
        df = np.bincount(term, minlength=width)
        often = df * FREQUENT > self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.dense = np.zeros((int(often.sum()), self.blocks, BLOCK_SIZE), np.float32)
        mine = often[term]
        self.dense[self.row[term[mine]], entry[mine] // BLOCK_SIZE, entry[mine] % BLOCK_SIZE] = weight[mine]
        self.most = np.nextafter(self.dense.max(2), np.float32(2)) if len(self.dense) else np.zeros((0, self.blocks), np.float32)
        term, entry, weight = term[~mine], entry[~mine], weight[~mine]
        order = np.argsort(term, kind="stable")
        self.entry, self.weight = entry[order], weight[order]
        start = np.searchsorted(term[order], np.arange(width + 1))
        self.start, self.size = start[:-1].astype(np.int32), np.diff(start).astype(np.int32)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest entries and their cosines, exactly; of equal cosines (to a millionth) the first entry."""
        rows = self.row[at]
        rare, often = rows < 0, rows >= 0
        size = self.size[at[rare]]
        ends = np.cumsum(size)
        flat = np.repeat(self.start[at[rare]] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        exact = np.bincount(self.entry[flat], self.weight[flat] * np.repeat(w[rare], size), self.blocks * BLOCK_SIZE)
        rows, w = rows[often], w[often]
        bound = exact.reshape(self.blocks, BLOCK_SIZE).max(1) + w @ self.most[rows] + 1e-6
        order = np.argsort(-bound, kind="stable")
        ids, sims, i, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while i < len(order) and bound[order[i]] > 1e-6:
            some = order[i : i + step]
            if len(sims) >= k:
                some = some[bound[some] >= sims[-1]]
                if not len(some):
                    break
            members = (some[:, None] * BLOCK_SIZE + np.arange(BLOCK_SIZE)).ravel()
            scores = exact[members]
            if len(rows):
                scores = scores + w @ self.dense[rows[:, None], some[None, :]].reshape(len(rows), -1)
            if len(sims) >= k:
                good = scores >= sims[-1] - 1e-6
            elif len(scores) > 4 * k:
                good = scores >= max(np.partition(scores, -k)[-k] - 2e-6, 1e-9)
            else:
                good = scores > 1e-9
            scores = np.round(scores, 6)
            good &= scores > 0
            ids, sims = np.append(ids, members[good]), np.append(sims, scores[good])
            top = np.lexsort((ids, -sims))[:k]
            ids, sims, i, step = ids[top], sims[top], i + step, step * 4
        return ids + self.first, sims


class Votes:
    """How the entries vote, and the calibration of their votes."""

    def __init__(self, n: np.ndarray, good: np.ndarray, ids: list):
        self.n, self.good, self.ids = n, good, ids
        self.prior = (good.sum() + 1) / (n.sum() + 2)
        self.curve = (1.0, 0.0)

    def vote(self, ids: np.ndarray, sims: np.ndarray, less: tuple[int, int] | None = None) -> float:
        """Logit of the share of nearness-weighted votes. less: an entry that loses one vote of a label."""
        n, good, w = self.n[ids], self.good[ids], 1 / (0.05 + 1 - np.minimum(sims, 1))
        if less:
            mine = ids == less[0]
            n, good = n - mine, good - mine * less[1]
        share = ((w * good).sum() + self.prior) / ((w * n).sum() + 1)
        return float(np.log(share / (1 - share)))

    def calibrate(self, near: list[tuple[np.ndarray, np.ndarray]]) -> None:
        votes, truth, weight = [], [], []
        for k, (n, good) in enumerate(zip(self.n, self.good, strict=True)):
            for y, m in ((1, good), (0, n - good)):
                if m:
                    votes.append(self.vote(*near[k], less=(k, y))), truth.append(y), weight.append(m)
        self.curve = _logistic(np.array(votes), np.array(truth, float), np.array(weight, float))

    def score(self, ids: np.ndarray, sims: np.ndarray) -> tuple[float, str]:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.vote(ids, sims) + b)))), ",".join(f"{self.ids[k]}:{s:.4f}" for k, s in zip(ids[:3].tolist(), sims[:3].tolist(), strict=True))


def merge(near: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """The best k of several indexes' nearest."""
    if len(near) == 1:
        return near[0]
    ids, sims = np.concatenate([i for i, _ in near]), np.concatenate([s for _, s in near])
    top = np.lexsort((ids, -sims))[:k]
    return ids[top], sims[top]


def entries(words: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, ids: list, weights: Weights) -> tuple[list, np.ndarray, np.ndarray, list]:
    """The different vectors, how many examples have each, how many of these are positive, and the first's id.
    Vectors with the same leading word lie together, so that blocks have tight bounds."""
    found: dict = {}
    for f, c, y, i in zip(words, counts, labels, ids, strict=True):
        e = found.setdefault(hashlib.blake2b(f.tobytes() + c.tobytes(), digest_size=16).digest(), [*weights.vector(f, c), 0, 0, i])
        e[2], e[3] = e[2] + 1, e[3] + int(y)
    made = sorted(found.values(), key=lambda e: (int(e[0][e[1].argmax()]) if len(e[0]) else -1, -float(e[1].max(initial=0)), e[0].tobytes(), e[1].tobytes()))
    return [(e[0], e[1]) for e in made], np.array([e[2] for e in made], float), np.array([e[3] for e in made], float), [e[4] for e in made]


def parts_of(vectors: list[tuple[np.ndarray, np.ndarray]], most: int = POSTINGS) -> list[tuple[int, int]]:
    """Runs of vectors of at most `most` postings together, one vector at least."""
    parts, a, held = [], 0, 0
    for k, (at, _) in enumerate(vectors):
        if held and held + len(at) > most:
            parts.append((a, k))
            a, held = k, 0
        held += len(at)
    return [*parts, (a, len(vectors))]


def _logistic(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit, with a little ridge towards slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        v = m * p * (1 - p)
        g = np.array([(m * (y - p) * x).sum() - (a - 1), (m * (y - p)).sum() - 0.1 * b])
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.05), b


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, row: str | None = None, postings: int = POSTINGS, most_words: int = WORDS) -> DataFrame:
    """One row per document: key, score (0 to 1), predicted (1 from 0.5), evidence (nearest examples).

    labels: (key, label) rows to learn from; rows with a null key or label are left out, and of a key's
    conflicting labels 1 counts. At most `examples` labelled keys are used, and of these as many as have
    `most_words` different words, each counted for itself; of a repeated key's texts, the one of the least hash. Every row gets a row of its own, repeated keys and equal texts too. Null texts are
    empty; a text that shares no word with an example has no evidence and scores by the share of positive
    examples, and with no labels at all every score is 0.25. row: a column of any kind that is passed on, the
    rows' number or all of a row as a struct. Other columns, clashing names too, are ignored.
    """
    sc = docs.sparkSession.sparkContext
    own = [F.col(row).alias("__row")] if row else []
    rows = docs.select(F.col(key).alias("__id"), *own, whole_text(text).alias("__text"))
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = bounded_sample(marked, "__id", examples)
    of = rows.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("t"), F.max("label").alias("label"))
    ids, marks, words, counts = example_words(of.select("__id", "label", F.col("t.__text").alias("__text")), most_words)
    parts, votes, shared = [], None, sc.broadcast(None)
    if ids:
        space = np.unique(np.concatenate(words))
        total, df = document_frequencies(rows, space)
        weights = Weights(space, np.log(1 + total / df) * relevance(words, marks, space), float(np.log(1 + len(ids))))
        vectors, n, good, first = entries(words, counts, marks, ids, weights)
        votes = Votes(n, good, first)
        del words, counts
        indexes = [Index(vectors[a:b], len(space), a) for a, b in parts_of(vectors, postings)]
        votes.calibrate([merge([i.nearest(*v) for i in indexes]) for v in vectors])
        parts, shared = [sc.broadcast(i) for i in indexes], sc.broadcast((weights, votes))
    kind = rows.schema["__id"].dataType
    passed = [T.StructField(row, rows.schema["__row"].dataType)] if row else []
    schema = T.StructType([T.StructField(key, kind), *passed, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.StringType())])

    def search(part):
        """The rows with the best so far: of what earlier indexes found and this one's."""

        def found(batches):
            weights = shared.value[0]
            for batch in batches:
                near = [part.value.nearest(*weights.vector(*c)) for c in _counts(batch, "__text")]
                if "__ids" in batch.schema.names:
                    near = [merge([(np.array(i, np.int64), np.array(s)), n]) for i, s, n in zip(batch.column("__ids").to_pylist(), batch.column("__sims").to_pylist(), near, strict=True)]
                kept = [c for c in batch.schema.names if c not in ("__ids", "__sims")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([i for i, _ in near], ARRAYS), pa.array([s for _, s in near], pa.list_(pa.float64()))], [*kept, "__ids", "__sims"])

        return found

    for part in parts[:-1]:
        rows = cut(rows.mapInArrow(search(part), rows.select(*(c for c in rows.columns if c not in ("__ids", "__sims"))).withColumns({"__ids": F.array().cast("array<long>"), "__sims": F.array().cast("array<double>")}).schema))

    def scored(batches):
        for batch in search(parts[-1])(batches) if parts else batches:
            if parts:
                out = [shared.value[1].score(np.array(i, np.int64), np.array(s)) for i, s in zip(batch.column("__ids").to_pylist(), batch.column("__sims").to_pylist(), strict=True)]
            else:
                out = [(0.25, "")] * batch.num_rows
            score = np.array([s for s, _ in out], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), *([batch.column("__row")] if row else []), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([e for _, e in out], pa.string())],
                [key, *([row] if row else []), "score", "predicted", "evidence"],
            )

    return rows.mapInArrow(scored, schema)

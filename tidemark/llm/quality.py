"""Quality scores by a factorisation machine over words, structure and metadata.

Features are hashed lower-cased words (weight log(1 + n), scaled to length 1), structure statistics of
the text in steps (shares of kinds of characters, of repeated words and lines, lengths), and any metadata
columns named, hashed as column=value. The model is w0 + sum(w x) plus low-rank pairwise interactions,
scored in linear time as 1/2 * sum over factors of (sum(v x))**2 - sum(v**2 x**2). It is fitted by AdaGrad
on a bounded sample of labelled rows (`SAMPLE`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, whole_text
from .tokens import LOOSE, mix, span_hashes, texts_of, word_spans

SAMPLE, WORDS, RANK, ROUNDS, BATCH, RATE, DECAY = 8192, 4096, 8, 20, 256, 0.15, 1e-4
_STEPS = np.array([0, 0.002, 0.01, 0.03, 0.07, 0.15, 0.3, 0.6])
_SIGNS = [ord(c) for c in "#$%&*!?|<>{}[]=+@~^\\/_"]
_HALVES = np.zeros((256, 9))
_HALVES[65:91, 0] = _HALVES[97:123, 1] = _HALVES[48:58, 2] = _HALVES[128:, 3] = 1
_HALVES[_SIGNS, 4] = _HALVES[10, 5] = _HALVES[ord("|"), 6] = _HALVES[[ord(c) for c in ".,;:"], 7] = _HALVES[[9, 11, 12, 13, 32], 8] = 1
SHARES, SIZES, META = 14, 3, 1024
_SHARE_AT, _SIZE_AT = WORDS, WORDS + SHARES * 9
_META_AT = _SIZE_AT + SIZES * 16
WIDTH = _META_AT + META


def _structure(raw: np.ndarray, hashes: np.ndarray, gaps: np.ndarray, found: np.ndarray, counts: np.ndarray) -> list[int]:
    """Numbers of the structure features that a text has."""
    kinds = np.bincount(raw, minlength=256) @ _HALVES
    n, many = max(len(raw), 1), len(hashes)
    shares = list(kinds / n)
    shares.append(1 - len(found) / max(many, 1))
    shares.append(counts.max() / many if many else 0)
    shares.append(float((hashes[1:] == hashes[:-1]).mean()) if many > 1 else 0)
    shares.append(float((gaps >= 2).mean()) if len(gaps) else 0)
    lines = [x for x in raw.tobytes().split(b"\n") if x.strip()]
    shares.append(1 - len(set(lines)) / max(len(lines), 1))
    out = [_SHARE_AT + 9 * k + int(np.searchsorted(_STEPS, s, "left" if s <= 0 else "right")) for k, s in enumerate(shares)]
    sizes = (n, many, 16 * n / max(len(lines), 1))
    return [*out, *(_SIZE_AT + 16 * k + min(int(np.log2(s + 1)), 15) for k, s in enumerate(sizes))]


def rows_of(batch: pa.RecordBatch, text: str, metadata: list[str]):
    """Feature numbers and values of each text, sorted by number."""
    meta = [[int(mix(np.uint64(hash_of(f"{c}={v}"))) % META) + _META_AT for v in batch.column(c).to_pylist()] for c in metadata]
    raw_blocks, low_blocks = texts_of(batch, text, lower=False), texts_of(batch, text)
    cased, i = ((d[b[k] : b[k + 1]]) for _, d, b in raw_blocks for k in range(len(b) - 1)), 0
    for _, data, bounds in low_blocks:
        starts, ends = word_spans(data, bounds, LOOSE)
        hashes = span_hashes(data, starts, ends)
        at = np.searchsorted(starts, bounds)
        for k in range(len(at) - 1):
            a, b = at[k], at[k + 1]
            own = hashes[a:b]
            found, counts = np.unique(own >> np.uint64(52), return_counts=True)
            x = np.log1p(counts)
            norm = np.sqrt((x * x).sum()) if len(x) else 1
            extra = _structure(next(cased), own, starts[a + 1 : b] - ends[a : max(b - 1, a)] if b > a else starts[:0], np.unique(own), counts if len(counts) else np.zeros(1))
            extra += [m[i] for m in meta]
            yield np.concatenate([found.astype(np.int32), np.array(extra, np.int32)]), np.concatenate([x / norm, np.full(len(extra), 0.25)]).astype(np.float32)
            i += 1


def hash_of(value: str) -> int:
    data = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 0


class Machine:
    """A factorisation machine for a binary label."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, RANK))

    def raw(self, at: np.ndarray, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic curve, and the factor sums, of rows that end at `ends`."""
        starts = np.concatenate([[0], ends[:-1]])
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        z, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum([len(r[0]) for r in rows]))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 4) -> Machine:
        rng = np.random.default_rng(seed)
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        g0, gw, gv = 1e-3, np.full(WIDTH, 1e-3), np.full((WIDTH, RANK), 1e-3)
        for _ in range(ROUNDS):
            order = rng.permutation(len(rows))
            for some in np.split(order, range(BATCH, len(order), BATCH)):
                at, x = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some]).astype(float)
                sizes = np.array([len(rows[k][0]) for k in some])
                z, sums = self.raw(at, x, np.cumsum(sizes))
                off = np.repeat(labels[some] - 1 / (1 + np.exp(-np.clip(z, -35, 35))), sizes) / len(some)
                used, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, off * x) - DECAY * self.w[used]
                per = (off * x)[:, None] * (np.repeat(sums, sizes, 0) - self.v[at] * x[:, None])
                dv = np.stack([np.bincount(back, per[:, f]) for f in range(RANK)], 1) - DECAY * self.v[used]
                d0 = float((off / np.repeat(sizes, sizes)).sum())
                g0, gw[used], gv[used] = g0 + d0 * d0, gw[used] + dw * dw, gv[used] + dv * dv
                self.w0 += RATE * d0 / np.sqrt(g0)
                self.w[used] += RATE * dw / np.sqrt(gw[used])
                self.v[used] += RATE * dv / np.sqrt(gv[used])
        return self


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """One row per document: key, score (0 to 1), predicted (1 from 0.5).

    labels: (key, label) rows to learn from; rows with a null key or label are left out, and of a key's
    conflicting labels 1 counts. At most `sample` labelled keys are learnt from; of a repeated key's texts, the
    one of the least hash. Every row gets a row of its own, repeated keys and equal texts too. Null texts are
    empty and get the score of their structure. Without labels every score is one half. Columns other than the
    key, the text and `metadata` are ignored.
    """
    spark = docs.sparkSession
    names = [f"__m{k}" for k in range(len(metadata))]
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text"), *(F.col(c).cast("string").alias(n) for c, n in zip(metadata, names, strict=True)))
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = bounded_sample(marked, "__id", sample)

    def featured(batches):
        for batch in batches:
            found = list(rows_of(batch, "__text", names))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), pa.array([r[0] for r in found], pa.list_(pa.int32())), pa.array([r[1] for r in found], pa.list_(pa.float32()))], ["__id", "label", "at", "x"])

    kind = rows.schema["__id"].dataType.simpleString()
    one = F.min(F.struct(F.xxhash64("__text", *names), "__text", *names)).alias("t")
    train = rows.join(F.broadcast(chosen), "__id").groupBy("__id").agg(one, F.max("label").alias("label")).select("__id", "t.__text", *(f"t.{n}" for n in names), "label")
    own = cut(train.mapInArrow(featured, f"__id {kind}, label int, at array<int>, x array<float>")).orderBy("__id").toPandas()
    machine = Machine()
    if len(own):
        machine.fit([(np.asarray(a, np.int32), np.asarray(x, np.float32)) for a, x in zip(own["at"], own["x"], strict=True)], own["label"].to_numpy(float))
    else:
        machine.v[:] = 0
    shared = spark.sparkContext.broadcast(machine)

    def scored(batches):
        for batch in batches:
            out, held = [], []
            for row in rows_of(batch, "__text", names):
                held.append(row)
                if len(held) == 256:
                    out.append(shared.value.score(held))
                    held = []
            score = np.concatenate([*out, shared.value.score(held)])
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    return rows.mapInArrow(scored, f"`{key}` {kind}, score double, predicted int")

"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five consecutive words of the lower-cased text. It weighs tf * idf with
idf = 1 + ln(N / max(df, 1)). Texts are linked in two turns. The first weighs by tf alone; its
classes are what votes in the second: N counts classes and df those whose least text has the shingle, so
neither exact copies nor near copies wear down their own weights. The second turn weighs by tf * idf and
adds links between texts whose classes still differ, so a pair is linked if either weighting accepts it.
Both counts are exact, for every shingle. Those that more than a hundredth of the texts have are few however large
the input is, and every task holds them (`common_shingles`: a first pass keeps what is frequent in some part, a
second counts it). All others are dealt out by shingle and counted there; those that two votes or more have go
back to their texts, with their counts, and stay beside them (`rare_shingles`). What one vote has, or none, has the
largest idf. A text of such shingles only weighs the same in both turns, up to a factor, and is signed once.

Consistent weighted sampling draws (shingle, quantum) pairs; two texts draw the same pair with a
probability equal to their weighted Jaccard similarity. The draws r, c ~ Gamma(2, 1), b ~ U(0, 1) come
from a table of 2**16 draws, addressed by shingle and hash number. Bands of samples give buckets. In a
bucket, members are held only against leaders (the least under one of three orders). A leader's members
that it missed are held against the group's medoid, estimated from signatures of a few dozen members
drawn by hash. What is still apart from its leader's class is compared exactly with the group in square
blocks inside tasks, which give out a spanning forest of the links and never the pairs. Every link is
verified on the whole texts, and links are closed to classes by alternating star contraction. Texts with
equal words are folded before all this and cost one row; what is linked are texts, not keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text
from .tokens import blocks, buffers, mix, shingles, texts_of, words

WIDTH, RARE, BANDS, ROWS, LEAST = 5, 100, 16, 4, 0.8
CHUNK, SQUARE, REFERENCES, SLICE, SALTS = 128, 256, 32, 2048, 32
PART, HOME, HELD = 10_000_000, 4096, 2_000_000
_DRAWS = 1 << 16
_NONE = np.zeros(0, np.uint64)


class Sampler:
    """Weights and samples of shingle sets under the corpus's idf, over the largest idf; by tf alone without
    common or rare shingles. least: the count below which idf doesn't grow."""

    def __init__(self, common: np.ndarray = _NONE, counts: np.ndarray = _NONE, total: int = 1, hashes: int = BANDS * ROWS, least: float | None = None):
        order = np.argsort(common)
        self.total, self.least = total, max(total / RARE, 1) if least is None else least
        self.common, self.idf = common[order], self.idf_of(counts[order])
        rng = np.random.default_rng(20240501)
        self.r = rng.gamma(2.0, 1.0, _DRAWS)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _DRAWS))
        self.b = rng.random(_DRAWS)
        self.turn = mix(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
        self.usual = self.draw(slice(None), 0.0)[1].astype(np.float32)

    def idf_of(self, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(self.total / np.maximum(counts, self.least))) / (1 + np.log(self.total / self.least))

    def draw(self, at, log_weight) -> tuple[np.ndarray, np.ndarray]:
        """The quantum and the race time (its logarithm) of draws at a weight."""
        t = np.floor(log_weight / self.r[at] + self.b[at])
        return t, self.log_c[at] - self.r[at] * (t - self.b[at] + 1)

    def has_common(self, found: np.ndarray) -> bool:
        return bool(len(self.common)) and bool(_places(self.common, found)[0].any())

    def weights(self, found: np.ndarray, counts: np.ndarray | int, rare: bytes | None = None) -> np.ndarray:
        """rare: what `rare_shingles` gives for the text."""
        w = np.ones(len(found))
        if len(self.common):
            hit, at = _places(self.common, found)
            w[hit] = self.idf[at]
        if rare:
            values, n = np.frombuffer(rare, np.uint64).reshape(2, -1)
            hit, at = _places(values, found)
            w[hit] = self.idf_of(n[at].astype(float))
        return w * counts

    def sample(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit sample per hash. A shingle whose weight is the usual one needs a single look-up."""
        best = np.full(len(self.turn), np.inf, np.float32)
        out = np.zeros(len(self.turn), np.uint64)
        rows = np.arange(len(self.turn))
        for i in range(0, len(found), 4096):
            part, log_w = found[i : i + 4096], np.log(weights[i : i + 4096])
            at = self.turn[:, None] * part[None, :]
            at >>= np.uint64(48)
            at = at.view(np.int64)
            time = self.usual.take(at, mode="clip")
            odd = np.flatnonzero(np.abs(log_w) > 1e-12)
            if len(odd):
                time[:, odd] = self.draw(at[:, odd], log_w[None, odd])[1]
            win = time.argmin(1)
            won = time[rows, win]
            t, _ = self.draw(at[rows, win], log_w[win])
            better = won < best
            best[better] = won[better]
            out[better] = mix(part[win] ^ mix(t.astype(np.int64).view(np.uint64)))[better]
        return out


def _places(values: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of found are among the sorted values, and where those stand."""
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    hit = values[at] == found
    return hit, at[hit]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and their counts."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return values[at], np.diff(at, append=len(values))


def _runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The shingles of each text of a block, in order of their places."""
    _, _, hashes, at = words(data, bounds)
    whole = shingles(hashes, WIDTH)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield whole[i : j - WIDTH + 1] if j - i >= WIDTH else shingles(hashes[i:j], WIDTH)


def _documents(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's place and shingles."""
    for first, data, bounds in texts_of(batch, text):
        for k, found in enumerate(_runs(data, bounds)):
            yield first + k, found


def _sets_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's different shingles and their counts."""
    data, offsets = buffers(pc.utf8_lower(texts))
    return [_distinct(found) for i, j in blocks(offsets) for found in _runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]


def _weighed(group: pa.Table, sampler: Sampler) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's different shingles, their counts and their idf."""
    rare = group.column("rare").to_pylist() if "rare" in group.schema.names else [None] * group.num_rows
    return [(found, counts, sampler.weights(found, 1, r)) for (found, counts), r in zip(_sets_of(group.column("__text")), rare, strict=True)]


def common_shingles(docs: DataFrame, total: int, text: str = "text", voters: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than one part in `RARE` of all documents, and in how many. With voters given: these
    shingles and some in at least half that share, and in how many of the voters each is.

    Such a shingle is in half that share of the documents of some part at least, or the parts together
    could not reach it. So each part (by lossy counting, in bounded memory) sends what reaches half; of
    that, what the sums show to reach half overall is counted exactly in a second pass. Either list has
    at most 2 * RARE times a document's mean distinct shingles.
    """

    def frequent(batches):
        held, counts, missed, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        gathered: list[np.ndarray] = []

        def fold():
            nonlocal held, counts, missed, gathered
            new, n = np.unique(np.concatenate(gathered), return_counts=True) if gathered else (held[:0], counts[:0])
            gathered = []
            old = np.isin(new, held, assume_unique=True)
            counts[np.searchsorted(held, new[old])] += n[old]
            late = int(seen_before / (4 * RARE))
            both = np.concatenate([held, new[~old]])
            order = np.argsort(both)
            held, counts = both[order], np.concatenate([counts, n[~old]])[order]
            missed = np.concatenate([missed, np.full((~old).sum(), late)])[order]
            keep = counts + missed > seen / (4 * RARE)
            held, counts, missed = held[keep], counts[keep], missed[keep]

        seen_before, size = 0, 0
        for batch in batches:
            for _, found in _documents(batch, text):
                gathered.append(found := _distinct(found)[0])
                seen += 1
                size += len(found)
                if size > 2_000_000:
                    fold()
                    seen_before, size = seen, 0
        fold()
        keep = counts + missed >= seen / (2 * RARE)
        yield pa.RecordBatch.from_arrays([pa.array(held[keep].view(np.int64)), pa.array((counts + missed)[keep])], ["shingle", "n"])

    parts = max(1, total // 2000)
    first = (
        docs.select(text).coalesce(parts).mapInArrow(frequent, "shingle long, n long")
        .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= total / (2 * RARE)).select("shingle").toPandas()
    )
    wanted = np.sort(first["shingle"].to_numpy(np.int64, copy=True).view(np.uint64))
    if not len(wanted):
        return wanted, np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches):
        sought = shared.value
        counts = np.zeros(len(sought), np.int64)
        for batch in batches:
            for _, found in _documents(batch, text):
                counts[np.unique(_places(sought, found)[1])] += 1
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(sought[some].view(np.int64)), pa.array(counts[some])], ["shingle", "n"])

    exact = (docs if voters is None else voters).select(text).mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    exact = exact.where(F.col("n") > total / RARE if voters is None else F.lit(True)).toPandas()
    shared.unpersist()
    if voters is not None:
        counts = np.zeros(len(wanted), np.int64)
        counts[np.searchsorted(wanted, exact["shingle"].to_numpy(np.int64, copy=True).view(np.uint64))] = exact["n"].to_numpy(np.int64)
        return wanted, counts
    return exact["shingle"].to_numpy(np.int64, copy=True).view(np.uint64), exact["n"].to_numpy(np.int64)


def _packed(part: np.ndarray, parts: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """A row for each part: its number, the ids, how many rows in turn have each, and the columns, as bytes. ids: of
    each row, those of a text in succession."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        at = order[bounds[p] : bounds[p + 1]]
        own = ids[at]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        yield p, own[first].tobytes(), np.diff(first, append=len(own)).astype(np.int32).tobytes(), *(c[at].tobytes() for c in columns)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """`_packed` rows as a batch."""
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _unpacked(group: pa.Table, **kinds) -> list[np.ndarray]:
    """The ids of the rows in all of a group's `_packed` rows, and the columns by name and kind."""
    whole = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    return [np.repeat(whole("ids", np.int64), whole("sizes", np.int32)), *(whole(*c) for c in kinds.items())]


def rare_shingles(docs: DataFrame, shared, text: str, size: int, total: int) -> DataFrame:
    """(__id, rare) of the texts that have shingles which two voters or more have: those shingles in order, then the
    numbers of voters. The common shingles of the sampler are left out. docs: __id, the text, and whether it is a
    voter; size: bytes of all texts; total: their number.

    Every shingle goes once to its part and, if it is in two voters, once back. A part has about `PART` bytes of text
    and a shingle adds to it a hundredth of the texts at most, as what is in more of them is common.
    """
    parts, homes = max(1, -(-size // PART)), max(1, -(-total // HOME))
    home = lambda ids: (mix(ids.view(np.uint64)) % np.uint64(homes)).astype(np.int64)

    def sent(batches):
        for batch in batches:
            ids, votes = batch.column("__id").to_numpy(zero_copy_only=False), batch.column("voter").to_numpy(zero_copy_only=False)
            found, at, held = [], [], 0

            def dealt():
                values, rows = np.concatenate(found), np.repeat(at, [len(x) for x in found])
                packed = _packed((values % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64), parts, ids[rows], values, votes[rows].astype(np.uint8))
                return _batch(list(packed), ["part", "ids", "sizes", "shingles", "votes"])

            for k, of_text in _documents(batch, text):
                of_text = _distinct(of_text)[0]
                if len(shared.value.common):
                    of_text = of_text[~_places(shared.value.common, of_text)[0]]
                found.append(of_text), at.append(k)
                held += len(of_text)
                if held > HELD:
                    yield dealt()
                    found, at, held = [], [], 0
            if held:
                yield dealt()

    def counted(group: pa.Table) -> pa.Table:
        ids, found, votes = _unpacked(group, shingles=np.uint64, votes=np.uint8)
        values, at = np.unique(found, return_inverse=True)
        n = np.bincount(at[votes > 0], minlength=len(values))[at]
        hit = n > 1
        ids, found, n = ids[hit], found[hit], n[hit].astype(np.int64)
        return pa.Table.from_batches([_batch(list(_packed(home(ids), homes, ids, found, n)), ["home", "ids", "sizes", "shingles", "n"])])

    def gathered(group: pa.Table) -> pa.Table:
        ids, found, n = _unpacked(group, shingles=np.uint64, n=np.int64)
        order = np.lexsort((found, ids))
        ids, found, n = ids[order], found[order], n[order].view(np.uint64)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        rare = [found[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(ids)), strict=True)]
        return pa.table([pa.array(ids[first]), pa.array(rare, pa.binary())], ["__id", "rare"])

    there = docs.select("__id", text, "voter").mapInArrow(sent, "part int, ids binary, sizes binary, shingles binary, votes binary")
    back = there.groupBy("part").applyInArrow(counted, "home int, ids binary, sizes binary, shingles binary, n binary")
    return back.groupBy("home").applyInArrow(gathered, "__id long, rare binary")


def word_digests(docs: DataFrame, text: str) -> DataFrame:
    """The rows with a digest of their words, null where there are none, in a new column `digest`."""
    held = docs.columns

    def digested(batches):
        for batch in batches:
            out = []
            for _, data, bounds in texts_of(batch, text):
                _, _, hashes, at = words(data, bounds)
                out += [hashlib.blake2b(hashes[i:j], digest_size=16).digest() if j > i else None for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(out, pa.binary())], [*held, "digest"])

    return docs.mapInArrow(digested, docs.withColumn("digest", F.lit(None).cast("binary")).schema)


def signatures(docs: DataFrame, shared, text: str, again: bool = False) -> DataFrame:
    """__id, the samples (32 bits each) and the keys of the bands. again: only of texts with a shingle that two voters
    have (common, or in the column `rare`), as the others have those of the turn without idf."""

    def signed(batches):
        for batch in batches:
            samples, keys, at = [], [], []
            lane = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
            rare = batch.column("rare").to_pylist() if again else [None] * batch.num_rows
            for k, found in _documents(batch, text):
                if again and not rare[k] and not shared.value.has_common(found):
                    continue
                at.append(k)
                found, counts = _distinct(found)
                drawn = shared.value.sample(found, shared.value.weights(found, counts, rare[k]))
                band = lane.copy()
                for row in drawn.reshape(BANDS, ROWS).T:
                    band = mix(band ^ row) + row
                samples.append(drawn.astype(np.uint32).tobytes())
                keys.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(at, pa.int64())), pa.array(samples, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["__id", "samples", "bands"])

    return docs.mapInArrow(signed, "__id long, samples binary, bands array<bigint>")


def _numbered(folded: DataFrame) -> DataFrame:
    """The texts with a number each, `__id`, that depends on their words alone: a hash of the digest, under
    the first seed that leaves all numbers different."""
    seed = 0
    while True:
        found = folded.withColumn("__id", F.xxhash64("digest", F.lit(seed)))
        if found.groupBy("__id").count().where("count > 1").isEmpty():
            return found
        seed += 1


def _dealt(links: DataFrame) -> DataFrame:
    """Links (a, b) with the number of lots of their group, about one for `CHUNK` links, and the lot they are
    in. From here on groups are met by (a, lot), so that one of any size loads no task. The number of lots is
    brought to the rows by a salted join; only groups of several lots take part in it."""
    many = links.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("lots")).where("lots > 1")
    salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lots = F.coalesce("lots", F.lit(1))
    found = links.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(23)), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"], "left")
    return cut(found.select("a", "b", lots.alias("lots"), _lot(F.col("b"), lots).alias("lot")))


def _lot(member, lots):
    return F.pmod(F.xxhash64(member), lots).cast("int")


def _groups(rows: DataFrame) -> DataFrame:
    """(a, lots) of the groups."""
    return rows.groupBy("a").agg(F.max("lots").alias("lots"))


def _spread(groups: DataFrame) -> DataFrame:
    """Rows (a, lots, ...) of groups, one for each lot."""
    return groups.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")


def _verify(links: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """Dealt links with the weighted Jaccard similarity of their whole texts.

    Rows of one `a` go out in lots, each with one copy of a's text, so a leader of any number of members loads
    no task.
    """
    kind = texts.schema["__id"].dataType.simpleString()
    of_text = [c for c in texts.columns if c != "__id"]
    lead = _groups(links).join(texts, F.col("a") == F.col("__id")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    lead = lead.select("a", "lot", "lots", F.lit(None).cast(kind).alias("b"), *of_text)
    rest = links.join(texts, F.col("b") == F.col("__id")).select("a", "lot", "lots", "b", *of_text)

    def score(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own = None
        b = group.column("b").to_pylist()
        lead_at = next((i for i, x in enumerate(b) if x is None), None)
        order = [] if lead_at is None else [lead_at, *(i for i in range(len(b)) if i != lead_at)]
        out_b, out_s = [], []
        sets = _weighed(group, shared.value)
        for i in order:
            found, counts, idf = sets[i]
            if own is None:
                own, own_w = found, idf * counts
                continue
            w = idf * counts
            _, x, y = np.intersect1d(own, found, assume_unique=True, return_indices=True)
            low = np.minimum(own_w[x], w[y]).sum()
            out_b.append(b[i]), out_s.append(float(low / (own_w.sum() + w.sum() - low)))
        whole = {c: group.column(c)[:1].to_pylist() * len(out_b) for c in ("a", "lot", "lots")}
        return pa.table({**whole, "b": out_b, "similarity": out_s}, pa.schema([*(group.schema.field(c) for c in ("a", "lot", "lots", "b")), ("similarity", pa.float64())]))

    return lead.unionByName(rest).groupBy("a", "lot").applyInArrow(score, f"a {kind}, lot int, lots int, b {kind}, similarity double")


def _leaders(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's leader and another member, once each. Three orders choose leaders."""
    turn = F.struct(F.xxhash64("id", F.pmod("band", F.lit(3))).alias("o"), F.col("id").alias("id"))
    # written, so that the join deals out both sides itself and Spark can split a crowded bucket
    heads = cut(buckets.groupBy("bucket").agg(F.min(turn).alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("head.id").alias("a")))
    return buckets.join(heads, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def _medoids(groups: DataFrame, samples: DataFrame) -> DataFrame:
    """(a, m): of each leader's group the member whose samples agree best with those of about
    `REFERENCES` members drawn by hash. A group of one lot draws them in its task; of a larger one they are sent
    to every lot."""
    held = groups.join(samples, F.col("b") == F.col("__id")).select("a", "b", "lot", "lots", "samples")
    some = held.where((F.col("lots") > 1) & (F.pmod(F.xxhash64("b", F.lit(11)), F.col("lots") * CHUNK) < REFERENCES))
    drawn = some.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("ref", F.lit(True))
    kind = groups.schema["a"].dataType.simpleString()

    def agree(group: pa.Table) -> pa.Table:
        drawn = group.column("ref").to_numpy().astype(bool)
        sig = np.frombuffer(b"".join(group.column("samples").to_pylist()), np.uint32).reshape(len(drawn), -1)
        own, refs = sig[~drawn], sig[drawn]
        if not len(refs):
            refs = own[np.argsort(mix(group.column("b").to_numpy().view(np.uint64)))[:REFERENCES]]
        score = sum(((own == r).mean(1) for r in refs), np.zeros(len(own)))
        return group.filter(pa.array(~drawn)).select(["a", "b"]).append_column("score", pa.array(score, pa.float64()))

    scored = drawn.unionByName(held.withColumn("ref", F.lit(False))).select("a", "b", "lot", "ref", "samples").groupBy("a", "lot").applyInArrow(agree, f"a {kind}, b {kind}, score double")
    return scored.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("m"))


def _in_blocks(groups: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that a link joins, among groups (a, b, class, lot, lots, out): compared are
    of every group the pairs of two members that are out, and of one out and one in. A task takes a block of the
    square and ties the classes that meet there to the least of them."""
    square = lambda c: F.ceil(F.sum(c.cast("int")) / SQUARE).cast("int")
    sizes = groups.groupBy("a").agg(square(F.col("out")).alias("outs"), square(~F.col("out")).alias("ins"), F.max("lots").alias("lots")).where("outs > 0")
    held = groups.drop("lots").join(_spread(sizes), ["a", "lot"]).join(texts, F.col("b") == F.col("__id"))
    cell = lambda row, col, same: F.struct(row.alias("row"), col.alias("col"), F.lit(same).alias("same"))
    each = lambda n, f: F.transform(F.array_repeat(F.lit(0), F.col(n)), lambda _, k: f(k))
    mine, inner = F.pmod(F.xxhash64("b"), F.col("outs")).cast("int"), F.pmod(F.xxhash64("b"), F.greatest("ins", F.lit(1))).cast("int")
    of_out = F.concat(each("outs", lambda k: cell(F.least(mine, k), F.greatest(mine, k), True)), each("ins", lambda k: cell(mine, k, False)))
    cells = F.when(F.col("out"), of_out).otherwise(each("outs", lambda k: cell(k, inner, False)))
    kind = groups.schema["a"].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        links = _forest(_all_similar(_weighed(group, shared.value), least), group.column("class").to_pylist())
        return pa.table([[x for x, _ in links], [y for _, y in links]], pa.schema([("a", group.schema.field("class").type), ("b", group.schema.field("class").type)]))

    of_text = [c for c in texts.columns if c != "__id"]
    placed = held.select("a", "class", *of_text, F.explode(cells).alias("cell")).select("a", "class", *of_text, "cell.*")
    return placed.groupBy("a", "row", "col", "same").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _all_similar(sets: list, least: float) -> np.ndarray:
    """Pairs of sets at least so similar, by exact weighted Jaccard over slices of the shared shingles. A
    shingle that a text has n times counts as n of them."""
    many, weights = [], []
    for found, counts, idf in sets:
        times = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        many.append(np.where(times > 0, mix(np.repeat(found, counts) + times.astype(np.uint64)), np.repeat(found, counts)))
        weights.append(np.repeat(idf, counts))
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in many])
    totals = np.array([w.sum() for w in weights])
    _, cols, seen = np.unique(np.concatenate(many), return_inverse=True, return_counts=True)
    shared = seen[cols] > 1
    rows, cols, w = rows[shared], cols[shared], np.sqrt(np.concatenate(weights)[shared])
    used, cols = np.unique(cols, return_inverse=True)
    order = np.argsort(cols, kind="stable")
    rows, cols, w = rows[order], cols[order], w[order]
    common = np.zeros((len(sets), len(sets)))
    for low in range(0, len(used), SLICE):
        i, j = np.searchsorted(cols, [low, low + SLICE])
        part = np.zeros((len(sets), min(SLICE, len(used) - low)))
        part[rows[i:j], cols[i:j] - low] = w[i:j]
        common += part @ part.T
    near = common >= (least - 1e-9) * (totals[:, None] + totals[None, :] - common)
    return np.argwhere(np.triu(near, 1))


def _forest(pairs: np.ndarray, classes: list) -> list[tuple[int, int]]:
    """Every class that the pairs of places join to others, with the least of those."""
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs.tolist():
        x, y = sorted((top(classes[i]), top(classes[j])))
        parent[y] = x
    return [(x, top(x)) for x in list(parent) if top(x) != x]


def connected(edges: DataFrame) -> DataFrame:
    """(id, class): the least id of each connected component, by alternating large and small stars. It ends when
    no node with an edge down has another edge."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n"))
        # written, so that the join deals out both sides itself and Spark can split a crowded node
        least = cut(ends.select("a", F.least("a", "b").alias("m"), ((F.col("b") < F.col("a")) & (F.col("n") > 1)).alias("open")))
        if not least.agg(F.max("open")).first()[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("class"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # after the large star a node's edges go down only, to as many as it has different stars
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(
            large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        )


def _through_leaders(links: DataFrame) -> DataFrame:
    """Edges with the components of the links (a, b): every member b, and its other leaders, with the least of its
    leaders. A member has one leader a band at most, so a group of n members comes to about n edges, by however
    many leaders it was found."""
    met = links.groupBy("b").agg(F.collect_set("a").alias("heads")).withColumn("m", F.array_min("heads"))
    return met.select(F.col("m").alias("b"), F.explode(F.array_union("heads", F.array("b"))).alias("a"))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (id, class) that the links (a, b, lot, lots) make of the classes given. Only classes that still
    differ are joined, each as one node; the head of a class has no row of its own."""
    heads = _groups(links).join(classes, F.col("a") == F.col("id"), "left").select("a", "lots", F.coalesce("class", "a").alias("a_class"))
    of_b = classes.select(F.col("id").alias("b"), F.col("class").alias("b_class"))
    pairs = links.join(_spread(heads), ["a", "lot"]).join(of_b, "b", "left").select(F.col("a_class").alias("a"), F.coalesce("b_class", "b").alias("b"))
    return _united(classes, pairs)


def _united(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes (id, class) after those that the pairs (a, b) of their heads name have been joined."""
    tops = connected(pairs)
    if tops.isEmpty():
        return classes
    moved = classes.join(tops.select(F.col("id").alias("class"), F.col("class").alias("top")), "class", "left").select("id", F.coalesce("top", "class").alias("class"))
    return cut(moved.unionByName(tops))


def _banded(signed: DataFrame) -> DataFrame:
    return signed.select(F.col("__id").alias("id"), F.posexplode("bands").alias("band", "bucket"))


def _linked(folded: DataFrame, signed: DataFrame, buckets: DataFrame, shared, least: float, classes: DataFrame | None = None) -> DataFrame:
    """The classes (id, class) of the texts by the weights of `shared`, joined to the classes given."""
    texts = cut(folded.drop("digest").join(buckets.select(F.col("id").alias("__id")).distinct(), "__id", "left_semi"))
    similar, samples = F.col("similarity") >= least - 1e-9, signed.select("__id", "samples")
    scored = cut(_verify(_dealt(_leaders(buckets)), texts, shared))
    found = scored.where(similar)
    missed = cut(_groups(scored.where(~similar)))
    apart = not missed.isEmpty()
    if apart:
        # the groups of leaders that missed some: their members, and the leaders themselves
        own = missed.select("a", F.col("a").alias("b"), _lot(F.col("a"), F.col("lots")).alias("lot"), "lots")
        groups = cut(scored.join(_spread(missed), ["a", "lot"], "left_semi").select("a", "b", "lot", "lots").unionByName(own))
        medoids = _medoids(groups, samples).join(missed, "a")
        met = groups.join(_spread(medoids), ["a", "lot"]).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        found = found.unionByName(cut(_verify(_dealt(met), texts, shared).where(similar)))
    # the links of leaders and of medoids are closed together
    classes = connected(_through_leaders(found)) if classes is None else _merged(classes, found)
    if apart:
        heads = missed.join(classes, F.col("a") == F.col("id"), "left").select("a", "lots", F.coalesce("class", "a").alias("a_class"))
        of_b = classes.select(F.col("id").alias("b"), F.col("class").alias("b_class"))
        placed = groups.join(_spread(heads), ["a", "lot"]).join(of_b, "b", "left").withColumn("class", F.coalesce("b_class", "b"))
        placed = cut(placed.select("a", "b", "class", "lot", "lots", (F.col("a_class") != F.col("class")).alias("out")))
        # of what is in, none nearer the leader than the allowed distance short of the nearest that is out
        near = scored.select("a", "b", "similarity")
        best = placed.where("out").join(near, ["a", "b"]).groupBy("a").agg(F.max("similarity").alias("best"), F.max("lots").alias("lots"))
        inner = placed.where("NOT out").join(near, ["a", "b"], "left").join(_spread(best), ["a", "lot"]).where(F.coalesce("similarity", F.lit(1.0)) <= F.col("best") + 1 - least + 1e-9)
        late = cut(_in_blocks(cut(placed.where("out").unionByName(inner.select(placed.columns))), texts, shared, least))
        if not late.isEmpty():
            classes = _united(classes, late)
    return classes


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, row: str | None = None) -> DataFrame:
    """One row per document: key, class_id (the least key of its class), class_size, kept.

    Null texts are empty. A text without words is alone in its class; one of one to four words makes a
    single shingle. Classes are of texts, so rows with a null key or of a repeated key are linked as any
    other and one row of each class is kept: of the least key, null last. row: a column that numbers the rows, stable from
    one reading to the next, which is passed on. Other columns are ignored.
    """
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(key).alias("__key"), number.alias("__row"), whole_text(text).alias("__text"))
    # written, so that every row keeps its number
    keyed = cut(word_digests(rows, "__text").drop("__text"))
    folded = _numbered(cut(word_digests(rows.select("__text"), "__text").where("digest IS NOT NULL").dropDuplicates(["digest"])))
    even = spark.sparkContext.broadcast(Sampler())
    signed = cut(signatures(folded.select("__id", "__text"), even, "__text"))
    buckets = _banded(signed)
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    classes = _linked(folded, signed, cut(buckets.join(crowded, "bucket")), even, least)

    # a class has a row for each text but its head
    total, size = folded.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    votes = total - classes.count()
    others = classes.select(F.col("id").alias("__id"), F.lit(False).alias("voter"))
    common = common_shingles(folded, total, "__text", folded.join(others, "__id", "left_anti"))
    ranked = spark.sparkContext.broadcast(Sampler(*common, max(votes, 1), least=1))
    voting = folded.select("__id", "__text").join(others, "__id", "left").withColumn("voter", F.coalesce("voter", F.lit(True)))
    rare = cut(rare_shingles(voting, ranked, "__text", size, total))
    if len(common[0]) or not rare.isEmpty():
        weighed = folded.join(rare, "__id", "left")
        again = cut(signatures(weighed.select("__id", "__text", "rare"), ranked, "__text", again=True))
        signed = signed.join(again.select("__id"), "__id", "left_anti")
        # written with their classes, so that the bands are laid out once
        marked = again.select("__id", "bands", F.lit(True).alias("again")).unionByName(signed.select("__id", "bands", F.lit(False).alias("again")))
        marked = marked.join(classes, F.col("__id") == F.col("id"), "left").select(F.col("__id").alias("id"), F.coalesce("class", "__id").alias("class"), "again", F.posexplode("bands").alias("band", "bucket"))
        marked = cut(marked)
        crowded = marked.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("again").alias("again")).where("low < high AND again").select("bucket")
        buckets = cut(marked.select("id", "band", "bucket").join(crowded, "bucket"))
        classes = _linked(weighed, again.unionByName(signed), buckets, ranked, least, classes)

    heads = cut(folded.join(classes, F.col("__id") == F.col("id"), "left").select("digest", F.coalesce("class", "__id").alias("__class")))
    placed = cut(keyed.where("digest IS NOT NULL").join(heads, "digest").select("__key", "__row", "__class"))
    best = F.min(F.struct(F.col("__key").isNull().alias("null"), F.col("__key").alias("key"), F.col("__row").alias("row"))).alias("__best")
    tops = cut(placed.groupBy("__class").agg(best, F.count("*").alias("__size")))
    own = [F.col("__key").alias(key), *([F.col("__row").alias(row)] if row else [])]
    linked = placed.join(tops, "__class").select(*own, F.col("__best.key").alias("class_id"), F.col("__size").alias("class_size"), (F.col("__row") == F.col("__best.row")).alias("kept"))
    alone = keyed.where("digest IS NULL").select(*own, F.col("__key").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, LABELS, docs, words
from tidemark.llm import packing
from tidemark.llm.quality import Machine, quality
from tidemark.llm.toxicity import Index, example_words, merge, parts_of, toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def test_toxicity_learns_and_takes_awkward_rows(spark):
    texts = [words(30, i) + (" you idiot moron" if i % 4 == 0 else "") for i in range(120)]
    df, labels = docs(spark, texts), labelled(spark, [(i, 1, int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (5, 1, None), (5000, 0, 1)])
    got = {r.doc_id: r for r in toxicity(df, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(80, 120)) and got[80].evidence
    assert toxicity(docs(spark, AWKWARD), labels).count() == len(AWKWARD)
    assert {r.score for r in toxicity(docs(spark, AWKWARD), labels.limit(0)).collect()} == {0.25}
    assert toxicity(docs(spark, []), labels).count() == 0
    # all of a row can be passed on
    whole = docs(spark, AWKWARD).withColumn("a b", F.lit(1)).select("doc_id", "text", F.struct("*").alias("all"))
    assert sorted(str(tuple(r.all)) for r in toxicity(whole, labels, row="all").collect()) == sorted(str(tuple(r.all)) for r in whole.collect())


def plain_neighbours(texts, labels, every):
    """Cosines of every text with the labelled ones over all words, by dictionaries."""
    import math
    import re
    from collections import Counter

    bags = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in every.items()}
    df = Counter(w for b in bags.values() for w in b)
    seen = Counter(w for i in labels for w in bags[i])
    good = Counter(w for i, y in labels.items() if y for w in bags[i])
    share = sum(labels.values()) / len(labels)
    weight = {w: math.log(1 + len(bags) / df[w]) * (1 + max((good[w] - n * share) / math.sqrt(n * share * (1 - share) + 4), 0)) for w, n in seen.items()}
    vector = lambda b: {w: (1 + math.log(n)) * weight.get(w, math.log(1 + len(labels))) for w, n in b.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = {i: vector(b) for i, b in bags.items()}
    out = {}
    for i, v in vectors.items():
        sims = [(round(sum(x * vectors[j].get(w, 0) for w, x in v.items()) / (length(v) * length(vectors[j])), 4), j) for j in labels if v and vectors[j]]
        out[i] = sorted((s for s, _ in sims if s > 0), reverse=True)[:3]
    return out


def test_toxicity_neighbours_over_whole_texts(spark):
    texts = [words(40 + i % 90, i % 70) + " " + words(20, 1000 + i % 9) + (" you idiot moron" if i % 4 == 0 else "") for i in range(160)]
    df, rows = docs(spark, [*texts, "", None, "unheard of"]), [(i, 1, int(i % 4 == 0)) for i in range(90)]
    labels = labelled(spark, rows)
    want = plain_neighbours(texts, {i: y for i, _, y in rows}, dict(enumerate([*texts, "", None, "unheard of"])))
    one = {r.doc_id: r for r in toxicity(df, labels).collect()}
    for i, sims in want.items():
        have = [float(e.rpartition(":")[2]) for e in one[i].evidence.split(",") if e]
        # equal vectors are one entry, so a text's neighbours are those of its different cosines or more
        assert len(have) == len(sims) == 0 or abs(have[0] - sims[0]) < 2e-4 and set(np.round(have, 3)) <= {x for s in plain_all(texts, rows, i) for x in (round(s - 0.001, 3), round(s, 3), round(s + 0.001, 3))}
    assert one[160].evidence == one[161].evidence == one[162].evidence == "" and one[160].score == one[162].score
    # indexes of few postings each find the same
    many = {r.doc_id: r for r in toxicity(df, labels, postings=900).collect()}
    sims = lambda r: [float(e.rpartition(":")[2]) for e in r.evidence.split(",") if e]
    assert all(np.allclose(sims(many[i]), sims(one[i]), atol=2e-4) for i in one)
    assert max(abs(many[i].score - one[i].score) for i in one) < 1e-3


def test_toxicity_examples_are_bounded_by_their_words(spark):
    texts = [words(50, i) + (" you idiot moron" if i % 2 else "") for i in range(60)] + [words(3000, 500)]
    df = docs(spark, texts).select("doc_id", "text", F.lit(1).alias("label")).withColumnsRenamed({"doc_id": "__id", "text": "__text"})
    every, some, none = (example_words(df, n) for n in (10**6, 900, 1))
    assert len(every[0]) == 61 and sum(map(len, some[2])) <= 900 and 5 < len(some[0]) < 61 and set(some[0]) <= set(every[0]) and none[0] == []
    labels = labelled(spark, [(i, 1, i % 2) for i in range(60)])
    assert toxicity(docs(spark, texts), labels, most_words=900).count() == 61 and {r.score for r in toxicity(docs(spark, texts), labels, most_words=1).collect()} == {0.25}


def plain_all(texts, rows, i, held={}):  # noqa: B006
    if not held:
        import math
        import re
        from collections import Counter

        labels = {k: y for k, _, y in rows}
        bags = [Counter(re.findall(r"[^\W_]+", t.lower())) for t in texts]
        df = Counter(w for b in bags for w in b)
        seen, good = Counter(w for k in labels for w in bags[k]), Counter(w for k, y in labels.items() if y for w in bags[k])
        share = sum(labels.values()) / len(labels)
        weight = {w: math.log(1 + (len(bags) + 3) / df[w]) * (1 + max((good[w] - n * share) / math.sqrt(n * share * (1 - share) + 4), 0)) for w, n in seen.items()}
        vectors = [{w: (1 + math.log(n)) * weight.get(w, math.log(1 + len(labels))) for w, n in b.items()} for b in bags]
        lengths = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
        held["sims"] = [{sum(x * vectors[j].get(w, 0) for w, x in v.items()) / (a * lengths[j]) for j in labels} for v, a in zip(vectors, lengths, strict=True)]
    return held["sims"][i] if i < len(texts) else ()


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    vectors, dense = [], np.zeros((900, 60), np.float32)
    for k in range(900):
        at = np.sort(rng.choice(60, rng.integers(1, 8), replace=False) if k % 3 else rng.choice(4, 2, replace=False))
        vectors.append((at, rng.random(len(at)).astype(np.float32)))
        dense[k, at] = vectors[-1][1]
    for index in (Index(vectors, 60), Index(vectors[:500], 60)):
        for at, w in vectors[::7]:
            sims = np.round(dense[: index.n, at] @ w, 6)
            want = np.lexsort((np.arange(index.n), -sims))[:32]
            ids, found = index.nearest(at, w)
            assert np.allclose(found, sims[want][sims[want] > 0], atol=2e-6) and len(set(ids.tolist())) == len(ids)
    parts = [Index(vectors[a:b], 60, a) for a, b in parts_of(vectors, 700)]
    assert len(parts) > 3
    for at, w in vectors[::50]:
        assert np.allclose(merge([p.nearest(at, w) for p in parts])[1], Index(vectors, 60).nearest(at, w)[1], atol=2e-6)


def test_quality_learns_and_takes_awkward_rows(spark):
    texts = [words(60, i) if i % 3 else " | ".join(words(60, i).split()) for i in range(150)]
    df, labels = docs(spark, texts), labelled(spark, [(i, int(i % 3 > 0), 0) for i in range(100)])
    got = {r.doc_id: r.predicted for r in quality(df, labels).collect()}
    assert sum(got[i] == int(i % 3 > 0) for i in range(100, 150)) >= 48
    assert quality(docs(spark, AWKWARD), labels, metadata=("lang", "source")).count() == len(AWKWARD)
    assert {r.score for r in quality(docs(spark, AWKWARD), labels.limit(0)).collect()} == {0.5}
    assert quality(docs(spark, []), labels).count() == 0


def test_quality_query_holds_out_a_third(spark, tmp_path):
    import zlib

    from tidemark.llm.queries import QUERIES

    texts = [words(50, i) if i % 3 else " | ".join(words(50, i).split()) for i in range(120)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    # labels of the held-out third are turned round: they must not matter
    labelled(spark, [(i, int(i % 3 > 0), 0) for i in range(120)]).write.parquet(str(tmp_path / "labels.parquet"))
    one = {r.doc_id: r for r in QUERIES["op5_quality"](spark, str(tmp_path)).collect()}
    labelled(spark, [(i, int((i % 3 > 0) != (fold(i) == 1)), 0) for i in range(120)]).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    two = {r.doc_id: r for r in QUERIES["op5_quality"](spark, str(tmp_path)).collect()}
    assert all(one[i].held_out == (fold(i) == 1) and one[i].score == two[i].score and one[i].predicted == int(one[i].score >= 0.5) for i in range(120))


def test_toxicity_query_holds_out_a_fifth(spark, tmp_path):
    import zlib

    from tidemark.llm.queries import QUERIES

    texts = [words(30, i) + (" you idiot moron" if i % 4 == 0 else "") for i in range(100)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    labelled(spark, [(i, 1, int(i % 4 == 0)) for i in range(100)]).write.parquet(str(tmp_path / "labels.parquet"))
    one = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()}
    labelled(spark, [(i, 1, int((i % 4 == 0) != (fold(i) == 0))) for i in range(100)]).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    two = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()}
    assert all(one[i].held_out == (fold(i) == 0) and one[i].score == two[i].score and one[i].predicted == int(one[i].score >= 0.5) for i in range(100))
    assert all(str(fold(int(e.split(":")[0]))) != "0" for r in one.values() for e in r.evidence.split(",") if e)


def test_linear_time_form_equals_pairs():
    rng = np.random.default_rng(1)
    machine = Machine()
    machine.v = rng.normal(size=machine.v.shape)
    machine.w = rng.normal(size=machine.w.shape)
    at, x = rng.choice(1000, 12, replace=False), rng.random(12)
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(machine.raw(at, x, np.array([12]))[0][0], machine.w0 + machine.w[at] @ x + pairs)


def test_packing_places_every_token_once(spark):
    texts = [words(n, n) for n in (1, 5, 700, 3000, 9000, 40, 40, 41, 500, 511, 512, 513)]
    rows = packing.best_fit(docs(spark, [*AWKWARD, *texts]), lengths=(512, 1024, 4096)).collect()
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_tokens), []).append((r.position, r.position + r.n_tokens))
    for (_, capacity), spans in bins.items():
        spans.sort()
        assert capacity in (512, 1024, 4096) and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        used = spans[-1][1]
        assert capacity == min(c for c in (512, 1024, 4096) if c >= used)
    sizes = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id >= 15:
            sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    assert len({r.bin_id for r in rows}) == len(bins)
    assert len(rows) >= len(AWKWARD) + len(texts) and packing.best_fit(docs(spark, [])).count() == 0


def test_packing_spreads_null_and_repeated_keys(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    rows = packing.best_fit(df, shard=3000).select("doc_id", "n_tokens", F.split("bin_id", "-")[0].alias("shard"), "bin_id", "bin_tokens", "position")
    sizes = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 30000 and max(sizes) < 3000 * 1.1
    full = rows.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max("bin_tokens").alias("room")).where("n > room").count()
    assert full == 0 and rows.where("doc_id IS NULL").count() == 10000


def test_best_fit_against_a_plain_scan():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 513, 400)
    where, offset, capacity = packing.pack(sizes, (512,))
    rooms, want = [], np.zeros(400, int)
    for i in np.argsort(-sizes, kind="stable"):
        fit = [(r, b) for b, r in enumerate(rooms) if r >= max(sizes[i], 1)] if sizes[i] else [(r, b) for b, r in enumerate(rooms) if r > 0]
        if not fit:
            rooms.append(512)
            fit = [(512, len(rooms) - 1)]
        r, b = min(fit)
        rooms[b] -= sizes[i]
        want[i] = b
    assert len(set(where)) == len(rooms) and (capacity == 512).all()


def total_cost(where, capacity):
    return sum(packing.bin_cost(int(capacity[list(where).index(b)])) for b in set(where.tolist()))


def test_lengths_are_chosen_jointly():
    rng = np.random.default_rng(9)
    used = set()
    for sizes in (rng.integers(1, 4097, 300), rng.integers(1, 400, 500), np.minimum(rng.lognormal(6, 1.2, 600).astype(int) + 1, 4096), np.full(64, 1025), np.array([4096, 1, 1, 600, 600])):
        where, offset, capacity = packing.pack(sizes)
        used |= set(capacity.tolist())
        joint = total_cost(where, capacity)
        for c in packing.LENGTHS:
            w, _, final = packing._pack(sizes, packing.LENGTHS, packing.OVERHEAD, packing.ATTENTION, c)
            assert joint <= total_cost(w, final) + 1e-6
    assert len(used) >= 3


def test_small_packings_near_the_best_there_is():
    from functools import cache

    rng = np.random.default_rng(10)
    ratio = []
    for _ in range(25):
        sizes = rng.integers(1, 13, 7)

        @cache
        def best(left):
            """The least cost of packing the pieces of a bit set, over all groupings and bin sizes."""
            if not left:
                return 0.0
            first = left & -left
            out, sub = float("inf"), left
            while sub:
                if sub & first:
                    held = sum(int(sizes[i]) for i in range(7) if sub >> i & 1)  # noqa: B023
                    if held <= 12:
                        out = min(out, packing.bin_cost(min(c for c in (4, 6, 8, 12) if c >= held), 2.0, 0.05) + best(left & ~sub))  # noqa: B023
                sub = (sub - 1) & left
            return out

        where, _, capacity = packing.pack(sizes, (4, 6, 8, 12), 2.0, 0.05)
        have = sum(packing.bin_cost(int(capacity[list(where).index(b)]), 2.0, 0.05) for b in set(where.tolist()))
        ratio.append(have / best(127))
    assert min(ratio) >= 1 - 1e-9 and np.mean(ratio) < 1.05 and max(ratio) < 1.2

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs, words
from tidemark.llm.exact_dedup import drop_duplicates, exact_duplicates
from tidemark.llm.near_dedup import WIDTH, connected, near_duplicates

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def test_exact_awkward_rows(spark):
    df = docs(spark, AWKWARD)
    got = exact_duplicates(df).collect()
    assert len(got) == len(AWKWARD)
    groups = {}
    for r in df.collect():
        groups.setdefault((r.text or "").translate(WHITE), []).append(r)
    want = {}
    for bare, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id))
        for r in rows:
            want.setdefault(r.doc_id, []).append((hashlib.sha256(bare.encode()).hexdigest(), keep.doc_id, len(rows)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.text_sha256, r.keep_id, r.group_size))
    key = lambda t: str(t)
    assert {k: sorted(v, key=key) for k, v in have.items()} == {k: sorted(v, key=key) for k, v in want.items()}


def test_exact_empty_table(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    assert drop_duplicates(docs(spark, [])).count() == 0


def test_drop_keeps_one_row_of_each(spark):
    df = docs(spark, AWKWARD)
    kept = drop_duplicates(df)
    assert kept.columns == df.columns
    bare = [(r.text or "").translate(WHITE) for r in kept.collect()]
    assert len(bare) == len(set(bare)) == len({(t[1] if isinstance(t, tuple) else t or "").translate(WHITE) if (t[1] if isinstance(t, tuple) else t) else "" for t in AWKWARD})


def test_exact_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a copy").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(40)
    got = exact_duplicates(df).where("group_size > 1").agg(F.count("*"), F.max("group_size"), F.min("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1000, 1000, 0, 1)


def test_near_awkward_rows(spark):
    got = near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.class_id == i for i in (0, 1, 2) for r in by[i]) and all(r.class_id == 12 for r in by[13])
    assert near_duplicates(docs(spark, [])).count() == 0
    assert near_duplicates(docs(spark, [None, ""])).count() == 2


def edited(text, share, seed):
    rng, out = random.Random(seed), text.split()
    for k in range(len(out)):
        if rng.random() < share:
            out[k] = words(1, seed * 7919 + k)
    return " ".join(out)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_all_pairs(spark, seed):
    texts = [words(80, 100 + i) for i in range(30)]
    texts += [edited(texts[i % 10], 0.005 * (i % 6), seed * 1000 + i) for i in range(60)] + [texts[3]] * 20
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    # pairs are counted with the weights that the operator states: frequencies over different texts, full
    # weight up to half of them
    import math

    df, n = {}, len(texts)
    different = {tuple(t.lower().split()): s for t, s in zip(texts, sets, strict=True)}
    for s in different.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    w = {x: 1 + math.log(len(different) / max(c, len(different) / 2)) for x, c in df.items()}
    sure, maybe = list(parent), []
    for i in range(n):
        for j in range(i):
            low = sum(w[x] for x in sets[i] & sets[j])
            s = low / (sum(w[x] for x in sets[i]) + sum(w[x] for x in sets[j]) - low)
            if s >= 0.8 - 1e-9:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    del sure, maybe
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: top(i) for i in range(n)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["class"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for v in parent if top(v) != v}


def plain(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def replaced(text, at):
    out = text.split()
    for k, word in at.items():
        out[k] = word
    return " ".join(out)


def test_near_group_of_a_third(spark):
    # each copy has two words of its own, so two copies of the group share 80 to 88 of a hundred shingles
    base = words(110, 77)
    group = [replaced(base, {0: f"first{i}", 30 + i: f"own{i}"}) for i in range(20)]
    assert all(0.8 < plain(a, b) < 0.884 for a in group for b in group if a != b)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, [*group, *(words(100, 500 + i) for i in range(40))])).collect()}
    assert got == {i: 0 if i < 20 else i for i in range(60)}


def test_near_edit_of_a_text_that_is_copied_exactly(spark):
    base = words(100, 78)
    edit = replaced(base, {20: "one", 50: "two"})
    texts = [base] * 30 + [edit] + [words(100, 600 + i) for i in range(59)]
    assert 0.8 < plain(base, edit) < 0.85
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: 0 if i <= 30 else i for i in range(90)}


def test_near_classes_are_of_texts_and_not_of_keys(spark):
    a, b = words(60, 80), words(60, 81)
    # a repeated key with two texts doesn't join their classes, and a null key is linked as any other
    texts = [(7, a), (7, b), (8, a.upper()), (9, b.upper()), (None, words(60, 82)), (None, words(60, 82).upper()), (None, a + " more")]
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in near_duplicates(docs(spark, texts)).collect())
    assert got == sorted([("7", "7", 3, True), ("7", "7", 2, True), ("8", "7", 3, False), ("9", "7", 2, False), ("None", "None", 2, True), ("None", "None", 2, False), ("None", "7", 3, False)])


def test_of_equal_rows_the_same_one_stays_for_any_partitioning(spark):
    from tidemark.llm.exact_dedup import drop_duplicates

    df = docs(spark, [(3, "a b\tc"), (3, "a\tb c"), (3, "a\nb c"), (3, "x"), (None, "y z"), (None, "y\tz"), (5, "a bc")])
    seen = {tuple(sorted(map(repr, ((r.doc_id, r.text) for r in drop_duplicates(df.repartition(n)).collect())))) for n in (1, 3, 7)}
    assert len(seen) == 1 and len(next(iter(seen))) == 3


def test_near_texts_that_differ_in_what_most_texts_hold(spark):
    notice, own = words(36, 90), words(90, 91)
    texts = [f"{own} {notice}", own, *(f"{words(60, 700 + i)} {notice}" for i in range(40)), *(words(60, 800 + i) for i in range(20))]
    assert plain(texts[0], texts[1]) < 0.75
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: 0 if i <= 1 else i for i in range(62)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_with_counts_against_all_pairs_under_both_weightings(spark, seed):
    notices = [words(n, 900 + n) for n in (12, 25, 40)]
    rng, texts = random.Random(seed), []
    for i in range(24):
        base = f"{words(70, seed * 100 + i)} " + " ".join([words(4, 950 + i % 5)] * (2 + i % 7))
        texts += [" ".join([base, *(n for n in notices if rng.random() < 0.5)]) for _ in range(2)]
    texts = list(dict.fromkeys(texts))
    sets = [Counter(shingles_of(t)) for t in texts]

    def classes(idf):
        parent = list(range(len(texts)))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for w in idf:
            for i in range(len(texts)):
                for j in range(i):
                    low, high = (sum(w(x) * f(sets[i][x], sets[j][x]) for x in sets[i] | sets[j]) for f in (min, max))
                    if low >= (0.8 - 1e-9) * high:
                        a, b = top(i), top(j)
                        parent[max(a, b)] = min(a, b)
        return [top(i) for i in range(len(texts))]

    even = classes([lambda x: 1.0])
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()}
    want = set()
    # a class votes once, by one of its texts: whichever it is, the classes are the same here
    for last in (False, True):
        voters = {c: i for i, c in (enumerate(even) if last else reversed(list(enumerate(even))))}.values()
        df = Counter(x for i in voters for x in sets[i])
        want.add(tuple(classes([lambda x: 1.0, lambda x: 1 + math.log(len(voters) / max(df[x], 1))])))
    assert len(want) == 1 and want != {tuple(even)}
    assert [got[i] for i in range(len(texts))] == list(*want)


def shingles_of(text):
    w = text.lower().split()
    return [tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))]


def test_common_shingles_are_counted_exactly(spark):
    import numpy as np

    from tidemark.llm.near_dedup import Sampler, common_shingles

    # of 500 texts, one in 10, in 50 and in 125 hold a phrase; a share of 1 in 125 isn't common
    phrases = {10: words(5, 30), 50: words(5, 31), 125: words(5, 32)}
    texts = [" ".join([words(5, 1000 + i), *(p for n, p in phrases.items() if i % n == 0)]) for i in range(500)]
    found, counts = common_shingles(docs(spark, texts), 500)
    # where two phrases meet there are four more in ten texts
    assert sorted(counts.tolist()) == [10] * 5 + [50]
    sampler = Sampler(found, counts, 500)
    w = sampler.weights(found[[counts.argmax()]], np.ones(1))
    assert w[0] == pytest.approx((1 + math.log(10)) / (1 + math.log(100)))


def test_edges_through_leaders_are_about_as_many_as_members(spark):
    from tidemark.llm.near_dedup import _through_leaders

    # 400 members, each found by five of eight leaders, and one pair besides
    links = [(k, 100 + i) for i in range(400) for k in range(8) if (i + k) % 8 < 5] + [(900, 901)]
    df = spark.createDataFrame(links, "a long, b long")
    edges = {(r.a, r.b) for r in _through_leaders(df).collect() if r.a != r.b}
    assert len(links) == 2001 and len(edges) <= 401 + 8 * 7
    got = {r["id"]: r["class"] for r in connected(_through_leaders(df)).collect()}
    assert got == {v: 0 for v in (*range(1, 8), *range(100, 500))} | {901: 900}


def test_links_join_classes_and_not_their_members(spark):
    from tidemark.llm.near_dedup import _dealt, _merged

    # stars of 5 and 20 with 300 members each, a pair, and texts alone; of the links some stay inside a class
    classes = [(1000 + i, 5) for i in range(300)] + [(2000 + i, 20) for i in range(300)] + [(31, 30)]
    links = [(1000, 1000 + i) for i in range(1, 300)] + [(1007, 2009), (2009, 40), (50, 30), (31, 51)]
    dealt = _dealt(spark.createDataFrame(links, "a long, b long"))
    got = {r["id"]: r["class"] for r in _merged(spark.createDataFrame(classes, "id long, class long"), dealt).collect()}
    assert got == {m: 5 for m in (20, 40, *range(1000, 1300), *range(2000, 2300))} | {31: 30, 50: 30, 51: 30}


def test_blocks_give_edges_between_classes_and_not_members(spark):
    import numpy as np

    from tidemark.llm.near_dedup import Sampler, _forest, _in_blocks

    pairs = np.array([(i, j) for i in range(6) for j in range(i + 1, 6)])
    assert sorted(_forest(pairs, [7, 7, 9, 4, 9, 7])) == [(7, 4), (9, 4)] and _forest(pairs, [3] * 6) == []
    # 600 members that are out, of two classes, and 300 in a third; in each class texts of the other two are met
    base = words(60, 5)
    members = [(1, k, (100, 200, 300)[k % 3], 0, 1, k % 3 < 2) for k in range(900)]
    groups = spark.createDataFrame(members, "a long, b long, class long, lot int, lots int, out boolean")
    texts = spark.createDataFrame([(k, f"{base} {words(2, 1000 + k)}") for k in range(900)], "__id long, __text string")
    found = _in_blocks(groups, texts, spark.sparkContext.broadcast(Sampler()), 0.8)
    assert {(r.a, r.b) for r in found.collect()} == {(200, 100), (300, 100)} and found.count() == 2


def test_a_medoid_comes_from_the_whole_group_in_one_lot_or_many(spark):
    import numpy as np

    from tidemark.llm.near_dedup import CHUNK, _medoids

    # one member has what all share, most differ from it at eight places of their own, one at every place
    rows, samples, rng = [], [], np.random.default_rng(3)
    for a, n, lots in ((10_000, 9, 1), (20_000, 100, 1), (30_000, 3 * CHUNK, 3)):
        for k in range(n):
            same = np.arange(64, dtype=np.uint32)
            at = rng.permutation(64)[: {0: 64, 1: 0}.get(k, 8)]
            same[at] = rng.integers(1 << 20, 1 << 30, len(at))
            rows.append((a, a + k, k % lots, lots))
            samples.append((a + k, bytearray(same.tobytes())))
    groups = spark.createDataFrame(rows, "a long, b long, lot int, lots int")
    got = {r.a: r.m for r in _medoids(groups, spark.createDataFrame(samples, "__id long, samples binary")).collect()}
    assert got == {a: a + 1 for a in (10_000, 20_000, 30_000)}


def test_shingles_of_a_block_are_those_of_each_text():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.near_dedup import Sampler, _places, _sets_of
    from tidemark.llm.tokens import buffers, shingles
    from tidemark.llm.tokens import words as split

    texts = ["", "One", "two words", "a b c d", "a b c d e", " ".join(["again and"] * 9), None, words(90, 3), words(6, 4)]
    for (found, counts), text in zip(_sets_of(pa.array(texts)), texts, strict=True):
        data, offsets = buffers(pa.array([(text or "").lower()]))
        want = np.unique(shingles(split(data, offsets)[2], WIDTH), return_counts=True)
        assert (found == want[0]).all() and (counts == want[1]).all() and len(found) == len(want[0])
    values = np.array([3, 7, 9], np.uint64)
    hit, at = _places(values, np.array([9, 1, 10, 3, 9], np.uint64))
    assert hit.tolist() == [True, False, False, True, True] and at.tolist() == [2, 0, 2]
    sampler = Sampler(values, np.array([50, 60, 70]), 1000)
    assert sampler.has_common(values[1:2]) and not sampler.has_common(np.array([8], np.uint64)) and not sampler.has_common(values[:0])


def test_near_texts_that_differ_in_what_few_texts_hold(spark):
    # a notice in five of 600 texts, under one in a hundred, weighs less than what two or one have
    notice, own = words(27, 92), words(104, 93)
    texts = [f"{own} {notice}", own, *(f"{words(60, 2000 + i)} {notice}" for i in range(4)), *(words(60, 3000 + i) for i in range(594))]
    idf = {n: 1 + math.log(600 / n) for n in (1, 2, 5)}
    assert plain(texts[0], texts[1]) < 0.79 and 100 * idf[2] > 0.8 * (100 * idf[2] + 23 * idf[5] + 4 * idf[1])
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: 0 if i <= 1 else i for i in range(600)}


def test_rare_shingles_are_counted_exactly_and_come_back_to_their_texts(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import near_dedup

    # several parts, homes and turns of a task; one phrase is in all texts and left out as common, texts by fours don't vote
    rng, phrases = random.Random(4), [words(9, 40 + k) for k in range(60)]
    texts = [" ".join([words(5, 39), words(6, 4000 + i), *rng.sample(phrases, i % 4)]) for i in range(300)]
    sets = [f for f, _ in near_dedup._sets_of(pa.array(texts))]
    common = near_dedup._sets_of(pa.array([words(5, 39)]))[0][0]
    df = Counter(x for i, s in enumerate(sets) if i % 4 != 1 for x in s.tolist())
    want = {i: {x: df[x] for x in s.tolist() if df[x] > 1 and x not in common} for i, s in enumerate(sets)}
    shared = spark.sparkContext.broadcast(near_dedup.Sampler(common, np.array([300]), 300, least=1))
    rows = spark.createDataFrame([(i, t, i % 4 != 1) for i, t in enumerate(texts)], "__id long, __text string, voter boolean")
    for part, home, held in ((10**7, 4096, 10**6), (5000, 40, 700)):
        monkeypatch.setattr(near_dedup, "PART", part), monkeypatch.setattr(near_dedup, "HOME", home), monkeypatch.setattr(near_dedup, "HELD", held)
        got = {r["__id"]: np.frombuffer(r.rare, np.uint64).reshape(2, -1) for r in near_dedup.rare_shingles(rows, shared, "__text", sum(map(len, texts)), 300).collect()}
        assert {i: dict(zip(*v.tolist(), strict=True)) for i, v in got.items()} == {i: w for i, w in want.items() if w}
        assert all((v[0][1:] > v[0][:-1]).all() for v in got.values())

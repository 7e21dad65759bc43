"""Merkle manifests, byte shards and collocations, against plain restatements and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs, words
from tidemark.llm import collocations as col
from tidemark.llm.common import fold
from tidemark.llm.merkle import FANOUT, manifest
from tidemark.llm.ordering import placed
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.sharding import shards


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_byte_shards", "op13_collocations"])
def test_whole_table_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    theirs, ours = con.sql(ORACLES[name]), QUERIES[name](spark, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(map(repr, (tuple(r[c] for c in theirs.columns) for r in ours.collect()))) == sorted(map(repr, theirs.fetchall()))


def tree(nodes):
    """Levels of a plain tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(last), FANOUT)])
    return levels


def proof(levels, at):
    steps = []
    for level in levels[:-1]:
        a = at // FANOUT * FANOUT
        steps.append(("".join(level[a:at]), "".join(level[at + 1 : a + FANOUT])))
        at //= FANOUT
    return steps


def plain_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded)} with multiplicity, as a sorted list."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: hashlib.sha256("".join(map(said, r)).encode()).hexdigest()
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by = {}
    for r in rows:
        bad = zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 == 0
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0], leaf((*r[:4], low(r[4]))) if bad else leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, digest, key, shown) in enumerate(sorted(by[s])):
            steps = proof(trees[s], i) + proof(top, k)
            node = shown
            for left, right in steps:
                node = hashlib.sha256((left + node + right).encode()).hexdigest()
            joined = hashlib.sha256("".join(a + b for a, b in steps).encode()).hexdigest()
            out.append((key, digest, trees[s][-1][0], top[-1][0], joined, node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_against_a_plain_tree(spark):
    rng = random.Random(1)
    source = lambda i: rng.choice([None, "", "a", "a", "a", "é", "Z", "hot", "hot", "hot", "hot"])
    rows = [(i, source(i), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "Some TEXT ÄÖ", words(9, i)])) for i in range(700)]
    rows += [(900 + i, f"lone{i}", "en", 1, "Text") for i in range(300)] + [(5, "a", "x", 1, "again"), (None, "a", "x", 1, "KEYLESS"), (None, "a", "x", 1, "KEYLESS"), (7, "hot", "x", 1, "L" * 300000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for clash in ("tree", "digest", "node", "path", "run"):
        df = df.withColumn(clash, F.lit(1))
    got = [tuple(r) for r in manifest(df, tampered=fold("doc_id", 5) == 0).collect()]
    want = plain_manifest(rows)
    assert sorted(got, key=repr) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_manifests_of_few_rows(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(r) for r in manifest(df, tampered=fold("doc_id", 5) == 0).collect()), key=repr) == plain_manifest(rows)


def test_places_of_many_equal_rows(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"), F.lit(0).alias("k"), (F.col("id") % 5).alias("s"))
    got = placed(rows, [F.col("g"), F.col("k")], ("g",), "s")
    seen = got.groupBy("g").agg(F.count_distinct("__pos").alias("d"), F.max("__pos").alias("m"), F.count("*").alias("n"), F.max("__all").alias("all"), F.max(F.col("__before") + F.col("s")).alias("last"), F.sum("s").alias("sum")).collect()
    assert all(r.d == r.n == r.m + 1 == r["all"] and r.last == r["sum"] for r in seen) and len(seen) == 8


def test_shards_against_a_plain_sum(spark):
    texts = [*AWKWARD, *[words(random.Random(i).randint(1, 80), i) for i in range(400)], *["copy of a text"] * 300]
    df = docs(spark, texts).withColumns({c: F.lit(1) for c in ("shard", "size", "slot")})
    got = shards(df).collect()
    size = lambda t: len((t or "").encode()) + 1
    told = [(t[0], t[1]) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t in told)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    total, before, slots = sum(r.size for r in got), 0, Counter()
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.shard == (2 * before + r.size) * 8 // (2 * total) and r.slot == slots[r.shard]
        before, slots[r.shard] = before + r.size, slots[r.shard] + 1
    keys = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert keys == sorted(keys)
    assert shards(docs(spark, [])).count() == 0 and shards(docs(spark, [None])).first().shard == 4


def plain_counts(rows):
    counts = {}
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            w = re.findall("[^ \t]+", piece)
            for m in (1, 2, 3):
                counts.setdefault(("und" if lang is None else lang, m), Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return counts


def plain_collocations(rows, most=2000):
    counts, out = plain_counts(rows), []
    for lang in {k[0] for k in counts}:
        one, two, three = (counts[lang, m] for m in (1, 2, 3))
        f, found = {**one, **two, **three}, []
        long = {w: n for w, n in three.items() if n >= 10}
        for w, a in [*two.items(), *three.items()]:
            if a < 10 or len(w) == 2 and any(w in (v[:2], v[1:]) and 100 * n >= 50 * a for v, n in long.items()):
                continue
            s, _, left, right = min((1000000 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            found.append((-s, -a, " ".join(w).encode(), left, right))
        n = sum(one.values())
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def awkward_rows():
    rng = random.Random(3)
    pool = ["Alpha", "BETA", "gamma", "delta x", "Éa", "the", "the", "the", "of", "z\x00z", "a-b", "🙂"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(pool) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    hot = [("en", "the the the the")] * 200 + [("en", "New York City")] * 40 + [("en", "new york")] * 30 + [("de", None), ("de", ""), (None, " \t.")]
    long = [("en", " ".join(rng.choice(pool[:7]) for _ in range(30000))), ("de", "x" * 50000), ("de", " ".join(rng.choice("ab") + rng.choice([",", ""]) for _ in range(5000)))]
    return rows + hot + long


@pytest.mark.parametrize("buckets,chunk", [(64, 1 << 20), (1 << 12, 500), (1 << 20, 37)])
def test_collocations_against_plain_counts(spark, buckets, chunk):
    rows = awkward_rows()
    df = spark.createDataFrame([(i, *r, 1.0, "q") for i, r in enumerate(rows)], "doc_id long, lang string, text string, score double, phrase string").repartition(7)
    got = sorted(tuple(r) for r in col.collocations(df, buckets=buckets, chunk=chunk).collect())
    want = plain_collocations(rows)
    assert got == want and len(want) > 50
    few = sorted(tuple(r) for r in col.collocations(df, buckets=buckets, most=3).collect())
    assert few == plain_collocations(rows, 3)


def test_long_texts_are_cut_without_loss():
    text = b"".join(bytes([random.Random(i).choice(b"ab  \xff")]) for i in range(5000)) + b"c" * 300 + b" d e f"
    for chunk in (1, 7, 64, 999):
        for n in (1, 2, 3):
            grams = Counter()
            for part, repeat in col.pieces(text, chunk):
                w = col.Words("en", [repeat + part])
                where, found = w.grams(n)
                for row in found[where + n > len(repeat.split())].tolist():
                    grams[b" ".join(w.words[i] for i in row)] += 1
            plain = Counter()
            for piece in text.split(b"\xff"):
                v = piece.split()
                plain.update(b" ".join(v[i : i + n]) for i in range(len(v) - n + 1))
            assert grams == plain


def test_scores_of_large_counts_are_exact(spark):
    big = [(10**15 + 7, 10**15 + 11, 10**15 + 13), (12345678901234, 99999999999999, 12345678901235)]
    for a, left, right in big:
        one = [spark.createDataFrame([("en", "p", left), ("en", "q", right)], "lang string, phrase string, a long"), spark.createDataFrame([("en", "p q", a)], "lang string, phrase string, a long")]
        assert col.closest_cuts(one).first().score == 10**6 * a * a // (left * right)


def test_collocations_of_no_rows(spark):
    assert col.collocations(docs(spark, []), buckets=64).count() == 0 and col.collocations(docs(spark, [None, "", "one"]), buckets=64).count() == 0

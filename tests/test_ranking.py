"""Ranking gradients against all pairs, and trees that learn from them."""

import math
import random

from pyspark.sql import functions as F

from tidemark.operators import boosting, ranking


def groups(seed, n=8, size=9):
    rng = random.Random(seed)
    return [(g, i, round(rng.gauss(0, 1), 1), rng.choice([0, 0, 1, 2]) if g != 3 else 0) for g in range(n) for i in range(size + g)] + [(99, 0, 1.0, 1)]


def plain(rows, k):
    """Every pair of a group."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        rank = {r[1]: n for n, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1])), 1)}
        discount = lambda n: 1 / math.log2(n + 1) if n <= k else 0.0
        ideal = sum((2**r[3] - 1) * discount(n) for n, r in enumerate(sorted(own, key=lambda r: -r[3]), 1))
        for r in own:
            out[g, r[1]] = [0.0, 0.0]
        for a in own:
            for b in own:
                if a[3] > b[3]:
                    swap = abs((2 ** a[3] - 2 ** b[3]) * (discount(rank[a[1]]) - discount(rank[b[1]]))) / ideal
                    p = 1 / (1 + math.exp(a[2] - b[2]))
                    out[g, a[1]][0] += p * swap
                    out[g, b[1]][0] -= p * swap
                    for r in (a, b):
                        out[g, r[1]][1] += p * (1 - p) * swap
    return out


def test_gradients_against_all_pairs(spark):
    rows = groups(1)
    df = spark.createDataFrame(rows, "g int, i int, f double, y int").withColumnRenamed("g", "grp")
    for k in (1, 3, 50):
        got = {(r.grp, r.i): (r.g, r.h) for r in ranking.lambdas(df, ["grp"], "i", "f", "y", k).collect()}
        want = plain(rows, k)
        assert set(got) == set(want) and all(abs(a - b) < 1e-9 for key in got for a, b in zip(got[key], want[key], strict=True))


def test_ndcg_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 3.0, 0), (0, 1, 2.0, 2), (0, 2, 1.0, 1), (1, 0, 1.0, 0)], "g int, i int, s double, y int")
    r = ranking.ndcg(df, ["g"], "i", "s", "y", 2).first()
    assert r.groups == 1 and abs(r.ndcg - (3 / math.log2(3)) / (3 + 1 / math.log2(3))) < 1e-12


def test_ranking_beats_a_classifier_where_levels_differ(spark):
    # how likely events are is mostly the group's doing, which a ranking within groups has no use for
    rng, rows = random.Random(2), []
    for g in range(80):
        level = rng.gauss(0, 1)
        for i in range(8):
            a = rng.gauss(0, 1)
            rows.append((g, i, level, a, int(rng.random() < 1 / (1 + math.exp(-(2.5 * level + 1.0 * a))))))
    df = spark.createDataFrame(rows, "grp int, i int, a double, b double, y int").withColumn("all", F.lit("all"))
    train, test = df.where("grp < 50"), df.where("grp >= 50")
    more = dict(trees=3, depth=1, rate=0.5, least=5, bins=16)
    ranker = boosting.fit(train, ["a", "b"], "y", ranking.lambda_loss(["grp"], "i", 3), "all", ("grp", "i"), **more)
    events = boosting.fit(train, ["a", "b"], "y", boosting.log_loss(), "all", **more)
    out = boosting.score(boosting.score(test, ranker, "all", "r"), events, "all", "e")
    by_rank, by_event = (ranking.ndcg(out, ["grp"], "i", c, "y", 3).first().ndcg for c in "re")
    assert by_rank > by_event + 0.05

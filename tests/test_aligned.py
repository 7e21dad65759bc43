"""Clusters aligned over dates against trying every labelling, and amounts as people write them."""

import datetime as dt
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import amount_from_text
from tidemark.operators import aligned, learning


def test_labels_against_all_labellings(spark):
    rng = random.Random(1)
    truth, rows = {n: rng.randrange(3) for n in range(20)}, []
    for t in range(12):
        for n in list(truth):
            if rng.random() < 0.1:
                truth[n] = rng.randrange(3)
        names = rng.sample(range(3), 3)
        rows += [(dt.date(2024, 1, 1) + dt.timedelta(days=7 * t), n, names[truth[n]]) for n in truth if rng.random() < 0.95]
    got = {(r.day, r.n): r.aligned for r in aligned.aligned(spark.createDataFrame(rows, "day date, n int, c int"), "day", "n", "c", 3).collect()}
    before = None
    for day in sorted({r[0] for r in rows}):
        own = {n: c for d, n, c in rows if d == day}
        if before is not None:
            kept = lambda p: sum(before.get(n) == p[c] for n, c in own.items())  # noqa: B023, E731
            assert kept({c: got[day, n] for n, c in own.items()}) == max(kept(p) for p in permutations(range(3)))
        for c in set(own.values()):
            assert len({got[day, n] for n in own if own[n] == c}) == 1
        before = {n: got[day, n] for n in own}
    rate = {r.day: r for r in aligned.reassignment(spark.createDataFrame([(d, n, got[d, n]) for d, n, _ in rows], "day date, n int, aligned int"), "day", "n").collect()}
    days = sorted({r[0] for r in rows})
    for a, b in zip(days, days[1:], strict=False):
        both = [n for n in range(20) if (a, n) in got and (b, n) in got]
        assert rate[b].n == len(both) and abs(rate[b].reassigned - sum(got[a, n] != got[b, n] for n in both) / len(both)) < 1e-12
    assert len(rate) == len(days) - 1


def test_pairs_within_and_between(spark):
    rng, rows = random.Random(2), []
    for t in range(30):
        base = [rng.gauss(0, 1), rng.gauss(0, 1)]
        rows += [(t, n, base[n % 2] + rng.gauss(0, 0.2)) for n in range(6)]
    groups = spark.createDataFrame([(n, n % 2) for n in range(6)], "n int, c int")
    got = {r.relation: r for r in aligned.homogeneity(spark.createDataFrame(rows, "t int, n int, v double"), groups, "t", "n", "v", "c").collect()}
    assert got["within"].pairs == 6 and got["between"].pairs == 9 and got["within"].correlation > 0.8 > 0.5 > got["between"].correlation
    with pytest.raises(ValueError):
        aligned.homogeneity(spark.createDataFrame(rows, "t int, n int, v double"), groups, "t", "n", "v", "c", most=5)


def test_dates_are_clustered_side_by_side(spark):
    rng = random.Random(3)
    rows = [(t, n, float(n // 4 * 10 + rng.random()), rng.random()) for t in range(5) for n in range(12)]
    df = spark.createDataFrame(rows, "t int, n int, a double, b double")
    both = {(r.t, r.n): r.cluster for r in learning.clusters_by_date(df, "t", "n", ["a", "b"], 3).collect()}
    one = {r.n: r.cluster for r in learning.clusters(df.where("t = 2"), "n", ["a", "b"], 3).collect()}
    assert {n: c for (t, n), c in both.items() if t == 2} == one and len(both) == 60


AMOUNTS = {
    "12.500": 12500.0, "12,500": 12500.0, "12.500.000": 12500000.0, "12,50": 12.5, "12,5": 12.5, "12.5": 12.5, "1.234,56 €": 1234.56, "1,234.56": 1234.56, "1.234.567,891": 1234567.89, "€ 7": 7.0, "12,": 12.0,
    "-3,5": None, "abc": None, "": None, None: None, "1,234,56": None, "1.2.x": None, "+5": 5.0, "12.5000": 12.5, ".5": 0.5, "1e3": 1000.0, "0": 0.0,
}


def test_amounts(spark):
    df = spark.createDataFrame([(t,) for t in AMOUNTS], "t string")
    assert {r.t: r.a for r in df.select("t", amount_from_text(F.col("t")).alias("a")).collect()} == AMOUNTS

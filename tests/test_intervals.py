"""Distances to intervals against plain loops, and how often bootstrap intervals hold the truth."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import intervals

START = dt.date(2022, 12, 1)


def day(n):
    return START + dt.timedelta(days=n)


def spans(seed, n=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(900)
        out.append((rng.choice("xxy"), day(a), day(a + rng.choice([-1, 0, 0, 3, 20]))))
    return [*out, ("x", None, day(3)), ("x", day(3), None)]


def test_islands(spark):
    rows = spans(1)
    got = {(r.k, r.start, r.end) for r in intervals.islands(spark.createDataFrame(rows, "k string, a date, b date"), ["k"], "a", "b").collect()}
    covered = {(k, a + dt.timedelta(days=i)) for k, a, b in rows if a and b and a <= b for i in range((b - a).days + 1)}
    assert {(k, s + dt.timedelta(days=i)) for k, s, e in got for i in range((e - s).days + 1)} == covered
    assert all((k, s - dt.timedelta(days=1)) not in covered and (k, e + dt.timedelta(days=1)) not in covered for k, s, e in got)


def test_distances_against_plain_loops(spark):
    rows = spans(2)
    rng = random.Random(3)
    asked = [(i, rng.choice(["x", "y", "z", None]), None if i == 7 else day(rng.randrange(-30, 960))) for i in range(300)]
    got = {r.i: r for r in intervals.interval_distances(spark.createDataFrame(asked, "i int, k string, d date"), spark.createDataFrame(rows, "k string, a date, b date"), ["k"], "d", "a", "b", 14).collect()}
    assert len(got) == 300 and got[7].inside is None
    for i, k, d in asked:
        if d is None or k is None:
            continue
        own = [(a, b) for q, a, b in rows if q == k and a and b and a <= b]
        inside = lambda t: any(a <= t <= b for a, b in own)  # noqa: B023, E731
        r = got[i]
        assert r.inside == inside(d)
        assert r.days_until == min([(a - d).days for a, _ in own if a > d], default=15)
        assert r.days_since == min([(d - b).days for _, b in own if b < d], default=15)
        assert abs(r.overlap - sum(inside(d + dt.timedelta(days=h)) for h in range(1, 15)) / 14) < 1e-12


def test_draws_are_poisson(spark):
    n = 40000
    got = {r.w: r["count"] / n for r in spark.range(n).select(intervals.poisson_draw(F.lit(1), F.col("id")).alias("w")).groupBy("w").count().collect()}
    assert all(abs(got.get(k, 0) - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(6))


def test_intervals_hold_the_truth_of_a_lasting_process(spark):
    # weekly lifts of mean 0.3 whose noise lasts for weeks: an interval that took weeks for independent would be far too short
    rng, rows = random.Random(4), []
    for s in range(150):
        e = 0.0
        for w in range(120):
            e = 0.6 * e + rng.gauss(0, 1)
            shared = rng.gauss(0, 5)
            rows.append((s, dt.date(2020, 1, 6) + dt.timedelta(days=7 * w), shared + 0.3 + e, shared))
    df = spark.createDataFrame([*rows, (0, dt.date(2020, 1, 6), None, 1.0)], "s int, week date, a double, b double")
    wide = intervals.lift_intervals(df, ["s"], "week", "a", "b", block=8, rounds=300).collect()
    narrow = intervals.lift_intervals(df, ["s"], "week", "a", "b", block=1, rounds=300).collect()
    hold = lambda rows: sum(r.low <= 0.3 <= r.high for r in rows) / len(rows)
    assert len(wide) == 150 and hold(wide) > 0.85 and hold(narrow) < hold(wide) - 0.1
    one = next(r for r in wide if r.s == 0)
    assert abs(one.lift - sum(a - b for s, _, a, b in rows if s == 0) / 120) < 1e-9

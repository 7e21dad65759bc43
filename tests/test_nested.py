"""Nested walk-forward: parts of folds, calibrations and thresholds against plain forms, and no look ahead."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nested

START = dt.date(2020, 1, 6)


def panel(n_dates, seed, per=6, flip=None):
    rng = random.Random(seed)
    rows = []
    for t in range(n_dates):
        for r in range(per):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            y = int(rng.random() < 1 / (1 + math.exp(-(2 * a * abs(a) - 1))))
            d = START + dt.timedelta(days=7 * t)
            rows.append((r, d, a, b, 1 - y if flip and t >= flip else y))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "region int, day date, a double, b double, y int")


def plain_roles(count, splits, least_train, least_test):
    size, out = max(least_test, (count - least_train) // splits), []
    for k in range(splits):
        train = least_train + k * size
        test = min(train + size, count)
        if test - train < least_test:
            break
        tail = min(max(14, int(train * 0.2)), train - 20)
        held = min(max(7, int(tail * 0.35)), tail - 7)
        out.append(["fit"] * (train - tail) + ["calibration"] * (tail - held) + ["guard"] * held + ["test"] * (test - train))
    return out


@pytest.mark.parametrize("count,splits,train,test", [(150, 3, 90, 21), (131, 5, 90, 21), (60, 2, 40, 10), (40, 3, 90, 21)])
def test_parts_of_folds(spark, count, splits, train, test):
    df = frame(spark, panel(count, 1, per=2))
    got = nested.with_roles(df, "day", nested.panel_folds(df, "day", splits, train, test)).groupBy("fold", "day").agg(F.first("role").alias("role"), F.count_distinct("role").alias("k")).orderBy("fold", "day").collect()
    want = [(k, START + dt.timedelta(days=7 * t), role) for k, roles in enumerate(plain_roles(count, splits, train, test)) for t, role in enumerate(roles)]
    assert [(r.fold, r.day, r.role) for r in got] == want and all(r.k == 1 for r in got)


def test_lines_and_pools_per_group(spark):
    rng = random.Random(2)
    rows = [(g, rng.random()) for g in range(3) for _ in range(300)]
    rows = [(g, s, int(rng.random() < (s**2 if g else 0.3 + 0.4 * s))) for g, s in rows] + [(9, 0.4, 1)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    lines = {r.g: (r.a, r.b) for r in nested.platt_fits(df, "g", "s", "y").collect()}
    pools = {r.g: (r.xs, r.ys) for r in nested.isotonic_fits(df, "g", "s", "y", 2).collect()}
    assert set(lines) == {0, 1, 2} and set(pools) == {0, 1, 2, 9}
    for g in range(3):
        s, y = (np.array(v, float) for v in zip(*[(s, y) for k, s, y in rows if k == g], strict=True))
        a, b = 0.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w, off = p * (1 - p), y - p
            step = np.linalg.solve([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]], [(off * s).sum() - 1e-3 * a, off.sum() - 1e-3 * b])
            a, b = a + step[0], b + step[1]
        assert np.allclose(lines[g], (a, b), atol=1e-6)
        points = {}
        for k, v, z in rows:
            if k == g:
                points.setdefault(math.floor(v * 100 + 0.5) / 100, []).append(z)
        at = sorted(points)
        # a rising fit is the greatest, over starts, of the least mean, over ends
        sums = [(sum(points[x]), len(points[x])) for x in at]
        mean = lambda i, j: sum(q for q, _ in sums[i : j + 1]) / sum(m for _, m in sums[i : j + 1])  # noqa: B023, E731
        for i, x in list(enumerate(at))[:: 7]:
            want = max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1))
            assert abs(np.interp(x, *pools[g]) - want) < 1e-9
    xs, ys = pools[1]
    asked = [-1.0, 0.0, 0.123, 0.5, xs[3], 0.77, 1.0, 2.0]
    table = spark.createDataFrame([(x, xs, ys) for x in asked], "x double, xs array<double>, ys array<double>")
    assert np.allclose([r.p for r in table.select(nested.interpolated(F.col("x"), F.col("xs"), F.col("ys")).alias("p")).collect()], np.interp(asked, xs, ys))


def plain_threshold(scores, labels, recall):
    def at(t):
        flagged = [y for s, y in zip(scores, labels, strict=True) if s >= t]
        return (sum(flagged) / len(flagged) if flagged else 0.0), (sum(flagged) / sum(labels) if sum(labels) else 0.0)

    for least in (recall, 0.0):
        best = (0.5, 0.0, 0.0)
        for t in nested.GRID:
            p, r = at(t)
            if r >= least and (p > best[1] + 1e-12 or math.isclose(p, best[1]) and r > best[2]):
                best = (t, p, r)
        if best[1] > 0:
            return best
    return best


def test_thresholds_against_plain_search(spark):
    rng = random.Random(5)
    rows = [(g, round(rng.random() ** (1 + g), 2)) for g in range(6) for _ in range(60)]
    rows = [(g, s, int(rng.random() < s) if g != 4 else 0) for g, s in rows] + [(7, 0.01, 1)] * 3
    got = {r.g: (r.threshold, r.precision, r.recall) for r in nested.action_thresholds(spark.createDataFrame(rows, "g int, s double, y int"), ["g"], "s", "y", 0.5).collect()}
    for g in got:
        own = [(s, y) for k, s, y in rows if k == g]
        assert np.allclose(got[g], plain_threshold(*zip(*own, strict=True), 0.5))


def test_modes_must_not_be_worse_than_raw(spark):
    rows = [(0, "raw", 0.2, 0.1, 0.5, 0.1), (0, "platt", 0.19, 0.05, 0.5, 0.1), (0, "isotonic", 0.1, 0.01, 0.4, 0.1), (1, "raw", 0.2, 0.1, 0.5, 0.1), (1, "platt", 0.3, 0.0, 0.9, 0.0), (2, "raw", 0.2, 0.1, 0.5, 0.1), (2, "platt", 0.2, 0.04, 0.5, 0.1), (2, "isotonic", 0.2, 0.04, 0.6, 0.1)]
    got = {r.fold: r["mode"] for r in nested.chosen_modes(spark.createDataFrame(rows, "fold int, mode string, brier double, ece double, top_precision double, false_alarm_rate double"), "fold").collect()}
    assert got == {0: "platt", 1: "raw", 2: "isotonic"}


def run(spark, rows):
    df = frame(spark, rows)
    folds = nested.panel_folds(df, "day", 2, 60, 20)
    return nested.nested_walk_forward(df, "day", ["a", "b"], "y", ["region"], folds, trees=4, depth=2, rate=0.5, least=10, half_life=400).persist()


def test_bundle_learns_and_never_looks_ahead(spark):
    rows = panel(100, 7)
    one = run(spark, rows)
    out = {(r.fold, r.region, r.day): (round(r.p, 9), r["mode"], r.threshold) for r in one.collect()}
    assert len(out) == 6 * 40 and {k[0] for k in out} == {0, 1}
    later = {(r.fold, r.region, r.day): (round(r.p, 9), r["mode"], r.threshold) for r in run(spark, panel(100, 7, flip=80)).collect()}
    assert {k: v for k, v in out.items() if k[0] == 0} == {k: v for k, v in later.items() if k[0] == 0}
    report = {r.fold: r for r in nested.fold_report(one, "y").collect()}
    assert set(report) == {None, 0, 1} and report[None].n == 240 and report[None].auc > 0.7
    assert report[None].events == sum(r.y for r in one.collect()) and all(0.001 <= r.p <= 0.999 and r.flagged == (r.p >= r.threshold) for r in one.collect())


def test_one_class_and_no_folds(spark):
    rows = [(*r[:4], 0) for r in panel(100, 8)]
    assert run(spark, rows).count() == 0
    assert run(spark, panel(30, 8)).count() == 0

"""Forecasts from running sums against a refit for each row."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rowwise

START = dt.date(2021, 1, 1)


def rows(seed, n=260, k=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 1) * 10 + 50, rng.random(), 7.0 if i % 2 else rng.choice([7.0, 7.0])][:k]
        d = START + dt.timedelta(days=rng.randrange(400))
        y = max(0.0, 2 * x[0] - 30 * x[1] + rng.gauss(0, 5) - 40)
        out.append((i, rng.choice("hhhc"), d, None if rng.random() < 0.05 else d + dt.timedelta(days=rng.randrange(60)), *[None if rng.random() < 0.03 else v for v in x], None if rng.random() < 0.05 else y))
    return out


@pytest.mark.parametrize("days", [3, 28, 1000])
def test_each_row_against_its_own_refit(spark, days):
    data = rows(1)
    df = spark.createDataFrame(data, "i int, key string, day date, known date, a double, b double, c double, y double")
    got = {r.i: r for r in rowwise.rowwise_walk_forward(df, ["key"], "day", "known", ["a", "b", "c"], "y", 14, least=12, strength=2.0, days=days).collect()}
    assert len(got) == len(data)
    fitted = 0
    for i, key, d, _, *x, y in data:
        train = [r for r in data if r[1] == key and r[3] is not None and r[3] <= d - dt.timedelta(days=14) and all(v is not None for v in r[4:])]
        assert got[i].n_train == len(train)
        if len(train) < 12 or any(v is None for v in x):
            assert got[i].forecast is None
            continue
        fitted += 1
        m, t = np.array([r[4:7] for r in train]), np.array([r[7] for r in train])
        s = np.where(m.std(0) > 1e-9, m.std(0), 1.0)
        z = (m - m.mean(0)) / s
        beta = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (t - t.mean()))
        guess = t.mean() + ((np.array(x) - m.mean(0)) / s) @ beta
        assert abs(got[i].forecast - min(max(guess, 0), 2.5 * t.max())) < 1e-6
        sigma = np.sqrt(((t - t.mean() - z @ beta) ** 2).mean())
        assert abs(got[i].sigma - sigma) < 1e-5 and abs(got[i].mean - t.mean()) < 1e-9
        assert abs(got[i].high_95 - (got[i].forecast + 1.96 * sigma)) < 1e-4 and got[i].low_80 >= 0
    assert fitted > 100


def test_what_becomes_known_later_does_not_count(spark):
    data = rows(2)
    cut = START + dt.timedelta(days=250)
    other = [(*r[:7], (r[7] or 0.0) + 500) if r[3] and r[3] > cut else r for r in data]
    ask = lambda d: {r.i: (r.n_train, r.forecast and round(r.forecast, 6)) for r in rowwise.rowwise_walk_forward(spark.createDataFrame(d, "i int, key string, day date, known date, a double, b double, c double, y double"), ["key"], "day", "known", ["a", "b"], "y", 14, least=5).collect() if r.day <= cut + dt.timedelta(days=14)}
    one = ask(data)
    assert one == ask(other) and len(one) > 100


@pytest.mark.parametrize("k", [1, 2, 6])
def test_solve_in_columns(spark, k):
    rng = np.random.default_rng(k)
    m = [rng.normal(size=(k, k)) for _ in range(20)]
    a, b = [q @ q.T + np.eye(k) for q in m], rng.normal(size=(20, k))
    df = spark.createDataFrame([(i, p.ravel().tolist(), q.tolist()) for i, (p, q) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    x = rowwise.solved([[F.col("a")[i * k + j] for j in range(k)] for i in range(k)], [F.col("b")[i] for i in range(k)])
    for r in df.select("i", x.alias("x")).collect():
        assert np.allclose(r.x, np.linalg.solve(a[r.i], b[r.i]))


def test_a_hot_key_is_spread_over_its_stretches(spark):
    df = spark.range(20000).select(F.lit("hot").alias("key"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 2000).cast("int")).alias("at"), F.lit(1).alias("one"))
    got = rowwise.with_running(df.drop("one"), df, ["key"], "at", ["one"], days=50)
    assert got.groupBy().agg(F.max("one"), F.min("one"), F.sum("one")).first() == (20000, 10, sum(10 * 10 * d for d in range(1, 2001)))

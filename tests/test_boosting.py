"""Boosted trees against a plain single-process form."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting, forecasting


def plain_quantile_forest(x, y, edges, q, trees, depth, rate, least):
    """The same trees by loops over numpy arrays."""
    low = lambda v: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]
    bins = np.array([[sum(e < v for e in ends) for v, ends in zip(row, edges, strict=True)] for row in x])
    f = np.full(len(y), low(y))
    for _ in range(trees):
        g = np.where(y > f, q, q - 1.0)
        node = np.ones(len(y), int)
        for level in range(depth):
            splits = {}
            for v in range(2**level, 2 ** (level + 1)):
                own, best = node == v, 1e-9
                for j in range(x.shape[1]):
                    for b in sorted(set(bins[own, j]))[:-1]:
                        left = own & (bins[:, j] <= b)
                        right = own & (bins[:, j] > b)
                        if left.sum() < least or right.sum() < least:
                            continue
                        fall = g[left].sum() ** 2 / left.sum() + g[right].sum() ** 2 / right.sum() - g[own].sum() ** 2 / own.sum()
                        if fall > best * (1 + 1e-12) + 1e-12:
                            best, splits[v] = fall, (j, b)
            node = np.array([2 * n + (n in splits and bins[i, splits[n][0]] > splits[n][1]) for i, n in enumerate(node)])
        for v in set(node):
            f[node == v] += rate * low((y - f)[node == v])
    return f


def curved(n, seed):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.uniform(-3, 3, n), rng.normal(size=n), rng.integers(0, 4, n)]
    return x, np.sin(x[:, 0]) * 3 + (x[:, 2] == 2) * 2 + rng.normal(size=n) * (0.3 + 0.3 * np.abs(x[:, 0]))


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, y double")


def pinball(y, f, q):
    return np.mean(np.where(y >= f, q * (y - f), (q - 1) * (y - f)))


def test_quantile_trees_against_plain_loops(spark):
    x, y = curved(300, 1)
    df = frame(spark, x, y)
    forest = boosting.quantile_boosting(df, ["a", "b", "c"], "y", (0.1, 0.5, 0.9), trees=4, depth=2, bins=8, rate=0.3, least=10, every=2)
    got = np.array([r.quantiles for r in boosting.boosted_quantiles(df, forest, (0.1, 0.5, 0.9)).orderBy("i").collect()])
    plain = np.sort(np.array([plain_quantile_forest(x, y, forest.edges, q, 4, 2, 0.3, 10) for q in (0.1, 0.5, 0.9)]).T, axis=1)
    assert np.allclose(got, plain, atol=1e-9)


def test_boosting_beats_lines_on_a_curve(spark):
    (x, y), (tx, ty) = curved(1500, 2), curved(800, 3)
    train, test, levels = frame(spark, x, y), frame(spark, tx, ty), (0.1, 0.5, 0.9)
    forest = boosting.quantile_boosting(train, ["a", "b", "c"], "y", levels, trees=8, depth=3, rate=0.5)
    got = np.array([r.quantiles for r in boosting.boosted_quantiles(test, forest, levels).orderBy("i").collect()])
    lines = {p: np.c_[np.ones(len(tx)), tx] @ b for _, p, b in forecasting.quantile_fits(train.withColumn("fold", F.lit(0)), "fold", ["a", "b", "c"], "y", levels)}
    for k, p in enumerate(levels):
        assert pinball(ty, got[:, k], p) < 0.8 * pinball(ty, lines[p], p)
    assert 0.7 < np.mean((ty >= got[:, 0]) & (ty <= got[:, 2])) < 0.9


def test_models_side_by_side_are_the_models_alone(spark):
    x, y = curved(400, 4)
    df = frame(spark, x, y).withColumn("m", F.when(F.col("i") < 250, "p").otherwise("q")).withColumn("z", (F.col("y") > 1).cast("double")).withColumn("a", F.when(F.col("i") % 11 != 0, F.col("a")))
    edges = boosting.bin_edges(df, ["a", "b", "c"], 16)
    more = dict(trees=3, depth=2, least=5, rate=0.5, edges=edges)
    both = boosting.fit(df, ["a", "b", "c"], "z", boosting.log_loss(), "m", **more)
    for m in "pq":
        alone = boosting.fit(df.where(F.col("m") == m), ["a", "b", "c"], "z", boosting.log_loss(), "m", **more)
        assert [(t.feature, t.bin) for t in alone.trees[m]] == [(t.feature, t.bin) for t in both.trees[m]]
        assert np.allclose([t.leaf for t in alone.trees[m]], [t.leaf for t in both.trees[m]])
    out = boosting.score(df.unionByName(df.limit(1).withColumn("m", F.lit("none"))), both, "m").collect()
    assert sum(r.score is None for r in out) == 1
    p = np.array([1 / (1 + np.exp(-r.score)) for r in out if r.score is not None])
    z = np.array([r.z for r in out if r.score is not None])
    assert -np.mean(z * np.log(p) + (1 - z) * np.log(1 - p)) < 0.55 and np.mean((p > 0.5) == z) > 0.8


def test_nothing_to_split_or_to_fit(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(None, None)], "a double, y double")
    forest = boosting.quantile_boosting(df, ["a"], "y", (0.5,), trees=2, least=1)
    assert [r.quantiles for r in boosting.boosted_quantiles(df, forest, (0.5,)).collect()] == [[2.0]] * 6
    empty = boosting.quantile_boosting(df.where("false"), ["a"], "y", (0.5,), trees=2, edges=[[]])
    assert empty.trees == {} and boosting.boosted_quantiles(df, empty, (0.5,)).where("quantiles IS NOT NULL").count() == 0

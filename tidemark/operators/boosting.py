"""Boosted histogram trees with losses that Spark ML's trees lack: quantiles, and ranking within groups.

Many models are fitted side by side: a row carries the model it trains (a quantile level, a fold, or both), and each
depth of all models' trees is one aggregate of gradients by (model, node, feature, bin). Its outcome has a row per such cell,
whatever the input is, and only that reaches the driver, which picks the splits. Trees go back to the rows as a
small table by a broadcast join on the model, and rows walk them in column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut

TREE = "model string, feature array<int>, bin array<int>, threshold array<double>, leaf array<double>"


@dataclass
class Tree:
    """A full tree of a depth: nodes 1, 2, 3, ... by level. A node that isn't split sends all rows to the left."""

    depth: int
    feature: list[int] = field(init=False)
    bin: list[int] = field(init=False)
    leaf: list[float] = field(init=False)

    def __post_init__(self):
        self.feature, self.bin, self.leaf = [0] * 2**self.depth, [1 << 30] * 2**self.depth, [0.0] * 2 ** (self.depth + 1)


@dataclass
class Forest:
    """Trees of each model; `edges` are the upper ends of a feature's bins. A forecast is base + rate * (sum of leaves)."""

    features: list[str]
    edges: list[list[float]]
    rate: float
    depth: int
    base: dict[str, float]
    trees: dict[str, list[Tree]]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per model: its base and its trees, thresholds as values."""
        end = float("inf")
        at = lambda t: [self.edges[f][b] if b < len(self.edges[f]) else end for f, b in zip(t.feature, t.bin, strict=True)]
        rows = [(m, self.base[m], [(t.feature, at(t), t.leaf) for t in ts]) for m, ts in self.trees.items()]
        return spark.createDataFrame(rows, "model string, base double, trees array<struct<feature:array<int>,threshold:array<double>,leaf:array<double>>>")


def _walk(depth: int, goes_right: Callable[[Column], Column]) -> Column:
    """The node that a row ends in after so many levels."""
    if not depth:
        return F.lit(1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), lambda node, _: node * 2 + goes_right(node).cast("int"))


def bin_edges(df: DataFrame, features: list[str], bins: int, error: float = 1e-3) -> list[list[float]]:
    """Ends of up to so many bins per feature, from quantiles whose rank is off by `error` at most."""
    cuts = df.select(*[F.col(c).cast("double").alias(c) for c in features]).approxQuantile(features, [k / bins for k in range(1, bins)], error)
    return [sorted(set(c)) for c in cuts]


def binned(features: list[str], edges: list[list[float]]) -> Column:
    """Bins of a row: how many ends lie below the value. A null is in the lowest bin, with the least values."""
    one = lambda c, ends: F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col(c).cast("double"))), F.lit(0)) if ends else F.lit(0)
    return F.array(*[F.when(F.col(c).isNull(), F.lit(0)).otherwise(one(c, ends)) for c, ends in zip(features, edges, strict=True)])


def best_splits(cells: pd.DataFrame, least: int, gain: float = 1e-9) -> dict[tuple[str, int], tuple[int, int]]:
    """(model, node): (feature, bin) of the greatest fall in squared error, of equal ones the first feature and bin."""
    found = {}
    for key, own in cells.groupby(["model", "node"], sort=False):
        best, at = gain, None
        for f, part in own.groupby("feature", sort=True):
            part = part.sort_values("bin")
            g, h, n = (part[c].to_numpy(float).cumsum() for c in ("g", "h", "n"))
            left = (n[:-1] >= least) & (n[-1] - n[:-1] >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                fall = np.where(left, g[:-1] ** 2 / h[:-1] + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1]) - g[-1] ** 2 / h[-1], -np.inf)
            fall = np.where(np.isfinite(fall), fall, -np.inf)
            if len(fall) and fall.max() > best + 1e-12 * abs(best):
                best, at = float(fall.max()), (int(f), int(part["bin"].iloc[int(fall.argmax())]))
        if at:
            found[key] = at
    return found


@dataclass
class Loss:
    """What a booster needs: base of each model, gradient columns `g` and `h` of a state, leaf values per (model, node).

    A state has model, bins, y, f (the forecast so far) and the columns kept for the loss.
    """

    base: Callable[[DataFrame], dict[str, float]]
    gradients: Callable[[DataFrame], DataFrame]
    leaves: Callable[[DataFrame], dict[tuple[str, int], float]]
    rereads: bool = False  # gradients read the state more than once, so that it is written every turn


def pinball_loss(levels: tuple[float, ...], level: str = "level", accuracy: int = 100_000) -> Loss:
    """Quantiles: `level` is a column with one of `levels`. A leaf is the quantile of its residuals, exact for leaves of up to `accuracy` rows."""

    def quantiles(df: DataFrame, keys: list[str], value: Column) -> dict:
        rows = df.groupBy(*keys, level).agg(F.percentile_approx(value, list(levels), accuracy).alias("q")).collect()
        return {tuple(r[k] for k in keys): float(r.q[levels.index(r[level])]) for r in rows}

    def gradients(df: DataFrame) -> DataFrame:
        return df.withColumn("g", F.when(F.col("y") > F.col("f"), F.col(level)).otherwise(F.col(level) - 1)).withColumn("h", F.lit(1.0))

    return Loss(lambda df: {k[0]: v for k, v in quantiles(df, ["model"], F.col("y")).items()}, gradients, lambda df: quantiles(df, ["model", "node"], F.col("y") - F.col("f")))


def newton_leaves(ridge: float) -> Callable[[DataFrame], dict]:
    def leaves(df: DataFrame) -> dict:
        rows = df.groupBy("model", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        return {(r.model, r.node): r.g / (r.h + ridge) for r in rows}

    return leaves


def log_loss(weight: str | None = None, ridge: float = 1.0) -> Loss:
    """Events: y is 0 or 1, the forecast is on the log-odds scale. weight: a column of row weights."""
    w = F.col(weight) if weight else F.lit(1.0)

    def base(df: DataFrame) -> dict:
        rows = df.groupBy("model").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("p")).collect()
        return {r.model: float(np.log(min(max(r.p, 1e-6), 1 - 1e-6) / (1 - min(max(r.p, 1e-6), 1 - 1e-6)))) for r in rows}

    def gradients(df: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-F.col("f")))
        return df.withColumn("g", w * (F.col("y") - p)).withColumn("h", F.greatest(w * p * (1 - p), F.lit(1e-9)))

    return Loss(base, gradients, newton_leaves(ridge))


def fit(rows: DataFrame, features: list[str], y: str, loss: Loss, model: str, keep: tuple[str, ...] = (), trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.1, least: int = 20, every: int = 8, edges: list[list[float]] | None = None) -> Forest:
    """Fit a forest per value of `model`. Rows whose y is null are left out; a null feature counts as least.

    keep: columns that the loss reads. every: after so many trees the state of the rows is written and read again, so
    that lineage stays short.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(y).isNotNull())
    edges = edges if edges is not None else bin_edges(rows, features, bins)
    state = cut(rows.select(F.col(model).cast("string").alias("model"), binned(features, edges).alias("bins"), F.col(y).cast("double").alias("y"), *keep))
    base = loss.base(state)
    forest = Forest(features, edges, rate, depth, base, {m: [] for m in sorted(base)})
    if not base:
        return forest
    state = state.join(F.broadcast(spark.createDataFrame(list(base.items()), "model string, f double")), "model")

    def small(made: dict[str, Tree]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(m, t.feature, t.bin, t.leaf) for m, t in made.items()], "model string, feature array<int>, bin array<int>, leaf array<double>"))

    def at(df: DataFrame, made: dict[str, Tree], level: int) -> DataFrame:
        node = _walk(level, lambda n: F.get("bins", F.get("feature", n)) > F.get("bin", n))
        return df.join(small(made), "model").withColumn("node", node)

    last = None
    for turn in range(trees):
        made = {m: Tree(depth) for m in base}
        sloped = loss.gradients(state).persist()
        for level in range(depth):
            cells = at(sloped, made, level).select("model", "node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).toPandas()
            if last is not None:  # the rows of this turn are held now
                last = last.unpersist() and None
            splits = best_splits(cells, least)
            for (m, node), (f, b) in splits.items():
                made[m].feature[node], made[m].bin[node] = f, b
            if not splits:
                break
        for (m, node), value in loss.leaves(at(sloped, made, depth)).items():
            made[m].leaf[node] = value
        for m, t in made.items():
            forest.trees[m].append(t)
        state = at(sloped, made, depth).withColumn("f", F.col("f") + rate * F.get("leaf", F.col("node"))).drop("node", "feature", "bin", "leaf", "g", "h")
        if (loss.rereads or turn % every == every - 1) and turn < trees - 1:
            state, sloped = cut(state), sloped.unpersist() and None
        last = sloped
    if last is not None:
        last.unpersist()
    return forest


def score(df: DataFrame, forest: Forest, model: str, into: str = "score") -> DataFrame:
    """Rows with the forecast of their model; null where there is no such model."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in forest.features])
    right = lambda t: lambda n: F.get(x, F.get(t["feature"], n)) > F.get(t["threshold"], n)
    total = F.aggregate("trees", F.col("base"), lambda acc, t: acc + forest.rate * F.get(t["leaf"], _walk(forest.depth, right(t))))
    table = forest.table(df.sparkSession).withColumnRenamed("model", "__model")
    return df.join(F.broadcast(table), F.col(model).cast("string") == F.col("__model"), "left").withColumn(into, total).drop("__model", "base", "trees")


def quantile_boosting(train: DataFrame, features: list[str], y: str, levels: tuple[float, ...], by: str | None = None, **more) -> Forest:
    """Boosted quantiles of y: a model per level, and per value of `by` (say, a fold) where it is given."""
    name = _name(by)
    each = train.withColumn("level", F.explode(F.array(*[F.lit(p) for p in levels])))
    return fit(each.withColumn("__m", name), features, y, pinball_loss(levels), "__m", keep=("level",), **more)


def _name(by: str | None) -> Column:
    level = F.col("level").cast("string")
    return level if by is None else F.concat_ws("|", F.col(by).cast("string"), level)


def boosted_quantiles(df: DataFrame, forest: Forest, levels: tuple[float, ...], by: str | None = None, into: str = "quantiles") -> DataFrame:
    """Rows with their quantiles in the order of levels, sorted so that they don't cross."""
    out = df
    for k, p in enumerate(levels):
        out = score(out.withColumn("level", F.lit(p)).withColumn("__m", _name(by)), forest, "__m", f"__q{k}").drop("level", "__m")
    names = [f"__q{k}" for k in range(len(levels))]
    return out.withColumn(into, F.when(F.col(names[0]).isNotNull(), F.array_sort(F.array(*names)))).drop(*names)

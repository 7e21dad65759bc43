"""Quantile regression on walk-forward folds, choice of a calibration, and reconciliation of whole hierarchies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from . import learning, metrics, splits


def quantile_fits(train: DataFrame, fold: str, features: list[str], y: str, levels: tuple[float, ...], rounds: int = 12, least: float = 1e-3, ridge: float = 1e-6) -> list[tuple]:
    """(fold, level, coefficients) of linear quantile regressions, intercept first.

    Reweighted least squares: a row weighs level or 1 - level over its residual's size (`least` at least). All
    folds and levels are fitted together: a round is one aggregate that sums the normal equations of each, and
    only those few sums reach the driver. Rows with a null are left out.
    """
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    rows = train.dropna(subset=[*features, y]).select(F.col(fold).alias("fold"), x.alias("x"), F.col(y).cast("double").alias("y")).persist()
    spark, k = train.sparkSession, len(features) + 1
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    fits: list[tuple] = [(r[0], p, [0.0] * k) for r in sorted(rows.select("fold").distinct().collect()) for p in levels]
    try:
        for turn in range(rounds if fits else 0):
            beta = spark.createDataFrame(fits, f"fold {dict(rows.dtypes)['fold']}, level double, beta array<double>")
            off = F.col("y") - dot
            weight = F.lit(1.0) if turn == 0 else F.when(off >= 0, F.col("level")).otherwise(1 - F.col("level")) / F.greatest(F.abs(off), F.lit(least))
            met = rows.join(F.broadcast(beta), "fold").withColumn("w", weight)
            sums = met.groupBy("fold", "level").agg(F.array(*[F.sum(F.col("w") * F.col("x")[i] * F.col("x")[j]) for i, j in cells]).alias("a"), F.array(*[F.sum(F.col("w") * F.col("x")[i] * F.col("y")) for i in range(k)]).alias("b"))
            new = []
            for r in sums.collect():
                a = np.zeros((k, k))
                for (i, j), v in zip(cells, r.a, strict=True):
                    a[i, j] = a[j, i] = v
                new.append((r.fold, r.level, np.linalg.solve(a + ridge * np.eye(k) * max(np.trace(a) / k, 1e-12), np.array(r.b)).tolist()))
            new.sort(key=lambda f: (f[0], f[1]))
            moved = max(max(abs(p - q) for p, q in zip(m[2], n[2], strict=True)) for m, n in zip(fits, new, strict=True))
            fits = new
            if moved < 1e-6:
                break
    finally:
        rows.unpersist()
    return fits


def quantile_walk_forward(df: DataFrame, day: str, features: list[str], y: str, levels: tuple[float, ...], least_train: int, test: int, most: int) -> DataFrame:
    """Out-of-fold forecasts: the test rows of each expanding fold with `quantiles`, by a fit on the rows before.
    Quantiles are put in order. Rows with a null feature have null quantiles."""
    both = splits.assign_folds(df, day, splits.folds(df, day, least_train, test, most))
    fits = quantile_fits(both.where("role = 'train'"), "fold", features, y, levels)
    if not fits:
        return both.where("role = 'test'").drop("role").withColumn("quantiles", F.lit(None).cast("array<double>"))
    by: dict = {}
    for fold, _, beta in fits:
        by.setdefault(fold, []).append(beta)
    table = df.sparkSession.createDataFrame(list(by.items()), "fold long, betas array<array<double>>")
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    each = F.transform("betas", lambda b: F.aggregate(F.zip_with(b, x, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q))
    return both.where("role = 'test'").drop("role").join(F.broadcast(table), "fold").withColumn("quantiles", F.when(F.forall(x, lambda v: v.isNotNull()), F.array_sort(each))).drop("betas")


def choose_calibration(fit: DataFrame, guard: DataFrame, score: str, label: str, digits: int | None = 3) -> tuple[str, list[tuple[str, float, float]]]:
    """raw, isotonic or platt: of those that the guard part finds no worse than the raw score in Brier score and
    in calibration error, the one of the least Brier score. With the name come (name, Brier, error) of each."""
    one = F.lit(1).alias("__all")
    tried = {"raw": guard.withColumn("__p", F.col(score))}
    if fit.select(label).distinct().count() == 2:
        tried["isotonic"] = learning.calibrated(learning.isotonic(fit, score, label, digits), guard, score, "__p")
        tried["platt"] = learning.probability(learning.logistic(fit, [score], label), guard, [score], "__p")
    found = []
    for name, rows in tried.items():
        rows = rows.select(one, "__p", label)
        brier = metrics.classification(rows, ["__all"], "__p", label, 0.5).first()["brier"]
        found.append((name, brier, metrics.calibration_error(rows, ["__all"], "__p", label).first()["ece"]))
    raw = found[0]
    return min((f for f in found if f[1] <= raw[1] + 1e-12 and f[2] <= raw[2] + 1e-12), key=lambda f: (f[1], f[0] != "raw"))[0], found


def reconcile_levels(df: DataFrame, keys: list[str], node: str, parent: str, quantiles: list[str], errors: str | None = None, shrink: float = 0.2) -> DataFrame:
    """Forecasts of every level made to add up: leaves, clusters and the whole, each quantile by itself.

    Rows of a group (keys) are the nodes of one hierarchy; the top has a null parent. errors: an array of past
    errors per node, as long for all; their covariance, shrunk towards its diagonal, weighs the adjustment
    (without them nodes weigh alike): S (S' W^-1 S)^-1 S' W^-1 y. Reconciled leaves are put in order and cut at
    zero, and the upper levels are their sums, so that all is coherent. A group is one hierarchy, not data.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, parents = group[node].tolist(), group[parent].tolist()
        at = {n: i for i, n in enumerate(names)}
        inner = {p for p in parents if p is not None and p == p}
        leaves = [i for i, n in enumerate(names) if n not in inner]
        s = np.zeros((len(names), len(leaves)))
        for c, i in enumerate(leaves):
            while i is not None:
                s[i, c] = 1
                p = parents[i]
                i = at.get(p) if p is not None and p == p else None
        w = np.eye(len(names))
        if errors:
            e = np.array([np.asarray(x, float) for x in group[errors]])
            w = np.atleast_2d(np.cov(e)) if e.shape[1] > 1 else w
            w = (1 - shrink) * w + shrink * np.diag(np.diag(w)) + 1e-6 * max(np.trace(w) / len(w), 1e-12) * np.eye(len(w))
        inverse = np.linalg.pinv(w)
        to_leaves = np.linalg.pinv(s.T @ inverse @ s) @ s.T @ inverse
        low = np.maximum(to_leaves @ group[quantiles].to_numpy(float), 0)
        out = s @ np.maximum.accumulate(low, axis=1)
        return group.assign(**{f"{q}_reconciled": out[:, k] for k, q in enumerate(quantiles)})

    schema = df.withColumns({f"{q}_reconciled": F.lit(0.0) for q in quantiles}).schema
    return df.groupBy(*keys).applyInPandas(run, schema)


def cluster_spread(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Per cluster: size, variance within, and its share of the variance of all."""
    each = df.groupBy(cluster).agg(F.count("*").alias("n"), F.var_pop(value).alias("within"))
    return each.join(F.broadcast(df.agg(F.var_pop(value).alias("__all")))).select(cluster, "n", "within", ratio(F.col("within"), F.col("__all")).alias("share"))

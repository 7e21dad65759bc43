"""Models on Spark ML, and sequential fits per small group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_classifier(train: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 3):
    """Boosted trees for an event; nulls in features count as zero."""
    stages = [VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), GBTClassifier(featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=depth, seed=7)]
    return Pipeline(stages=stages).fit(train.fillna(0.0, features))


def probability(model, df: DataFrame, features: list[str], into: str = "p") -> DataFrame:
    out = model.transform(df.fillna(0.0, features))
    return out.withColumn(into, vector_to_array("probability")[1]).drop("__x", "__z", "probability", "rawPrediction", "prediction")


def logistic(train: DataFrame, features: list[str], label: str, ridge: float = 0.01):
    stages = [VectorAssembler(inputCols=features, outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol=label, regParam=ridge, tol=1e-10)]
    return Pipeline(stages=stages).fit(train.fillna(0.0, features))


def ridge(train: DataFrame, features: list[str], label: str, strength: float = 1.0):
    stages = [VectorAssembler(inputCols=features, outputCol="__x"), LinearRegression(featuresCol="__x", labelCol=label, regParam=strength, elasticNetParam=0.0)]
    return Pipeline(stages=stages).fit(train.fillna(0.0, features))


def ridge_shares(df: DataFrame, features: list[str], y: str, strength: float = 1.0) -> DataFrame:
    """Ridge regression on standardised features: per feature its coefficient and its share of all coefficients'
    sizes, with the R2 and mean absolute error of the fit. One aggregate gathers the moments; rows with a null
    are left out."""
    names = [*features, y]
    rows = df.dropna(subset=names)
    k = len(features)
    sums = rows.agg(F.count("*").alias("n"), F.array(*[F.avg(c).cast("double") for c in names]).alias("m"), F.array(*[F.covar_pop(a, b) for a in names for b in names]).alias("c")).first()
    n, c = sums.n, np.array([0.0 if x is None else x for x in sums.c]).reshape(k + 1, k + 1)
    scale = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))[:k]
    inner, outer = c[:k, :k] / np.outer(scale, scale), c[:k, k] / scale
    beta = np.linalg.solve(n * inner + strength * np.eye(k), n * outer) if n else np.zeros(k)
    mean = [0.0 if x is None else x for x in sums.m]
    guess = sum(((F.col(f) - m) / float(s) * float(b) for f, m, s, b in zip(features, mean, scale, beta, strict=False)), F.lit(mean[k]))
    fit = rows.agg(F.avg(F.abs(F.col(y) - guess)).alias("mae"), F.avg((F.col(y) - guess) ** 2).alias("mse")).first()
    r2 = float(1 - fit.mse / c[k, k]) if n and c[k, k] > 0 else None
    total = np.abs(beta).sum()
    return df.sparkSession.createDataFrame([(f, float(b), float(abs(b) / total) if total else None, r2, fit.mae) for f, b in zip(features, beta, strict=True)], "feature string, coefficient double, share double, r2 double, mae double")


def isotonic(train: DataFrame, score: str, label: str, digits: int | None = None):
    """Monotone calibration of a score. Equal scores are one row weighted by their count. digits: scores are
    rounded first, so that the pooling step sees few rows whatever the input is."""
    few = train.groupBy((F.col(score) if digits is None else F.round(score, digits)).alias("__s")).agg(F.avg(F.col(label).cast("double")).alias("__y"), F.count("*").cast("double").alias("__w"))
    few = VectorAssembler(inputCols=["__s"], outputCol="__x").transform(few)
    return IsotonicRegression(featuresCol="__x", labelCol="__y", weightCol="__w").fit(few)


def calibrated(model, df: DataFrame, score: str, into: str) -> DataFrame:
    x = VectorAssembler(inputCols=[score], outputCol="__x").transform(df)
    return model.transform(x).withColumnRenamed("prediction", into).drop("__x")


def folds_by_hash(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


def trend_forecast(df: DataFrame, keys: list[str], order: str, value: str, horizon: int) -> DataFrame:
    """Last value plus the mean of the last four steps, with bands widening by the square root of the step."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(value).cast("double")
    x = df.select(*keys, order, v.alias("__v"), (v - F.lag(v).over(w)).alias("__step"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))).alias("__k"))
    last = x.groupBy(*keys).agg(
        F.max(F.when(F.col("__k") == 1, F.col("__v"))).alias("__last"), F.coalesce(F.avg(F.when(F.col("__k") <= 4, F.col("__step"))), F.lit(0.0)).alias("__mean"),
        F.when(F.count("*") > 2, F.greatest(F.stddev_pop("__step"), F.lit(1.0))).otherwise(1.0).alias("__width"),
    )
    each = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    mid, half = F.greatest(F.col("__last") + F.col("__mean") * F.col("step"), F.lit(0.0)), 1.2816 * F.col("__width") * F.sqrt("step")
    return each.select(*keys, "step", mid.alias("forecast"), F.greatest(mid - half, F.lit(0.0)).alias("low"), (mid + half).alias("high"))


def clusters(df: DataFrame, node: str, features: list[str], k: int, most: int = 2000) -> DataFrame:
    """Ward clusters of the nodes of a small dimension, by standardised features; nulls count as zero.

    Merges follow one another, so the nodes are one group: this is for regions of a country and the like, not
    for facts. `most` is checked: the group holds a matrix of nodes by nodes (8 bytes a cell, 32 MB at 2000),
    updated in place merge by merge.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes; cluster a coarser level")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(node, kind="stable").reset_index(drop=True)
        return pd.DataFrame({node: group[node], "cluster": ward(group[features].to_numpy(float), k)})

    return df.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(run, f"`{node}` {df.schema[node].dataType.simpleString()}, cluster int")


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each row: single rows merged pair by pair where that adds least to the squares within, until k are left.
    Columns are standardised first; missing values count as zero."""
    x = np.nan_to_num(x)
    s = x.std(0)
    x = (x - x.mean(0)) / np.where(s > 0, s, 1)
    n, size, of = len(x), np.ones(len(x)), np.arange(len(x))
    square = (x * x).sum(1)
    # what a merge of two clusters adds to the sum of squares: half the squared distance of single nodes
    cost = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0) / 2
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - k):
        i, j = divmod(int(cost.argmin()), n)
        i, j = min(i, j), max(i, j)
        both = size[i] + size[j]
        with np.errstate(invalid="ignore"):
            row = ((size + size[i]) * cost[i] + (size + size[j]) * cost[j] - size * cost[i, j]) / (size + both)
        row[[i, j]] = np.inf
        row[np.isinf(cost[i])] = np.inf
        cost[i, :], cost[:, i] = row, row
        cost[j, :], cost[:, j] = np.inf, np.inf
        size[i], of[of == j] = both, i
    return np.unique(of, return_inverse=True)[1].astype(np.int32)


def clusters_by_date(df: DataFrame, date: str, node: str, features: list[str], k: int, most: int = 2000) -> DataFrame:
    """Ward clusters of the nodes of each date, dates side by side: date, node, cluster. A date's nodes are one group of at
    most `most`, which is checked."""
    if df.groupBy(date).count().where(F.col("count") > most).head(1):
        raise ValueError(f"a date with more than {most} nodes; cluster a coarser level")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(node, kind="stable").reset_index(drop=True)
        return pd.DataFrame({date: group[date], node: group[node], "cluster": ward(group[features].to_numpy(float), k)})

    kind = dict(df.dtypes)
    return df.select(date, node, *features).groupBy(date).applyInPandas(run, f"`{date}` {kind[date]}, `{node}` {kind[node]}, cluster int")

"""Ranking within groups by lambda gradients, for the trees of `boosting`.

A pair of rows of a group with different grades pulls the better one up by how much swapping the two would change the
group's NDCG. That is nothing unless one of them is among the first k, so pairs are those of a group's first k with the rest: k
a row, not all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .boosting import Loss, newton_leaves


def _gain(y: Column) -> Column:
    return F.pow(F.lit(2.0), y) - 1


def _discount(rank: Column, k: int) -> Column:
    return F.when(rank <= k, F.lit(float(np.log(2))) / F.log(rank.cast("double") + 1)).otherwise(0.0)


def _ranked(df: DataFrame, group: list[str], item: str, score: str, y: str, k: int) -> DataFrame:
    """`rank` by score (ties by item) and `ideal`, the greatest DCG of the first k that the group's grades allow."""
    w = Window.partitionBy(*group)
    best = F.row_number().over(w.orderBy(F.desc(y), item))
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), item))).withColumn("__best", best)
    return ranked.withColumn("ideal", F.sum(_gain(F.col(y)) * _discount(F.col("__best"), k)).over(w)).drop("__best")


def lambdas(df: DataFrame, group: list[str], item: str, score: str, y: str, k: int) -> DataFrame:
    """Rows with `g` and `h`, the sums of their pairs' pulls and of the pulls' slopes. item tells a group's rows apart."""
    rows = _ranked(df, group, item, score, y, k)
    me = F.struct(F.col(item).alias("i"), F.col(score).alias("s"), F.col(y).alias("y"), F.col("rank").alias("r"))
    first = rows.where(F.col("rank") <= k).groupBy(*group).agg(F.collect_list(me).alias("__first"))
    met = rows.join(first, group)
    # of a pair the row with the higher grade is pulled up, the other one down by as much
    sign = lambda t: F.signum(F.col(y) - t["y"])
    swap = lambda t: F.abs((_gain(F.col(y)) - _gain(t["y"])) * (_discount(F.col("rank"), k) - _discount(t["r"], k))) / F.col("ideal")
    miss = lambda t: 1 / (1 + F.exp(sign(t) * (F.col(score) - t["s"])))
    pull = F.transform("__first", lambda t: F.when((t["y"] == F.col(y)) | (F.col("ideal") <= 0), F.struct(t["i"].alias("i"), F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))).otherwise(F.struct(t["i"].alias("i"), (sign(t) * miss(t) * swap(t)).alias("g"), (miss(t) * (1 - miss(t)) * swap(t)).alias("h"))))
    met = met.withColumn("__pull", pull)
    total = lambda c: F.aggregate("__pull", F.lit(0.0), lambda a, p: a + p[c])
    own = met.withColumns({"__g": total("g"), "__h": total("h")})
    # rows outside the first k also pull those inside
    back = own.where(F.col("rank") > k).select(*group, F.explode("__pull").alias("p")).groupBy(*group, F.col("p.i").alias(item)).agg((-F.sum("p.g")).alias("__g2"), F.sum("p.h").alias("__h2"))
    out = own.join(back, [*group, item], "left")
    return out.select(*df.columns, (F.col("__g") + F.coalesce("__g2", F.lit(0.0))).alias("g"), (F.col("__h") + F.coalesce("__h2", F.lit(0.0))).alias("h"))


def lambda_loss(group: list[str], item: str, k: int, ridge: float = 1e-3) -> Loss:
    """Ranking within groups by grades y (0, 1, 2, ...), for the NDCG of the first k. `group` and `item` are kept columns."""

    def gradients(df: DataFrame) -> DataFrame:
        out = lambdas(df, ["model", *group], item, "f", "y", k)
        return out.withColumn("h", F.greatest("h", F.lit(1e-9)))

    return Loss(lambda df: {r[0]: 0.0 for r in df.select("model").distinct().collect()}, gradients, newton_leaves(ridge), rereads=True)


def ndcg(df: DataFrame, group: list[str], item: str, score: str, y: str, k: int) -> DataFrame:
    """Mean NDCG of the first k over groups with a grade above zero, and how many groups those are."""
    each = _ranked(df, group, item, score, y, k).groupBy(*group).agg(ratio(F.sum(_gain(F.col(y)) * _discount(F.col("rank"), k)), F.max("ideal")).alias("v"))
    return each.where("v IS NOT NULL").agg(F.count("*").alias("groups"), F.avg("v").alias("ndcg"))

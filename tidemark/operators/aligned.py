"""Clusters of many dates under labels that stay: each date's are matched to those of the date before.

Which of a date's clusters goes with which of the date before rests on their common nodes only, so all matchings are
found side by side. What label a cluster ends with is the chain of matchings back to the first date; that chain runs over a
row per date.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matchings(labels: DataFrame, date: str, node: str, cluster: str, k: int) -> DataFrame:
    """Per date, `match`: for each cluster of the date its cluster of the date before, such that the most nodes keep theirs; of
    equal ones the first in order. The first date keeps its own."""
    if k > 7:
        raise ValueError("all orders of the labels are tried: 7 labels at most")
    dates = labels.select(date).distinct().withColumn("__before", F.lag(date).over(Window.partitionBy(F.lit(0)).orderBy(date)))  # a calendar
    now = labels.join(F.broadcast(dates), date)
    old = labels.select(F.col(date).alias("__before"), node, F.col(cluster).alias("__old"))
    both = now.join(old, ["__before", node]).groupBy(date, cluster, "__old").agg(F.count("*").alias("n"))
    cells = dates.select(date).join(both.groupBy(date).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("__old").alias("o"), "n")).alias("cells")), date, "left")
    orders = list(permutations(range(k)))

    def best(frames):
        for frame in frames:
            found = []
            for cells in frame["cells"]:
                n = {(c["c"], c["o"]): c["n"] for c in (cells if cells is not None else ())}
                found.append(list(max(orders, key=lambda p: sum(n.get((c, o), 0) for c, o in enumerate(p)))))  # noqa: B023
            yield pd.DataFrame({date: frame[date], "match": found})

    return cells.mapInPandas(best, f"`{date}` {dict(labels.dtypes)[date]}, match array<int>")


def aligned(labels: DataFrame, date: str, node: str, cluster: str, k: int) -> DataFrame:
    """Labels with `aligned`, the label that the matchings lead to."""
    held = matchings(labels, date, node, cluster, k)
    chain = F.collect_list("match").over(Window.partitionBy(F.lit(0)).orderBy(date))  # a row per date
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i.cast("int"))
    names = held.select(date, F.aggregate(chain, start, lambda now, match: F.transform(match, lambda o: F.get(now, o))).alias("__names"))
    return labels.join(F.broadcast(names), date).withColumn("aligned", F.get("__names", F.col(cluster))).drop("__names")


def reassignment(labels: DataFrame, date: str, node: str, label: str = "aligned") -> DataFrame:
    """Per date from the second on: nodes that the date before had too, and the share of them with another label."""
    before = Window.partitionBy(node).orderBy(date)
    step = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(date))
    dates = labels.select(date).distinct().withColumn("__k", step)
    seen = labels.join(F.broadcast(dates), date).withColumns({"__old": F.lag(label).over(before), "__then": F.lag("__k").over(before)})
    moved = (F.col("__old") != F.col(label)).cast("int")
    return seen.where(F.col("__then") == F.col("__k") - 1).groupBy(date).agg(F.count("*").alias("n"), F.avg(moved).alias("reassigned"))


def homogeneity(series: DataFrame, groups: DataFrame, date: str, node: str, value: str, label: str, most: int = 2000, least: int = 8) -> DataFrame:
    """Mean correlation over time of pairs of nodes: `relation` within a cluster or between two, with pairs and mean.
    Nodes are a dimension of at most `most`, which is checked; pairs with less than `least` common dates are left out."""
    if groups.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes; use a coarser level")
    own = series.join(groups.select(node, F.col(label).alias("__c")), node).select(date, F.col(node).alias("a"), F.col(value).alias("x"), "__c")
    other = own.select(date, F.col("a").alias("b"), F.col("x").alias("y"), F.col("__c").alias("__d"))
    pairs = own.join(other, date).where("a < b").groupBy("a", "b", "__c", "__d").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    relation = F.when(F.col("__c") == F.col("__d"), "within").otherwise("between").alias("relation")
    return pairs.groupBy(relation).agg(F.count("*").alias("pairs"), F.avg("r").alias("correlation"))

"""Hierarchies, neighbour graphs, evidence fusion and budget rules."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean weighted by w over rows that have both."""
    both = x.isNotNull() & w.isNotNull()
    return ratio(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))


def weighted_std(x: Column, w: Column) -> Column:
    """Population deviation weighted by w, from moments."""
    return F.sqrt(F.greatest(weighted_mean(x * x, w) - weighted_mean(x, w) ** 2, F.lit(0.0)))


def roll_up(df: DataFrame, levels: list[str], extra: list[str], aggregates: list[Column]) -> DataFrame:
    """The aggregates at the leaf, at each coarser level and overall; `level` counts the levels rolled up."""
    depth = sum((F.grouping(c) for c in levels), F.lit(0)).alias("level")
    return df.groupingSets([[*extra, *levels[:n]] for n in range(len(levels), -1, -1)], *extra, *levels).agg(*aggregates, depth)


def rest_gap(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gap and ratio to the mean of the others in the group."""
    w = Window.partitionBy(*keys)
    rest = ratio(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1)
    return df.withColumn("rest_gap", F.col(value) - rest).withColumn("rest_ratio", ratio(F.col(value), rest))


def percent_rank_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank over count, ties sharing their mean rank. Ranks come from counts per distinct value."""
    w = Window.partitionBy(*keys)
    each = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    rank = F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - (F.col("__n") - 1) / 2
    ranks = each.select(*keys, value, (rank / F.sum("__n").over(w)).alias("pct_rank"))
    return df.join(ranks, [*keys, value])


def neighbour_mean(df: DataFrame, edges: DataFrame, node: str, keys: list[str], value: str) -> DataFrame:
    """Weighted mean of a node's neighbours (src, dst, weight), and the log ratio of own value to it."""
    met = df.select(*keys, F.col(node).alias("src"), F.col(value).alias("__v")).join(edges, "src").groupBy(*keys, F.col("dst").alias(node)).agg(weighted_mean(F.col("__v"), F.col("weight")).alias("neighbour_mean"))
    return df.join(met, [*keys, node], "left").withColumn("pressure", F.log((F.col("neighbour_mean") + 1) / (F.col(value) + 1)))


def reconcile(df: DataFrame, keys: list[str], node: str, parent: str, value: str, variance: str) -> DataFrame:
    """Least-squares reconciliation of leaves to their parents' forecasts, a group of one parent at a time.

    Rows: a leaf has its parent's name; the parent's own row has a null parent. With diagonal error
    variances the adjustment is closed: the gap between parent and sum of leaves is shared by variance.
    """
    leaves, tops = df.where(F.col(parent).isNotNull()), df.where(F.col(parent).isNull())
    sums = leaves.groupBy(*keys, parent).agg(F.sum(value).alias("__s"), F.sum(variance).alias("__v"))
    gap = sums.join(tops.select(*keys, F.col(node).alias(parent), F.col(value).alias("__t"), F.col(variance).alias("__tv")), [*keys, parent])
    gap = gap.select(*keys, parent, ratio(F.col("__t") - F.col("__s"), F.col("__v") + F.col("__tv")).alias("__g"), "__tv")
    low = leaves.join(gap, [*keys, parent]).withColumn("reconciled", F.col(value) + F.col(variance) * F.col("__g")).drop("__g", "__tv")
    high = tops.join(gap.select(*keys, F.col(parent).alias(node), "__g", "__tv"), [*keys, node]).withColumn("reconciled", F.col(value) - F.col("__tv") * F.col("__g")).drop("__g", "__tv")
    return low.unionByName(high)


def fuse(df: DataFrame, keys: list[str], value: str, variance: str, prior: float = 0.0, prior_variance: float = 1.0) -> DataFrame:
    """Gaussian posterior of each key: evidence weighted by precision, with a prior."""
    have = F.col(value).isNotNull() & (F.col(variance) > 0)
    precision = 1 / prior_variance + F.coalesce(F.sum(F.when(have, 1 / F.col(variance))), F.lit(0.0))
    mean = (prior / prior_variance + F.coalesce(F.sum(F.when(have, F.col(value) / F.col(variance))), F.lit(0.0))) / precision
    return df.groupBy(*keys).agg(mean.alias("mean"), (1 / precision).alias("variance"), F.sum(have.cast("long")).alias("sources"))


def softmax_weights(df: DataFrame, keys: list[str], score: str, into: str = "weight") -> DataFrame:
    """Softmax within each group, shifted by the group's greatest score so that no score overflows."""
    w = Window.partitionBy(*keys)
    lifted = df.withColumn("__e", F.exp(F.col(score) - F.max(score).over(w)))
    return lifted.withColumn(into, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def phase(level: Column, growth: Column) -> Column:
    """Phase of a wave by level (0 to 1) and growth."""
    return (
        F.when(level.isNull() | growth.isNull(), "unknown").when((level < 0.2) & (growth < 0.1), "baseline").when((growth >= 0.3) & (level < 0.5), "early_growth")
        .when(growth >= 0.1, "acceleration").when((level >= 0.6) & (growth > -0.1), "peak").otherwise("decline")
    )


def permission(failed: Column, clinical: Column, sales: Column) -> Column:
    """What a budget may do: any failed gate blocks; without clinical data calibrate; without sales only watch."""
    return F.when(failed, "blocked").when(~clinical, "calibration_window").when(~sales, "shadow_only").otherwise("limited")


def allocate(df: DataFrame, keys: list[str], node: str, weight: str, least: float, most: float) -> DataFrame:
    """Budget shares of each group in proportion to weight, between a least and a most share that the group
    admits; what caps leave over is dealt again (water filling). A group is one decision: it has as many rows
    as there are regions."""
    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(node, kind="stable")
        w = np.maximum(np.nan_to_num(group[weight].to_numpy(float)), 0)
        n = len(w)
        low, high = min(least, 1 / n), max(most, 1 / n)
        w = w if w.sum() > 0 else np.ones(n)
        share, fixed = np.zeros(n), np.zeros(n, bool)
        while True:
            left = 1 - share[fixed].sum()
            free = ~fixed
            if not free.any():
                break
            total = w[free].sum()
            want = left * w[free] / total if total > 0 else np.full(free.sum(), left / free.sum())
            over, under = np.maximum(want - high, 0).sum(), np.maximum(low - want, 0).sum()
            share[free] = want
            bad = free.copy()
            bad[free] = want > high + 1e-12 if over >= under else want < low - 1e-12
            if not bad.any():
                break
            share[bad] = high if over >= under else low
            fixed |= bad
        return group.assign(share=share)

    schema = df.withColumn("share", F.lit(0.0)).schema
    return df.groupBy(*keys).applyInPandas(fill, schema)


@dataclass
class AlertRule:
    """Clear, watch, alarm, value by value. The baseline is the median of the last clean values; a state eases only after so
    many calm ones. The fields after the limits are all that is remembered."""

    history: int = 7
    watch: float = 1.3
    alarm: float = 2.0
    calm: int = 2
    state: str = "clear"
    quiet: int = 0
    clean: list[float] = field(default_factory=list)

    def step(self, v: float) -> tuple[str, float]:
        """The state after a value, and the baseline that it was held against (nan before three clean values)."""
        base = float(np.median(self.clean)) if len(self.clean) >= 3 else float("nan")
        level = v / base if base and base == base else 1.0
        if level >= self.alarm:
            self.state, self.quiet = "alarm", 0
        elif level >= self.watch:
            self.state, self.quiet = ("alarm" if self.state == "alarm" else "watch"), 0
        else:
            self.quiet += 1
            self.clean = [*self.clean, v][-self.history :]
            if self.quiet >= self.calm:
                self.state = "clear" if self.state != "alarm" else "watch"
                self.quiet = 0 if self.state == "watch" else self.quiet
        return self.state, base


def alert_states(df: DataFrame, keys: list[str], order: str, value: str, history: int = 7, watch: float = 1.3, alarm: float = 2.0, calm: int = 2) -> DataFrame:
    """A per-site state machine (see `AlertRule`). Each site's rows run in order in one group."""
    def run(site: pd.DataFrame) -> pd.DataFrame:
        site = site.sort_values(order, kind="stable")
        rule = AlertRule(history, watch, alarm, calm)
        steps = [rule.step(v) for v in site[value].to_numpy(float)]
        return site.assign(state=[s for s, _ in steps], baseline=pd.Series([b for _, b in steps], index=site.index, dtype=float))

    schema = df.withColumn("state", F.lit("")).withColumn("baseline", F.lit(None).cast("double")).schema
    return df.groupBy(*keys).applyInPandas(run, schema)

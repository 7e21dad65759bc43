"""Distances from days to intervals, what is covered of the days ahead, and intervals for lifts from blocks of weeks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .rowwise import with_running

_EPOCH = "1970-01-01"


def islands(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of each key's intervals (days, ends included): keys, start, end. Overlapping and touching ones are one. Intervals
    without a start or an end, or that end before they start, are left out."""
    days = spans.select(*keys, F.to_date(start).alias("start"), F.to_date(end).alias("end")).where("start <= end")
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start") > F.date_add(before, 1))).cast("int")
    numbered = days.withColumn("__new", opens).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def _number(day: Column) -> Column:
    return F.datediff(day, F.lit(_EPOCH))


def interval_distances(df: DataFrame, spans: DataFrame, keys: list[str], day: str, start: str, end: str, ahead: int = 14) -> DataFrame:
    """Rows with `inside` (their day is in an interval of their key), `days_until` the next start after it, `days_since` the last end
    before it (both `ahead` + 1 where there is none), and `overlap`, the share of the next `ahead` days that intervals cover.

    Days meet starts and ends on one time line, so no day is paired with an interval; covered days are running sums of
    the lengths of islands, less what the last one has still to come. Rows without a day have null features.
    """
    asked = df.select(*keys, F.to_date(day).alias("__day")).where("__day IS NOT NULL").distinct()
    known = spans.select(*keys, F.to_date(start).alias("s"), F.to_date(end).alias("e")).where("s <= e")
    back = lambda c: F.date_sub(F.lit("2100-01-01"), _number(c))  # noqa: E731  time run the other way
    ends = known.select(*keys, F.date_add("e", 1).alias("__at"), _number(F.col("e")).alias("last_end"))
    starts = known.select(*keys, back(F.col("s")).alias("__at"), (-_number(F.col("s"))).alias("next_start"))
    whole = islands(known, keys, "s", "e").select(*keys, F.col("start").alias("__at"), (F.datediff("end", "start") + 1).cast("long").alias("covered"), _number(F.col("end")).alias("open_to"))
    out = with_running(asked.withColumn("__at", F.col("__day")), ends, keys, "__at", [], ["last_end"], 366)
    out = with_running(out.withColumn("__at", back(F.date_add("__day", 1))), starts, keys, "__at", [], ["next_start"], 366)

    def covered(df: DataFrame, at: Column, into: str) -> DataFrame:
        held = with_running(df.withColumn("__at", at), whole, keys, "__at", ["covered"], ["open_to"], 366)
        return held.withColumn(into, F.col("covered") - F.greatest(F.coalesce(F.col("open_to"), F.lit(0)) - _number(at), F.lit(0)) * F.col("open_to").isNotNull().cast("int")).withColumn(f"{into}_to", F.col("open_to")).drop("covered", "open_to")

    out = covered(covered(out, F.col("__day"), "c0"), F.date_add("__day", ahead), "c1")
    n = _number(F.col("__day"))
    far = F.lit(ahead + 1)
    features = out.select(
        *[F.col(k).alias(f"__{k}") for k in keys], "__day", (F.coalesce(F.col("c0_to") >= n, F.lit(False))).alias("inside"), F.coalesce(-F.col("next_start") - n, far).alias("days_until"),
        F.coalesce(n - F.col("last_end"), far).alias("days_since"), ((F.col("c1") - F.col("c0")) / ahead).alias("overlap"),
    )
    match = F.to_date(day) == F.col("__day")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(features, match, "left").drop("__day", *[f"__{k}" for k in keys])


def poisson_draw(*key: Column) -> Column:
    """A draw of a Poisson count of mean 1 that is the same for the same key."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)
    reached, total = F.lit(0), 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        reached = reached + (u >= total).cast("int")
    return reached


def lift_intervals(weeks: DataFrame, keys: list[str], week: str, own: str, base: str, block: int = 4, rounds: int = 500, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The mean of own - base over weeks, with an interval from a paired bootstrap of blocks of consecutive weeks.

    Both series are drawn together, and weeks of a block too, so that what they share and what lasts is kept. A block
    counts as often as a Poisson draw of its (round, block) says: rows are summed into their blocks once and never
    copied; a round is a weighted sum of blocks. Rows where either is null are left out.
    """
    off = F.col(own).cast("double") - F.col(base).cast("double")
    blocks = weeks.where(off.isNotNull() & F.col(week).isNotNull()).groupBy(*keys, F.floor(_number(F.to_date(week)) / (7 * block)).alias("__block")).agg(F.sum(off).alias("__s"), F.count("*").alias("__n"))
    drawn = blocks.withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("__w", poisson_draw(F.col("__round"), F.col("__block")))
    means = drawn.groupBy(*keys, "__round").agg(ratio(F.sum(F.col("__w") * F.col("__s")), F.sum(F.col("__w") * F.col("__n"))).alias("__m"))
    bounds = means.groupBy(*keys).agg(F.percentile("__m", F.lit(low)).alias("low"), F.percentile("__m", F.lit(high)).alias("high"))
    return blocks.groupBy(*keys).agg((F.sum("__s") / F.sum("__n")).alias("lift"), F.count("*").alias("blocks")).join(bounds, keys)

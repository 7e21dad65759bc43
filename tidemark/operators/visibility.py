"""What was known when: as-of filters, as-of joins, vintages and fallbacks.

Every operator takes its cutoff explicitly; none reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, cutoff: Column, event: str, available: str, strict: bool = True) -> DataFrame:
    """Rows known at the cutoff. An unknown availability falls back to the event time; not strict, only the
    event time counts."""
    rule = (F.col(available) <= cutoff) | (F.col(available).isNull() & (F.col(event) <= cutoff)) if strict else F.col(event) <= cutoff
    return df.where(rule)


def visible_known(df: DataFrame, cutoff: Column, event: str, *available: str) -> DataFrame:
    """Rows of days up to the cutoff whose every availability is known and in time: null is not visible."""
    rule = F.to_date(event) <= F.to_date(cutoff)
    for c in available:
        rule &= F.col(c).isNotNull() & (F.col(c) <= cutoff)
    return df.where(rule)


def with_availability(df: DataFrame, event: str, available: str, source: str, lags: dict[str, int], usual: int) -> DataFrame:
    """`known_at`, the availability or the event time plus the source's usual lag in days, and `inferred`."""
    lag = F.lit(usual)
    for name, days in lags.items():
        lag = F.when(F.col(source) == name, F.lit(days)).otherwise(lag)
    return df.withColumn("known_at", F.coalesce(F.col(available), F.col(event) + F.make_dt_interval(lag))).withColumn("inferred", F.col(available).isNull())


def latest_revision(df: DataFrame, keys: list[str], cutoff: Column, published: str, ties: list[str]) -> DataFrame:
    """Of each key the last revision published by the cutoff (one aggregate, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(published, *ties)).alias("__r")
    return df.where(F.col(published) <= cutoff).groupBy(*keys).agg(last).select(*keys, "__r.*")


def latest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of each key's greatest order value; ties stay."""
    best = df.groupBy(*keys).agg(F.max(order).alias("__best"))
    return df.join(best, keys).where(F.col(order) == F.col("__best")).drop("__best")


def last_two(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of each key the last value and the one before it."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n <= 2").groupBy(*keys).agg(F.max(F.when(F.col("__n") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("__n") == 2, F.col(value))).alias("previous"))


def asof_lags(df: DataFrame, keys: list[str], cutoff: Column, day: str, value: str, lags: list[int]) -> DataFrame:
    """Of each key the value as of the cutoff and as of so many days before, in one aggregate."""
    held = [F.max_by(F.when(F.col(day) <= F.date_sub(cutoff, n), F.col(value)), F.when(F.col(day) <= F.date_sub(cutoff, n), F.col(day))).alias(f"lag_{n}") for n in lags]
    return df.where(F.col(day) <= cutoff).groupBy(*keys).agg(*held)


def asof_scaled(df: DataFrame, keys: list[str], cutoff: Column, day: str, value: str, lags: list[int], days: int = 365) -> DataFrame:
    """Of each key the value as of the cutoff (`lag_0`) and as of so many days before, each over the greatest value of the
    `days` up to the cutoff; zero where that is not above zero, or where nothing was known by then."""
    late = F.col(day) > F.date_sub(cutoff, days)
    held = asof_lags(df, keys, cutoff, day, value, [0, *lags])
    top = df.where((F.col(day) <= cutoff) & late).groupBy(*keys).agg(F.max(value).alias("__top"))
    share = lambda c: F.coalesce(F.when(F.col("__top") > 0, F.col(c) / F.col("__top")), F.lit(0.0))
    return held.join(top, keys, "left").select(*keys, *[share(f"lag_{n}").alias(f"lag_{n}") for n in (0, *lags)])


def future_window(df: DataFrame, keys: list[str], cutoff: Column, day: str, value: str, first: int, last: int, rise: float) -> DataFrame:
    """Of each key what the days from `first` to `last` after the cutoff brought: `now` (as of the cutoff), `peak`, `n` days, and
    `label`, whether the peak is `rise` times now at least; null without a value now or then. For evaluation only."""
    ahead = F.datediff(day, cutoff)
    inside = (ahead >= first) & (ahead <= last)
    m = df.groupBy(*keys).agg(F.max_by(F.when(ahead <= 0, F.col(value)), F.when(ahead <= 0, F.col(day))).alias("now"), F.max(F.when(inside, F.col(value))).alias("peak"), F.count(F.when(inside, F.lit(1))).alias("n"))
    return m.withColumn("label", (F.col("peak") >= rise * F.col("now")).cast("int"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, order: list[str] = (), days: int = 7) -> DataFrame:
    """Each left row with the right value last seen at or before its time.

    Both sides are laid on one time line per key, cut into stretches of so many days, and the last value is
    carried forward in each stretch by a window; what an earlier stretch left is carried over by one row per
    stretch. So no pairs are made and no task holds more than a key's stretch. A right row counts before a left
    row of the same time, and of right rows of one time the greatest value counts; null values are skipped.
    """
    stretch = F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / (86400 * days))
    kind = right.schema[value].dataType
    seen = right.select(*keys, at, F.col(value).alias("__value")).withColumn("__left", F.lit(0)).withColumn("__s", stretch)
    line = left.withColumn("__value", F.lit(None).cast(kind)).withColumn("__left", F.lit(1)).withColumn("__s", stretch)
    ends = seen.where("__value IS NOT NULL").groupBy(*keys, "__s").agg(F.max_by("__value", F.struct(at, "__value")).alias("__end"))
    w = Window.partitionBy(*keys, "__s").orderBy(F.col(at), "__left", F.col("__value").asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, 0)
    inside = line.unionByName(seen, allowMissingColumns=True).withColumn("__own", F.last("__value", ignorenulls=True).over(w)).where("__left = 1")
    # a row for each stretch of a key that either side has: few, as time has few stretches
    all_ = line.select(*keys, "__s").distinct().join(ends, [*keys, "__s"], "full")
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).where("__carried IS NOT NULL").drop("__end")
    return inside.join(carried, [*keys, "__s"], "left").withColumn("asof_value", F.coalesce("__own", "__carried")).select(*left.columns, "asof_value")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], day: str, value: str, tolerance: int) -> DataFrame:
    """Each left row with the right value nearest in days, within the tolerance; of two as near, the earlier,
    and of one day's values the least. Left rows without one are left out.

    Either side is reduced to its days first, so pairs are made of days and not of rows: a day of a key meets
    the days of three buckets as wide as the tolerance by equality.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / tolerance)
    near = right.groupBy(*keys, F.col(day).alias("__day")).agg(F.min(value).alias("nearest_value")).withColumn("__b", bucket(F.col("__day")))
    asked = left.select(*keys, day).distinct().withColumn("__b", F.explode(F.array(*[bucket(F.col(day)) + d for d in (-1, 0, 1)])))
    apart = F.abs(F.datediff(day, "__day"))
    best = F.min_by(F.struct(F.col("__day").alias("nearest_day"), "nearest_value"), F.struct(apart, "__day")).alias("__r")
    found = asked.join(near, [*keys, "__b"]).where(apart <= tolerance).groupBy(*keys, day).agg(best).select(*keys, day, "__r.*")
    return left.join(found, [*keys, day])


def without_superseded(df: DataFrame, keys: list[str], fallback: Column) -> DataFrame:
    """Rows, less fallback rows (say, national ones) whose keys have a row that is no fallback."""
    return df.where(~fallback).unionByName(df.where(fallback).join(df.where(~fallback).select(*keys).distinct(), keys, "left_anti"))


def in_interval(df: DataFrame, day: str, spans: DataFrame, start: str, end: str, flag: str) -> DataFrame:
    """A flag for rows whose day is in any interval. Intervals are few and bounded by the calendar: they
    are unrolled to distinct days, at most 366 a year, and met by equality."""
    days = spans.select(F.explode(F.sequence(start, end)).alias(day)).distinct().withColumn(flag, F.lit(True))
    return df.join(days, day, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def best_alias(df: DataFrame, keys: list[str], name: str, order: list[str], ties: list[str]) -> DataFrame:
    """One row per key, of the alias that comes first in the order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name))
    w = Window.partitionBy(*keys).orderBy(F.when(rank > 0, rank).otherwise(len(order) + 1), *ties)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_run(df: DataFrame, cutoff: Column, run: str, available: str, target: str) -> DataFrame:
    """Rows of the latest forecast run known at the cutoff, for targets after it."""
    known = df.where((F.col(available) <= cutoff) & (F.col(run) <= cutoff))
    last = known.agg(F.max(run).alias(run))
    return known.join(F.broadcast(last), run).where(F.col(target) > cutoff)


def latest_runs(df: DataFrame, run: str, most: int, full: int) -> DataFrame:
    """Rows of the latest runs. Runs of fewer points than `full` are left out, unless there are no others."""
    sizes = df.groupBy(run).agg(F.count("*").alias("__n"))
    best = sizes.groupBy().agg(F.max("__n").alias("__most"))
    # runs are dates: the few latest are told by one top-k
    kept = sizes.join(F.broadcast(best)).where((F.col("__n") >= full) | (F.col("__most") < full)).orderBy(F.desc(run)).limit(most).select(run)
    return df.join(F.broadcast(kept), run, "left_semi")

"""Panels at every issue date: what was known at each of many cutoffs, in one pass over all revisions.

A revision is known from its publication until the next one of its key is; that is a half-open interval of days.
Intervals are laid on the weeks they cover, no further back than a feature looks, and meet the cutoffs of a week by
equality. So a revision is copied to the issues that can see it, at most `lookback` / 7 times, and never to all of them;
whatever is summed is summed by issue and key, so a hot key is spread over its issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio, relative_delta, week_start



def validity(df: DataFrame, keys: list[str], published: str, ties: list[str] = ()) -> DataFrame:
    """Revisions of each key with `known_from` and `known_to`, the days from which it is known and superseded (null: never).
    Of one day's revisions the last in the order of `ties` counts. A revision without a publication is never known."""
    day = F.to_date(published)
    w = Window.partitionBy(*keys).orderBy(published, *ties)
    known = df.where(F.col(published).isNotNull()).withColumn("known_from", day).withColumn("known_to", F.lead(day).over(w))
    return known.where(F.col("known_to").isNull() | (F.col("known_to") > F.col("known_from")))


def calendar(df: DataFrame, day: str, horizon: int, by: list[str] = ()) -> DataFrame:
    """An issue a week from the first to the last day: `issue` (its Monday), `cutoff` (its Sunday, or the last day) and
    `target`, the Monday of the week that lies so many days after the cutoff. by: for each of these keys."""
    span = df.groupBy(*by).agg(F.min(F.to_date(day)).alias("__a"), F.max(F.to_date(day)).alias("__b")).where("__a IS NOT NULL")
    weeks = span.withColumn("issue", F.explode(F.sequence(week_start(F.col("__a")), week_start(F.col("__b")), F.make_interval(days=F.lit(7)))))
    cut = weeks.withColumn("cutoff", F.least(F.date_add("issue", 6), F.col("__b")))
    return cut.withColumn("target", week_start(F.date_add("cutoff", horizon))).drop("__a", "__b")


def _slot(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-05")) / 7)


def known_at(intervals: DataFrame, issues: DataFrame, day: str, lookback: int, by: list[str] = ()) -> DataFrame:
    """Each issue with the revisions known at its cutoff, of days up to the cutoff and at most `lookback` before.

    issues: rows with a `cutoff` (and the keys of `by`, where each key has a calendar of its own). Cutoffs may lie anywhere.
    """
    first = F.greatest(F.col("known_from"), F.to_date(day))
    last = F.least(F.date_sub("known_to", 1), F.date_add(F.to_date(day), lookback))
    laid = intervals.withColumns({"__first": first, "__last": last}).where("__first <= __last").withColumn("__slot", F.explode(F.sequence(_slot(F.col("__first")), _slot(F.col("__last")))))
    cutoffs = issues.withColumn("__slot", _slot(F.col("cutoff")))
    # one calendar for all is a row per issue; calendars by key are a table like others
    return laid.join(cutoffs if by else F.broadcast(cutoffs), ["__slot", *by]).where(F.col("cutoff").between(F.col("__first"), F.col("__last"))).drop("__slot", "__first", "__last", "known_from", "known_to")


def signal_features(seen: DataFrame, keys: list[str], day: str, value: str, size: str, least: int = 8) -> DataFrame:
    """Per key and issue: level, its lags, slopes, spread and coverage, from the days of `known_at` (one row a day).

    Lags that nothing is known for count as zero. size: a count of sources behind a day. Issues at which a key has less
    than `least` days are left out. The lookback of `known_at` bounds how old a lag can be.
    """
    at, back = F.col("cutoff"), lambda n: F.to_date(day) <= F.date_sub("cutoff", n)
    asof = lambda c, n: F.coalesce(F.max_by(F.when(back(n), F.col(c)), F.when(back(n), F.col(day))), F.lit(0.0))
    window = lambda c, n: F.when(F.to_date(day) >= F.date_sub("cutoff", n), F.col(c))
    gone = lambda n: F.lit(n) - F.count(F.when(F.to_date(day) > F.date_sub("cutoff", n), F.lit(1)))
    held = seen.groupBy(*keys, "cutoff").agg(
        F.count("*").alias("n_days"), asof(value, 0).alias("level"), *[asof(value, n).alias(f"lag_{n}") for n in (4, 7, 14)],
        F.avg(window(value, 7)).alias("mean_7"), F.stddev_pop(window(value, 7)).alias("std_7"), F.percentile(window(value, 28), F.lit(0.5)).alias("__median"),
        asof(size, 0).alias("sources"), asof(size, 7).alias("__sources_7"), F.percentile(window(size, 28), F.lit(0.5)).alias("__sources_28"),
        gone(7).alias("missing_7"), gone(14).alias("missing_14"), F.max(F.to_date(day)).alias("__last"),
    ).where(F.col("n_days") >= least)
    level, lag7 = F.col("level"), F.col("lag_7")
    out = held.withColumns({"slope_7": relative_delta(level, lag7), "__slope_14": relative_delta(lag7, F.col("lag_14")), "age_days": F.datediff(at, "__last"), "coverage_28": F.col("sources") / F.greatest(F.coalesce("__sources_28", F.lit(0.0)), F.lit(1.0))})
    out = out.withColumns({
        "acceleration_7": F.col("slope_7") - F.col("__slope_14"), "mean_7": F.coalesce("mean_7", F.lit(0.0)), "std_7": F.coalesce("std_7", F.lit(0.0)), "level_vs_28d": level - F.coalesce("__median", F.lit(0.0)),
        "sources_delta_7": F.col("sources") - F.col("__sources_7"), "sources_ratio_7": relative_delta(F.col("sources"), F.col("__sources_7")), "coverage_break": F.col("coverage_28") < 0.75,
    })
    return out.drop("__median", "__sources_7", "__sources_28", "__last", "__slope_14")


def surroundings(features: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Features with the means of the neighbours and of all nodes at the same issue. edges: src, dst of a small graph.
    A node without a known neighbour has zeros."""
    three = ["level", "slope_7", "acceleration_7"]
    near = edges.join(features.select(F.col(node).alias("src"), "cutoff", *three), "src").groupBy(F.col("dst").alias(node), "cutoff").agg(F.avg("level").alias("neighbour_level"), F.avg("slope_7").alias("neighbour_slope_7"))
    all_ = features.groupBy("cutoff").agg(F.avg("level").alias("national_level"), F.avg("slope_7").alias("national_slope_7"), F.avg("acceleration_7").alias("national_acceleration_7"))
    out = features.join(near, [node, "cutoff"], "left").join(all_, "cutoff").fillna(0.0, ["neighbour_level", "neighbour_slope_7"])
    level = F.col("level")
    return out.withColumns({"vs_neighbours": level - F.col("neighbour_level"), "vs_national": level - F.col("national_level"), "share_of_national": level / F.greatest(F.abs("national_level"), F.lit(1.0))})


def truth_features(seen: DataFrame, keys: list[str], week: str, value: str, least: int = 8, recent: int = 12) -> DataFrame:
    """Per key and issue: the last known weekly value, those 1, 2, 4 and 8 known weeks before, momenta, age, and `recent`,
    the last known values. Issues with less than `least` known weeks are left out."""
    rows = F.reverse(F.array_sort(F.collect_list(F.struct(F.to_date(week).alias("w"), F.col(value).cast("double").alias("v")))))
    held = seen.groupBy(*keys, "cutoff").agg(rows.alias("__r")).where(F.size("__r") >= least)
    lag = lambda k: F.coalesce(F.get("__r", F.lit(k))["v"], F.lit(0.0))
    out = held.select(*keys, "cutoff", F.size("__r").alias("n_weeks"), lag(0).alias("current"), *[lag(k).alias(f"lag_{k}w") for k in (1, 2, 4, 8)], F.datediff("cutoff", F.col("__r")[0]["w"]).alias("truth_age_days"), F.transform(F.slice("__r", 1, recent), lambda x: x["v"]).alias("recent"))
    return out.withColumns({"momentum_2w": relative_delta(F.col("lag_1w"), F.col("lag_2w")), "momentum_4w": relative_delta(F.col("lag_1w"), F.col("lag_4w"))})


def seasonal_at(intervals: DataFrame, issues: DataFrame, keys: list[str], week: str, value: str, years: int = 30) -> DataFrame:
    """Per key and issue, `seasonal`: the values known at the cutoff of earlier weeks that lie in the target's week of the
    year or beside it, on a ring of 52 weeks.

    A week serves the issues whose targets are about whole years after it, so it is laid on three weeks of the
    year and meets the issues of each, one a year; how many years back is bounded by `years`.
    """
    ring = lambda d: F.least(F.weekofyear(d), F.lit(52))
    serves = F.array(*[F.pmod(ring(F.col(week)) - 1 + d, F.lit(52)) + 1 for d in (-1, 0, 1)])
    laid = intervals.withColumn("__ring", F.explode(serves))
    met = laid.join(F.broadcast(issues.withColumn("__ring", ring(F.col("target")))), "__ring")  # a row per issue
    known = (F.col("known_from") <= F.col("cutoff")) & (F.col("known_to").isNull() | (F.col("known_to") > F.col("cutoff")))
    fits = known & (F.to_date(week) <= F.col("cutoff")) & (F.col(week) < F.col("target")) & (F.col(week) >= F.add_months("target", -12 * years))
    return met.where(fits).groupBy(*keys, "cutoff").agg(F.collect_list(F.col(value).cast("double")).alias("seasonal"))


def median_of(values: Column) -> Column:
    """Median of an array, null if it is empty."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def with_baseline(panel: DataFrame, seasonal: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """`baseline` and `mad` (1 at least) of the seasonal values, or of the recent ones where those are fewer than `least`."""
    both = panel.join(seasonal, [*keys, "cutoff"], "left")
    chosen = F.when(F.size("seasonal") >= least, F.col("seasonal")).otherwise(F.col("recent"))
    out = both.withColumn("__v", chosen).withColumn("baseline", F.coalesce(median_of(F.col("__v")), F.lit(0.0)))
    return out.withColumn("mad", F.greatest(F.coalesce(median_of(F.transform("__v", lambda v: F.abs(v - F.col("baseline")))), F.lit(1.0)), F.lit(1.0))).drop("__v", "seasonal", "recent")


def issue_panel(signal: DataFrame, truth: DataFrame, edges: DataFrame, node: str, horizon: int, value: str = "v", size: str = "n", day: str = "day", week: str = "week", published: str = "published", lookback: int = 56, truth_lookback: int = 182, least: int = 8) -> DataFrame:
    """A row for each node and issue at which both series are known well enough: features as they stood at the cutoff, and
    the target week's value.

    signal: revisions of days (node, day, value, size, published); truth: revisions of weeks (node, week, value,
    published). Features see what was published by the cutoff, so a later revision changes no earlier issue; only `next`,
    the target's value, is the last revision of all (null where the week isn't there).
    """
    days, weeks = validity(signal, [node, day], published), validity(truth, [node, week], published)
    issues = calendar(signal, day, horizon)
    own = surroundings(signal_features(known_at(days, issues, day, lookback), [node], day, value, size, least), edges, node)
    known = truth_features(known_at(weeks, issues.select("cutoff"), week, truth_lookback), [node], week, value, least)
    known = with_baseline(known, seasonal_at(weeks, issues, [node], week, value), [node])
    last = truth.groupBy(node, F.col(week).alias("target")).agg(F.max_by(value, published).alias("next"))
    panel = own.join(known, [node, "cutoff"]).join(issues, "cutoff").join(last, [node, "target"], "left")
    gap = F.col("current") - F.col("baseline")
    return panel.withColumns({"baseline_gap": gap, "baseline_z": gap / F.col("mad"), "target_week_iso": F.weekofyear("target")})


def at_all_issues(history: DataFrame, issues: DataFrame, keys: list[str], day: str, published: str, lookback: int) -> DataFrame:
    """Per issue the history a forecaster would have had: the revisions of `known_at` with `issue` and `age` in days."""
    return known_at(validity(history, [*keys, day], published), issues, day, lookback).withColumn("age", F.datediff("cutoff", F.to_date(day)))


def vintage_benchmark(history: DataFrame, issues: DataFrame, truth: DataFrame, candidates: dict[str, Column], keys: list[str], day: str, value: str, published: str, lookback: int, loss: str = "mae") -> DataFrame:
    """Candidates forecast the target of each issue from what was known then; `rank` orders them by their mean absolute error.

    A candidate is an aggregate over an issue's history (columns of the history, `age`); all are computed in one pass.
    truth: the keys, `target` and `actual`. Returns candidate, n, mae, rmse, bias, champion.
    """
    seen = at_all_issues(history, issues, keys, day, published, lookback)
    made = seen.groupBy(*keys, "cutoff", "target").agg(*[c.alias(name) for name, c in candidates.items()]).join(truth, [*keys, "target"])
    each = made.select(*keys, "cutoff", "actual", F.explode(F.create_map(*[x for name in candidates for x in (F.lit(name), F.col(name).cast("double"))])).alias("candidate", "forecast")).where("forecast IS NOT NULL AND actual IS NOT NULL")
    off = F.col("forecast") - F.col("actual")
    board = each.groupBy("candidate").agg(F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias"), ratio(F.sum(F.abs(off)), F.sum(F.abs("actual"))).alias("wape"))
    best = Window.partitionBy(F.lit(0)).orderBy(loss, "candidate")  # a row per candidate
    return board.withColumn("champion", F.row_number().over(best) == 1)


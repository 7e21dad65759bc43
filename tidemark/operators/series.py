"""Time-series operators over (key, day, value) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def dense(df: DataFrame, keys: list[str], day: str, step: int = 1) -> DataFrame:
    """Every day (or step) from each key's first to its last, with the rows that are there."""
    grid = df.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    grid = grid.select(*keys, F.explode(F.sequence("__a", "__b", F.make_interval(days=F.lit(step)))).alias(day))
    return grid.join(df, [*keys, day], "left")


def fill_forward(df: DataFrame, keys: list[str], day: str, value: str, into: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def interpolate(df: DataFrame, keys: list[str], day: str, value: str, into: str) -> DataFrame:
    """Linear in time between known values; before the first and after the last, the nearest one."""
    w = Window.partitionBy(*keys).orderBy(day)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__a", a).withColumn("__b", b)
    at = ratio(F.datediff(day, "__a.d"), F.datediff("__b.d", "__a.d"))
    between = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * F.coalesce(at, F.lit(0.0))
    return df.withColumn(into, F.coalesce(between, F.col("__a.v"), F.col("__b.v"))).drop("__a", "__b")


def lags(df: DataFrame, keys: list[str], order: str, value: str, steps: list[int]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in steps})


def rolling(df: DataFrame, keys: list[str], order: str, value: str, widths: list[int]) -> DataFrame:
    """Trailing mean, population deviation, least and most over so many rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = {}
    for n in widths:
        span = w.rowsBetween(-(n - 1), 0)
        out |= {f"mean_{n}": F.avg(value).over(span), f"std_{n}": F.stddev_pop(value).over(span), f"min_{n}": F.min(value).over(span), f"max_{n}": F.max(value).over(span)}
    return df.withColumns(out)


def rolling_quantile(df: DataFrame, keys: list[str], order: str, value: str, q: float, width: int, least: int, into: str) -> DataFrame:
    """Quantile of the rows before, null with fewer than so many."""
    span = Window.partitionBy(*keys).orderBy(order).rowsBetween(-width, -1)
    return df.withColumn(into, F.when(F.count(value).over(span) >= least, F.percentile(value, F.lit(q)).over(span)))


def rolling_slope(df: DataFrame, keys: list[str], order: str, value: str, width: int, into: str) -> DataFrame:
    """Least-squares slope per row over the last rows, from running sums."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__x", F.row_number().over(w).cast("double"))
    span = w.rowsBetween(-(width - 1), 0)
    n, x, y = F.count(value).over(span), F.sum("__x").over(span), F.sum(value).over(span)
    xy, xx = F.sum(F.col("__x") * F.col(value)).over(span), F.sum(F.col("__x") * F.col("__x")).over(span)
    return df.withColumn(into, ratio(n * xy - x * y, n * xx - x * x)).drop("__x")


def log_ratio_to_baseline(df: DataFrame, keys: list[str], order: str, value: str, width: int = 52) -> DataFrame:
    """Median of the rows before as `baseline`, and log((value + 1) / (baseline + 1))."""
    span = Window.partitionBy(*keys).orderBy(order).rowsBetween(-width, -1)
    df = df.withColumn("baseline", F.percentile(value, F.lit(0.5)).over(span))
    return df.withColumn("log_ratio", F.log((F.col(value) + 1) / (F.col("baseline") + 1)))


def growth(df: DataFrame, keys: list[str], day: str, value: str, days: int) -> DataFrame:
    """Relative growth over the last value at least so many days back, and its change since the last known."""
    number = F.datediff(day, F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(number)
    before = F.last(value, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -days))
    df = df.withColumn("growth", (F.col(value) - before) / F.greatest(F.abs(before), F.lit(1.0)))
    return df.withColumn("acceleration", F.col("growth") - F.last("growth", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def seasonal_baseline(df: DataFrame, keys: list[str], week: str, value: str, least: int = 5, recent: int = 12) -> DataFrame:
    """Median and MAD of each week's history in the same ISO week or one beside it, over a year of 52 weeks
    taken as a ring; with fewer than `least` such weeks, of the last `recent`.

    A week meets its earlier weeks by equality of (key, week of the year) after the history has been laid on
    the three weeks it serves, so pairs stay in the order of years per week.
    """
    base = df.select(*keys, F.col(week).alias("__week"), F.col(value).cast("double").alias("__value"), F.least(F.weekofyear(week), F.lit(52)).alias("__w"))
    serves = base.withColumn("__for", F.explode(F.array(*[F.pmod(F.col("__w") - 1 + d, F.lit(52)) + 1 for d in (-1, 0, 1)]))).select(*keys, F.col("__for").alias("__w"), F.col("__week").alias("__then"), F.col("__value").alias("__old"))
    near = base.join(serves, [*keys, "__w"]).where("__then < __week")
    two = lambda pairs: _median_mad(pairs, [*keys, "__week"])
    seasonal = two(near).where(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy("__week").rowsBetween(-recent, -1)
    late = base.withColumn("__before", F.collect_list("__value").over(w)).withColumn("__old", F.explode_outer("__before"))
    usual = two(late)
    out = usual.join(seasonal.select(*keys, "__week", F.col("median").alias("s_median"), F.col("mad").alias("s_mad")), [*keys, "__week"], "left")
    return out.select(*keys, F.col("__week").alias(week), F.coalesce("s_median", "median").alias("baseline"), F.coalesce("s_mad", "mad").alias("mad"), F.col("s_median").isNotNull().alias("seasonal"))


def _median_mad(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Median of __old per key, and the median distance from it: two passes over the same partitioning."""
    middle = pairs.groupBy(*keys).agg(F.percentile("__old", F.lit(0.5)).alias("median"), F.count("__old").alias("n"))
    return pairs.join(middle, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.first("n").alias("n"), F.percentile(F.abs(F.col("__old") - F.col("median")), F.lit(0.5)).alias("mad"))


def segments(df: DataFrame, keys: list[str], order: str, on: Column, least: int = 1) -> DataFrame:
    """Runs of rows where `on` holds: first and last order value and length, of at least so many rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__on", F.coalesce(on, F.lit(False)))
    df = df.withColumn("__run", F.sum(F.when(F.col("__on") & F.coalesce(F.lag("__on").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("__on").groupBy(*keys, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__run")


def sustained_growth(df: DataFrame, keys: list[str], order: str, value: str, runs: int, rise: float) -> DataFrame:
    """Of each key the first row from which the value rises so many times in a row and by so much in all."""
    w = Window.partitionBy(*keys).orderBy(order)
    up = (F.lead(value).over(w) > F.col(value)).cast("int")
    df = df.withColumn("__up", up)
    ahead = w.rowsBetween(0, runs - 1)
    whole = (F.min("__up").over(ahead) == 1) & (F.count("__up").over(ahead) == runs)
    total = F.lead(value, runs).over(w) >= F.col(value) * (1 + rise)
    return df.where("true").withColumn("__ok", whole & total).where("__ok").groupBy(*keys).agg(F.min(order).alias("onset"))


def smoothed(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Median of each row and its neighbours."""
    return df.withColumn("smooth", F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)))


def direct_target(df: DataFrame, keys: list[str], order: str, value: str, steps: int, rise: float) -> DataFrame:
    """The value so many rows ahead, its relative growth and whether that is an event; rows without it go."""
    df = df.withColumn("target", F.lead(value, steps).over(Window.partitionBy(*keys).orderBy(order))).where("target IS NOT NULL")
    df = df.withColumn("target_growth", (F.col("target") - F.col(value)) / F.greatest(F.abs(F.col(value)), F.lit(1.0)))
    return df.withColumn("event", (F.col("target_growth") >= rise).cast("int"))


def convolve(df: DataFrame, keys: list[str], index: str, value: str, kernel: list[float]) -> DataFrame:
    """Delay kernel over integer steps from 0; before the start the first value stands."""
    ages = F.explode(F.array(*[F.struct(F.lit(a).alias("age"), F.lit(float(w)).alias("w")) for a, w in enumerate(kernel)]))
    asked = df.select(*keys, F.col(index).alias("__t"), ages.alias("k")).select(*keys, "__t", "k.w", F.greatest(F.col("__t") - F.col("k.age"), F.lit(0)).alias(index))
    return asked.join(df, [*keys, index]).groupBy(*keys, F.col("__t").alias(index)).agg(F.sum(F.col("w") * F.col(value)).alias("convolved"))


def week_profile(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Mean, deviation, count and range per week of the year 1 to 52; weeks without rows are zero."""
    got = df.groupBy(*keys, F.weekofyear(day).alias("week")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(52))).alias("week"))
    return grid.join(got, [*keys, "week"], "left").fillna(0, ["mean", "std", "n", "least", "most"])


def lag_correlations(a: DataFrame, b: DataFrame, keys: list[str], day: str, lags: list[int], least: int = 3) -> DataFrame:
    """Pearson correlation of a's value with b's so many days later, per lag; null where either is constant.

    a's rows are laid on the days they meet (a bounded number of lags) and joined by equality.
    """
    shifted = a.select(*keys, F.col(day).alias("__d"), F.col("value").alias("x"), F.explode(F.array(*[F.lit(n) for n in lags])).alias("lag")).withColumn(day, F.date_add("__d", F.col("lag")))
    pairs = shifted.join(b.select(*keys, day, F.col("value").alias("y")), [*keys, day]).where("x IS NOT NULL AND y IS NOT NULL")
    n, sx, sy = F.count("*"), F.stddev_pop("x"), F.stddev_pop("y")
    moments = pairs.groupBy(*keys, "lag").agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.covar_pop("x", "y").alias("c"))
    return moments.where(F.col("n") >= least).select(*keys, "lag", "n", F.when((F.col("sx") > 1e-12) & (F.col("sy") > 1e-12), ratio(F.col("c"), F.col("sx") * F.col("sy"))).alias("corr"))


def best_lag(corrs: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of the highest correlation; of equal ones the shortest."""
    return corrs.where("corr IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct("lag", "corr"), F.struct("corr", -F.abs("lag"), -F.col("lag"))).alias("b")).select(*keys, F.col("b.lag").alias("best_lag"), F.col("b.corr").alias("best_corr"))


def lag_distribution(corrs: DataFrame, keys: list[str], sharp: float = 8.0) -> DataFrame:
    """Softmax of positive correlations over lags: mean, mode, 10th and 90th percentile, entropy (0 to 1)."""
    w = Window.partitionBy(*keys)
    weight = F.exp(sharp * F.greatest(F.coalesce("corr", F.lit(0.0)), F.lit(0.0)))
    p = corrs.withColumn("__w", weight).withColumn("p", F.col("__w") / F.sum("__w").over(w)).withColumn("cum", F.sum("p").over(w.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(*keys).agg(
        F.sum(F.col("p") * F.col("lag")).alias("mean_lag"),
        F.max_by("lag", F.struct("p", -F.col("lag"))).alias("mode_lag"),
        F.min(F.when(F.col("cum") >= 0.1, F.col("lag"))).alias("p10"),
        F.min(F.when(F.col("cum") >= 0.9, F.col("lag"))).alias("p90"),
        F.when(F.count("*") > 1, -F.sum(F.col("p") * F.log("p")) / F.log(F.count("*").cast("double"))).otherwise(0.0).alias("entropy"),
    )




def signal_features(df: DataFrame, keys: list[str], day: str, value: str, cutoff: Column, prefix: str) -> DataFrame:
    """One row per key as of a cutoff: level, lags, trailing means, deviations and ranges, a 28-day z score,
    change, slopes, acceleration, days since the peak and the age of the last row. Windows are calendar days
    up to the cutoff; everything comes from one aggregate over the visible rows."""
    age = F.datediff(cutoff, F.col(day))
    seen = df.where(F.col(day) <= cutoff).withColumn("__age", age)
    within = lambda n: F.when(F.col("__age") < n, F.col(value))
    asof = lambda n: F.max_by(F.when(F.col("__age") >= n, F.col(value)), F.when(F.col("__age") >= n, -F.col("__age")))
    x = lambda n: F.when(F.col("__age") < n, -F.col("__age").cast("double"))
    slope = lambda n: F.when(F.var_pop(x(n)) > 0, F.try_divide(F.covar_pop(within(n), x(n)), F.var_pop(x(n))))
    out = {"level": asof(0), "age_days": F.min("__age")}
    out |= {f"lag_{n}": asof(n) for n in (1, 3, 7, 14, 21, 28)}
    for n in (3, 7, 14):
        out |= {f"mean_{n}": F.avg(within(n)), f"std_{n}": F.stddev_pop(within(n)), f"min_{n}": F.min(within(n)), f"max_{n}": F.max(within(n))}
    out |= {"slope_7": slope(7), "slope_14": slope(14), "mean_28": F.avg(within(28)), "std_28": F.stddev_pop(within(28)), "missing_28": 28 - F.countDistinct(F.when(F.col("__age") < 28, F.col(day)))}
    out |= {"days_since_peak": F.max_by("__age", F.struct(value, -F.col("__age")))}
    wide = seen.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])
    wide = wide.withColumn("z_28", ratio(F.col("level") - F.col("mean_28"), F.nullif(F.col("std_28"), F.lit(0.0)))).withColumn("change_7", (F.col("level") - F.col("lag_7")) / F.greatest(F.abs("lag_7"), F.lit(1.0)))
    wide = wide.withColumn("acceleration", F.col("slope_7") - F.col("slope_14"))
    return wide.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in wide.columns if c not in keys])


def wave_features(df: DataFrame, keys: list[str], order: str, value: str, history: int = 104, low: float = 0.2, spread: float = 1.0) -> DataFrame:
    """Waves of each series: runs of at least two smoothed values above the trailing low quantile plus a
    multiple of the series' median distance from it; onset, end, peak row, peak value and strength."""
    s = smoothed(df, keys, order, value)
    base = F.percentile("smooth", F.lit(low)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(history - 1), 0))
    s = s.withColumn("base", base)
    mad = s.groupBy(*keys).agg(F.percentile(F.abs(F.col("smooth") - F.col("base")), F.lit(0.5)).alias("__mad"))
    s = s.join(mad, keys).withColumn("__on", F.col("smooth") > F.col("base") + spread * F.col("__mad"))
    w = Window.partitionBy(*keys).orderBy(order)
    s = s.withColumn("__run", F.sum(F.when(F.col("__on") & F.coalesce(F.lag("__on").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = s.where("__on").groupBy(*keys, "__run").agg(F.min(order).alias("onset"), F.max(order).alias("end"), F.count("*").alias("length"), F.max_by(order, F.struct("smooth", F.negative(F.unix_date(order)))).alias("peak"), F.max("smooth").alias("peak_value"), F.avg(F.col("smooth") - F.col("base")).alias("strength"))
    return out.where("length >= 2").drop("__run")


def baseline_stability(df: DataFrame, keys: list[str], order: str, value: str, width: int = 8) -> DataFrame:
    """1 / (1 + variation) of the rows before, one half where their mean is zero."""
    span = Window.partitionBy(*keys).orderBy(order).rowsBetween(-width, -1)
    mean = F.avg(value).over(span)
    return df.withColumn("stability", F.when(mean == 0, 0.5).when(mean.isNotNull(), 1 / (1 + F.try_divide(F.stddev_pop(value).over(span), F.abs(mean)))))


def resample_step(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Median days between rows."""
    gap = F.datediff(F.col(order), F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))
    return df.withColumn("__gap", gap).groupBy(*keys).agg(F.percentile("__gap", F.lit(0.5)).alias("step"))


def seasonal_naive(df: DataFrame, keys: list[str], day: str, value: str, at: Column) -> DataFrame:
    """Median of the history in the target's ISO week, else in its month, else of all."""
    half = lambda c: F.percentile(F.when(c, F.col(value)), F.lit(0.5))
    past = df.where(F.col(day) < at)
    out = past.groupBy(*keys).agg(half(F.weekofyear(day) == F.weekofyear(at)).alias("__w"), half(F.month(day) == F.month(at)).alias("__m"), F.percentile(value, F.lit(0.5)).alias("__a"))
    return out.select(*keys, F.coalesce("__w", "__m", "__a").alias("expected"))


def extended_to(df: DataFrame, keys: list[str], day: str, until: Column, carried: list[str], most: int = 14) -> DataFrame:
    """Series carried on to a day: after each key's last row, a row for each day up to `until` with the last row's values of
    `carried` (others null) and `filled` true. A key whose gap is over `most` days, or that is there already, stays as it is.
    Lags and rolling features are to be made afterwards, over the rows that this gives."""
    last = df.groupBy(*keys).agg(F.max(day).alias("__last"), F.max_by(F.struct(*carried), day).alias("__row"))
    gap = F.datediff(until, "__last")
    more = last.where((gap > 0) & (gap <= most)).select(*keys, F.explode(F.sequence(F.date_add("__last", 1), until.cast("date"))).alias(day), "__row.*")
    more = more.withColumn(day, F.col(day).cast(df.schema[day].dataType)).withColumn("filled", F.lit(True))
    return df.withColumn("filled", F.lit(False)).unionByName(more, allowMissingColumns=True)

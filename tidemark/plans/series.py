"""Time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r
from ..operators import series as op
from ..registry import query
from .inputs import DAILY, OBS, WEEKLY, daily, obs, table, weekly


def day_text():
    return F.col("day").cast("string").alias("day")


def week_text():
    return F.col("week").cast("string").alias("week")



def national(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("source", "day").agg(F.avg("value").alias("v"))


NATIONAL = OBS + ", nat AS (SELECT source, day, avg(value) AS v FROM obs GROUP BY ALL)"
SPARSE = OBS + ", sp AS (SELECT source, day, avg(value) AS v FROM obs WHERE dayofyear(day) % 3 <> 0 GROUP BY ALL)"


def sparse(spark, sf_dir):
    return obs(spark, sf_dir).where("dayofyear(day) % 3 <> 0").groupBy("source", "day").agg(F.avg("value").alias("v"))


_GRID = "g AS (SELECT source, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sp GROUP BY source), d AS (SELECT g.source, g.day, sp.v FROM g LEFT JOIN sp ON g.source = sp.source AND g.day = sp.day)"


@query("q_dense_fill_forward", f"WITH {SPARSE}, {_GRID} SELECT source, CAST(day AS VARCHAR) AS day, round(last_value(v IGNORE NULLS) OVER (PARTITION BY source ORDER BY day), 6) AS filled FROM d")
def dense_fill(spark, sf_dir):
    out = op.fill_forward(op.dense(sparse(spark, sf_dir), ["source"], "day"), ["source"], "day", "v", "filled")
    return out.select("source", day_text(), r(F.col("filled")).alias("filled"))


@query(
    "q_interpolate",
    f"""WITH {SPARSE}, {_GRID}, e AS (SELECT source, day, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER p AS da, last_value(v IGNORE NULLS) OVER p AS va,
            first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER n AS db, first_value(v IGNORE NULLS) OVER n AS vb FROM d
            WINDOW p AS (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY source ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT source, CAST(day AS VARCHAR) AS day, round(CASE WHEN da = db THEN va ELSE va + (vb - va) * date_diff('day', da, day) / date_diff('day', da, db) END, 6) AS v FROM e""",
)
def interpolate(spark, sf_dir):
    out = op.interpolate(op.dense(sparse(spark, sf_dir), ["source"], "day"), ["source"], "day", "v", "u")
    return out.select("source", day_text(), r(F.col("u")).alias("v"))


@query("q_lag_family", f"WITH {NATIONAL} SELECT source, CAST(day AS VARCHAR) AS day, " + ", ".join(f"round(lag(v, {n}) OVER (PARTITION BY source ORDER BY day), 6) AS lag_{n}" for n in (1, 7, 14)) + " FROM nat")
def lag_family(spark, sf_dir):
    return op.lags(national(spark, sf_dir), ["source"], "day", "v", [1, 7, 14]).select("source", day_text(), *(r(F.col(f"lag_{n}")).alias(f"lag_{n}") for n in (1, 7, 14)))


_ROLL = ", ".join(f"round({f}(v) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 8) AS {a}_{n}" for n in (3, 7, 14) for f, a in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")))


@query("q_rolling_family", f"WITH {NATIONAL} SELECT source, CAST(day AS VARCHAR) AS day, {_ROLL} FROM nat")
def rolling_family(spark, sf_dir):
    out = op.rolling(national(spark, sf_dir), ["source"], "day", "v", [3, 7, 14])
    return out.select("source", day_text(), *(r(F.col(f"{a}_{n}"), 8).alias(f"{a}_{n}") for n in (3, 7, 14) for a in ("mean", "std", "min", "max")))


@query("q_rolling_quantile", f"WITH {WEEKLY} SELECT flag, CAST(week AS VARCHAR) AS week, CASE WHEN count(v) OVER w >= 8 THEN round(quantile_cont(v, 0.75) OVER w, 6) END AS p75 FROM weekly WINDOW w AS (PARTITION BY flag ORDER BY week ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)")
def rolling_quantile(spark, sf_dir):
    return op.rolling_quantile(weekly(spark, sf_dir), ["flag"], "week", "v", 0.75, 26, 8, "p75").select("flag", week_text(), r(F.col("p75")).alias("p75"))


@query(
    "q_rolling_slope",
    f"WITH {WEEKLY}, x AS (SELECT flag, week, v, row_number() OVER (PARTITION BY flag ORDER BY week) AS i FROM weekly) SELECT flag, CAST(week AS VARCHAR) AS week, round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(v, i) OVER w END, 8) + 0.0 AS slope FROM x WINDOW w AS (PARTITION BY flag ORDER BY week ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
)
def rolling_slope(spark, sf_dir):
    return op.rolling_slope(weekly(spark, sf_dir), ["flag"], "week", "v", 7, "slope").select("flag", week_text(), r(F.col("slope"), 8).alias("slope"))


@query(
    "q_log_ratio",
    f"WITH {WEEKLY}, b AS (SELECT flag, week, v, quantile_cont(v, 0.5) OVER (PARTITION BY flag ORDER BY week ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS m FROM weekly) SELECT flag, CAST(week AS VARCHAR) AS week, round(m, 6) AS baseline, round(ln((v + 1) / (m + 1)), 6) + 0.0 AS log_ratio FROM b",
)
def log_ratio(spark, sf_dir):
    return op.log_ratio_to_baseline(weekly(spark, sf_dir), ["flag"], "week", "v").select("flag", week_text(), r(F.col("baseline")).alias("baseline"), r(F.col("log_ratio")).alias("log_ratio"))


@query(
    "q_growth_acceleration",
    f"""WITH {SPARSE}, g AS (SELECT source, day, v, last_value(v IGNORE NULLS) OVER (PARTITION BY source ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS b FROM sp),
            h AS (SELECT source, day, (v - b) / greatest(abs(b), 1.0) AS growth FROM g)
        SELECT source, CAST(day AS VARCHAR) AS day, round(growth, 6) + 0.0 AS growth, round(growth - last_value(growth IGNORE NULLS) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) + 0.0 AS acceleration FROM h""",
)
def growth(spark, sf_dir):
    return op.growth(sparse(spark, sf_dir), ["source"], "day", "v", 7).select("source", day_text(), r(F.col("growth")).alias("growth"), r(F.col("acceleration")).alias("acceleration"))


SEASONAL = f"""WITH {WEEKLY}, h AS (SELECT a.flag, a.week, b.v AS old, least(abs(least(weekofyear(a.week), 52) - least(weekofyear(b.week), 52)), 52 - abs(least(weekofyear(a.week), 52) - least(weekofyear(b.week), 52))) <= 1 AS near,
            row_number() OVER (PARTITION BY a.flag, a.week ORDER BY b.week DESC) AS k FROM weekly a LEFT JOIN weekly b ON a.flag = b.flag AND b.week < a.week),
        c AS (SELECT *, sum(CAST(near AS INTEGER)) OVER (PARTITION BY flag, week) AS m FROM h),
        u AS (SELECT flag, week, old, coalesce(m, 0) >= 5 AS seasonal FROM c WHERE old IS NULL OR CASE WHEN m >= 5 THEN near ELSE k <= 12 END),
        t AS (SELECT flag, week, quantile_cont(old, 0.5) AS b FROM u GROUP BY ALL)
        SELECT u.flag, CAST(u.week AS VARCHAR) AS week, round(any_value(b), 6) AS baseline, round(quantile_cont(abs(old - b), 0.5), 6) AS mad, bool_or(seasonal) AS seasonal FROM u JOIN t ON u.flag = t.flag AND u.week = t.week GROUP BY u.flag, u.week"""


@query("q_seasonal_baseline", SEASONAL)
def seasonal(spark, sf_dir):
    return op.seasonal_baseline(weekly(spark, sf_dir), ["flag"], "week", "v").select("flag", week_text(), r(F.col("baseline")).alias("baseline"), r(F.col("mad")).alias("mad"), "seasonal")


@query(
    "q_wave_segments",
    f"""WITH {DAILY}, o AS (SELECT region, source, day, v > 55 AS on_ FROM daily), c AS (SELECT *, sum(CASE WHEN on_ AND coalesce(lag_, false) THEN 0 ELSE 1 END) OVER (PARTITION BY region, source ORDER BY day) AS run FROM (SELECT *, lag(on_) OVER (PARTITION BY region, source ORDER BY day) AS lag_ FROM o))
        SELECT region, source, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS length FROM c WHERE on_ GROUP BY region, source, run HAVING count(*) >= 2""",
)
def wave_segments(spark, sf_dir):
    out = op.segments(daily(spark, sf_dir), ["region", "source"], "day", F.col("v") > 55, 2)
    return out.select("region", "source", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "length")


@query(
    "q_longest_low_run",
    f"""WITH {NATIONAL}, o AS (SELECT source, day, v < 50 AS on_ FROM nat), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day) - row_number() OVER (PARTITION BY source, on_ ORDER BY day) AS run FROM o)
        SELECT source, max(n) AS longest FROM (SELECT source, run, count(*) AS n FROM c WHERE on_ GROUP BY ALL) GROUP BY source""",
)
def longest_low(spark, sf_dir):
    return op.segments(national(spark, sf_dir), ["source"], "day", F.col("v") < 50).groupBy("source").agg(F.max("length").alias("longest"))


@query(
    "q_sustained_growth",
    f"""WITH {WEEKLY}, x AS (SELECT flag, week, v, {", ".join(f"lead(v, {i}) OVER w AS v{i}" for i in (1, 2))} FROM weekly WINDOW w AS (PARTITION BY flag ORDER BY week))
        SELECT flag, CAST(min(week) AS VARCHAR) AS onset FROM x WHERE v1 > v AND v2 > v1 AND v2 >= v * 1.2 GROUP BY flag""",
)
def sustained(spark, sf_dir):
    return op.sustained_growth(weekly(spark, sf_dir), ["flag"], "week", "v", 2, 0.2).select("flag", F.col("onset").cast("string").alias("onset"))


@query("q_centred_median", f"WITH {WEEKLY} SELECT flag, CAST(week AS VARCHAR) AS week, round(quantile_cont(v, 0.5) OVER (PARTITION BY flag ORDER BY week ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM weekly")
def centred(spark, sf_dir):
    return op.smoothed(weekly(spark, sf_dir), ["flag"], "week", "v").select("flag", week_text(), r(F.col("smooth")).alias("smooth"))


@query(
    "q_direct_target",
    f"WITH {WEEKLY}, x AS (SELECT flag, week, v, lead(v, 2) OVER (PARTITION BY flag ORDER BY week) AS t FROM weekly) SELECT flag, CAST(week AS VARCHAR) AS week, round(t, 4) AS target, round((t - v) / greatest(abs(v), 1.0), 6) + 0.0 AS target_growth, CAST((t - v) / greatest(abs(v), 1.0) >= 0.1 AS INTEGER) AS event FROM x WHERE t IS NOT NULL",
)
def direct_target(spark, sf_dir):
    return op.direct_target(weekly(spark, sf_dir), ["flag"], "week", "v", 2, 0.1).select("flag", week_text(), r(F.col("target"), 4).alias("target"), r(F.col("target_growth")).alias("target_growth"), "event")


_KERNEL = [0.1, 0.3, 0.4, 0.2]


@query(
    "q_delay_kernel",
    f"WITH {NATIONAL}, x AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY day) - 1 AS INTEGER) AS t, v FROM nat), k AS (SELECT unnest([0, 1, 2, 3]) AS age, unnest({_KERNEL}) AS w) SELECT a.source, a.t, round(sum(k.w * b.v), 6) AS convolved FROM x a CROSS JOIN k JOIN x b ON a.source = b.source AND b.t = greatest(a.t - k.age, 0) GROUP BY ALL",
)
def delay_kernel(spark, sf_dir):
    from pyspark.sql import Window

    x = national(spark, sf_dir).withColumn("t", F.row_number().over(Window.partitionBy("source").orderBy("day")) - 1)
    return op.convolve(x.select("source", "t", "v"), ["source"], "t", "v", _KERNEL).select("source", "t", r(F.col("convolved")).alias("convolved"))


@query(
    "q_week_profile",
    """WITH g AS (SELECT l_returnflag AS flag, weekofyear(l_shipdate) AS week, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, count(*) AS n, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY ALL),
       w AS (SELECT flag, unnest(generate_series(1, 52)) AS week FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem))
       SELECT w.flag, CAST(w.week AS INTEGER) AS week, round(coalesce(m, 0), 6) AS mean, round(coalesce(s, 0), 6) AS std, coalesce(n, 0) AS n, coalesce(a, 0) AS least, coalesce(b, 0) AS most FROM w LEFT JOIN g ON w.flag = g.flag AND w.week = g.week""",
)
def week_profile(spark, sf_dir):
    out = op.week_profile(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_shipdate", "l_quantity"), ["flag"], "l_shipdate", "l_quantity")
    return out.select("flag", "week", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "n", "least", "most")


_CORR = """c AS (SELECT l.lag, count(*) AS n, CASE WHEN stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS corr
    FROM nat a CROSS JOIN (SELECT unnest(generate_series(-7, 7)) AS lag) l JOIN nat b ON b.day = a.day + to_days(CAST(l.lag AS INTEGER)) AND b.source = 'purchase' WHERE a.source = 'click' GROUP BY l.lag HAVING count(*) >= 3)"""


def lead_lag(spark, sf_dir):
    n = national(spark, sf_dir).withColumnRenamed("v", "value").withColumn("pair", F.lit(1))
    return op.lag_correlations(n.where("source = 'click'").drop("source"), n.where("source = 'purchase'").drop("source"), ["pair"], "day", list(range(-7, 8)))


@query("q_lead_lag_corr", f"WITH {NATIONAL}, {_CORR} SELECT CAST(lag AS INTEGER) AS lag, n, round(corr, 6) + 0.0 AS corr FROM c")
def lead_lag_corr(spark, sf_dir):
    return lead_lag(spark, sf_dir).select("lag", "n", r(F.col("corr")).alias("corr"))


@query("q_best_lag", f"WITH {NATIONAL}, {_CORR} SELECT CAST(lag AS INTEGER) AS best_lag, round(corr, 6) + 0.0 AS best_corr FROM c WHERE corr IS NOT NULL ORDER BY corr DESC, abs(lag), lag LIMIT 1")
def best_lag(spark, sf_dir):
    return op.best_lag(lead_lag(spark, sf_dir), ["pair"]).select("best_lag", r(F.col("best_corr")).alias("best_corr"))


@query(
    "q_lag_distribution",
    f"""WITH {NATIONAL}, {_CORR}, w AS (SELECT lag, exp(8.0 * greatest(coalesce(corr, 0), 0)) AS e FROM c), p AS (SELECT lag, e / sum(e) OVER () AS p, sum(e) OVER (ORDER BY lag ROWS UNBOUNDED PRECEDING) / sum(e) OVER () AS cum FROM w)
        SELECT round(sum(p * lag), 6) + 0.0 AS mean_lag, CAST(arg_max(lag, p) AS INTEGER) AS mode_lag, CAST(min(lag) FILTER (cum >= 0.1) AS INTEGER) AS p10, CAST(min(lag) FILTER (cum >= 0.9) AS INTEGER) AS p90, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p""",
)
def lag_distribution(spark, sf_dir):
    out = op.lag_distribution(lead_lag(spark, sf_dir), ["pair"])
    return out.select(r(F.col("mean_lag")).alias("mean_lag"), "mode_lag", "p10", "p90", r(F.col("entropy")).alias("entropy"))

"""Evaluation bundles over issue dates, densities, categories and calibration of scale."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r
from ..operators import metrics
from ..operators import scores as op
from ..registry import query
from .evaluation import FORECASTS, forecasts
from .inputs import DEMAND, SCORES, WEEKLY, demand, scores, table, weekly


@query("q_lead_time", f"WITH {SCORES}, x AS (SELECT source, CASE WHEN score >= 0.3 AND label = 1 THEN event_id % 9 END AS d FROM scores) SELECT source, quantile_cont(d, 0.5) AS median_days, round(avg(d), 6) AS mean_days, count(d) AS hits FROM x GROUP BY source")
def lead_time(spark, sf_dir):
    x = scores(spark, sf_dir).withColumn("target", F.date_add("day", (F.col("event_id") % 9).cast("int")))
    return metrics.lead_time(x, ["source"], "day", "target", "score", "label", 0.3).select("source", "median_days", r(F.col("mean_days")).alias("mean_days"), "hits")


@query(
    "q_vintage_errors",
    f"WITH {WEEKLY}, x AS (SELECT a.flag, CAST(date_diff('day', a.week, b.week) AS INTEGER) AS horizon, a.v - b.v AS e FROM weekly a JOIN weekly b ON a.flag = b.flag AND b.week IN (a.week + 7, a.week + 14, a.week + 28)) SELECT flag, horizon, count(*) AS n, round(quantile_cont(abs(e), 0.5), 4) AS median_error, round(quantile_cont(abs(e), 0.9), 4) AS p90_error, round(avg(e), 5) + 0.0 AS bias FROM x GROUP BY ALL",
)
def vintage_errors(spark, sf_dir):
    w = weekly(spark, sf_dir)
    issued = w.select("flag", F.col("week").alias("issued"), F.col("v").alias("p"), F.explode(F.array(*[F.lit(d) for d in (7, 14, 28)])).alias("d")).withColumn("week", F.date_add("issued", F.col("d")))
    out = metrics.vintage_errors(issued.join(w, ["flag", "week"]), ["flag"], "issued", "week", "v", "p")
    return out.select("flag", "horizon", "n", r(F.col("median_error"), 4).alias("median_error"), r(F.col("p90_error"), 4).alias("p90_error"), r(F.col("bias"), 5).alias("bias"))


@query(
    "q_decision_bundle",
    f"""WITH {FORECASTS}, b AS (SELECT flag, y, p, quantile_cont(y, 0.5) OVER (PARTITION BY flag ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b FROM fc), x AS (SELECT flag, (p - b) / greatest(abs(b), 1.0) >= 0.1 AS a, (y - b) / greatest(abs(b), 1.0) >= 0.1 AS e, greatest(1 - abs(p - y) / greatest(abs(y), 1.0), 0) AS near FROM b WHERE b IS NOT NULL),
        m AS (SELECT flag, count(*) FILTER (a AND e) AS hits, count(*) FILTER (a AND NOT e) AS false_alarms, count(*) FILTER (NOT a AND e) AS misses, avg(near) AS near FROM x GROUP BY flag)
        SELECT flag, hits, false_alarms, misses, round(0.4 * coalesce(hits / nullif(hits + misses, 0), 0) + 0.35 * coalesce(hits / nullif(hits + false_alarms, 0), 0) + 0.25 * near, 6) AS readiness FROM m""",
)
def decision_bundle(spark, sf_dir):
    out = metrics.decisions(forecasts(spark, sf_dir), ["flag"], "week", "y", "p", 0.1, 8)
    return out.select("flag", "hits", "false_alarms", "misses", r(F.col("readiness")).alias("readiness"))


@query("q_bootstrap")
def bootstrap(spark, sf_dir):
    per = forecasts(spark, sf_dir).groupBy(F.year("week").alias("fold")).agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    return metrics.bootstrap(per, "fold", "mae").select(*(r(F.col(c), 5).alias(c) for c in ("low", "high", "mean")), "folds")


@query(
    "q_week_overlap",
    f"""WITH {DEMAND}, f AS (SELECT nation, week, v AS y, lag(v) OVER (PARTITION BY nation ORDER BY week) AS p FROM demand), x AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY y DESC, nation) <= 3 AS a, row_number() OVER (PARTITION BY week ORDER BY p DESC, nation) <= 3 AS f FROM f WHERE p IS NOT NULL)
        SELECT CAST(week AS VARCHAR) AS week, count(*) AS n, round(avg(abs(p - y) / greatest(abs(y), 1e-6)), 6) AS mape, round(CASE WHEN stddev_pop(y) > 1e-12 AND stddev_pop(p) > 1e-12 THEN covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) END, 5) + 0.0 AS corr, round(count(*) FILTER (a AND f) / least(count(*), 3), 6) AS top_overlap FROM x GROUP BY week""",
)
def week_overlap(spark, sf_dir):
    f = demand(spark, sf_dir).select("nation", "week", F.col("v").alias("y"), F.lag("v").over(Window.partitionBy("nation").orderBy("week")).alias("p")).where("p IS NOT NULL")
    out = metrics.overlap(f, ["week"], "y", "p", ["nation"])
    return out.select(F.col("week").cast("string").alias("week"), "n", r(F.col("mape")).alias("mape"), r(F.col("corr"), 5).alias("corr"), r(F.col("top_overlap")).alias("top_overlap"))


@query("q_merged_bins")
def merged_bins(spark, sf_dir):
    bins = metrics.reliability_bins(scores(spark, sf_dir), "score", "label", ["event_id"], 20)
    out = metrics.merge_small_bins(bins, 700)
    return out.select("bin", "n", r(F.col("p")).alias("p"), r(F.col("y")).alias("y"))


@query(
    "q_log_densities",
    "WITH x AS (SELECT c_nationkey AS nation, count(*) AS k FROM customer GROUP BY 1), m AS (SELECT avg(k) AS m, stddev_pop(k) AS s FROM x) SELECT nation, round(lgamma(k + 5.0) - lgamma(5.0) - lgamma(k + 1.0) + 5 * ln(5 / (5 + m)) + k * ln(m / (5 + m)), 6) AS count_log_p, round(lgamma(2.5) - lgamma(2.0) - 0.5 * ln(4 * pi()) - ln(s) - 2.5 * ln(1 + ((k - m) / s) ** 2 / 4), 6) AS t_log_p FROM x, m",
)
def log_densities(spark, sf_dir):
    x = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("k"))
    m = F.broadcast(x.agg(F.avg("k").alias("m"), F.stddev_pop("k").alias("s")))
    return x.join(m).select("nation", r(op.negative_binomial_log_p(F.col("k"), F.col("m"), F.lit(5.0))).alias("count_log_p"), r(op.student_log_p(F.col("k"), F.col("m"), F.col("s"), 4.0)).alias("t_log_p"))


_WORDS = [("metal", ["brass", "steel", "tin"]), ("soft", ["copper", "nickel"])]


@query("q_keyword_categories", "SELECT CASE WHEN lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%tin%' THEN 'metal' WHEN lower(p_type) LIKE '%copper%' OR lower(p_type) LIKE '%nickel%' THEN 'soft' ELSE 'other' END AS category, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def keyword_categories(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(op.first_category(F.col("p_type"), _WORDS, "other").alias("category")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


@query(
    "q_scale_fit",
    f"""WITH {FORECASTS}, m AS (SELECT flag, avg(y) AS my, avg(p) AS mp, covar_pop(y, p) AS c, var_pop(p) AS v, var_pop(y) AS vy, avg((p - y) ** 2) AS b, greatest(least(covar_pop(y, p) / var_pop(p), 2.0), 0.5) AS s FROM fc GROUP BY flag), k AS (SELECT *, vy - 2 * s * c + s * s * v < b AS ok FROM m)
        SELECT flag, round(CASE WHEN ok THEN s ELSE 1 END, 6) AS slope, round(CASE WHEN ok THEN my - s * mp ELSE 0 END, 4) AS intercept, ok AS improves FROM k""",
)
def scale_fit(spark, sf_dir):
    return op.scale_fit(forecasts(spark, sf_dir), ["flag"], "y", "p").select("flag", r(F.col("slope")).alias("slope"), r(F.col("intercept"), 4).alias("intercept"), "improves")


@query(
    "q_planning_curve",
    f"""WITH {WEEKLY}, a AS (SELECT week, v FROM weekly WHERE flag = 'A'), n AS (SELECT week, v FROM weekly WHERE flag = 'N'), l AS (SELECT unnest([0, 1, 2, 3, 4]) AS lag), c AS (SELECT lag, count(*) AS n, covar_pop(a.v, n.v) / (stddev_pop(a.v) * stddev_pop(n.v)) AS corr, regr_slope(n.v, a.v) AS slope, regr_intercept(n.v, a.v) AS intercept FROM l JOIN a ON true JOIN n ON n.week = a.week + 7 * lag GROUP BY lag)
        SELECT lag, n, round(corr, 6) + 0.0 AS corr, round(slope, 6) + 0.0 AS slope, round(intercept, 4) AS intercept FROM c ORDER BY corr DESC, lag LIMIT 1""",
)
def planning_curve(spark, sf_dir):
    w = weekly(spark, sf_dir)
    a = w.where("flag = 'A'").select("week", F.col("v").alias("x"), F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("lag"))
    pairs = a.withColumn("at", F.date_add("week", F.col("lag") * 7)).drop("week").join(w.where("flag = 'N'").select(F.col("week").alias("at"), F.col("v").alias("y")), "at")
    c = pairs.groupBy("lag").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    c = c.where("sx > 1e-12 AND sy > 1e-12").withColumn("corr", F.col("c") / (F.col("sx") * F.col("sy")))
    return c.orderBy(F.desc("corr"), "lag").limit(1).select("lag", "n", r(F.col("corr")).alias("corr"), r(F.col("slope")).alias("slope"), r(F.col("intercept"), 4).alias("intercept"))

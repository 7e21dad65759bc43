"""Feature rows, waves, rule scores and decision backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r, ratio
from ..operators import scores as op
from ..operators import series
from ..registry import query
from .inputs import CUTOFF, DAILY, DEMAND, OBS, WEEKLY, daily, demand, obs, weekly


def week_text():
    return F.col("week").cast("string").alias("week")

_AGE = f"date_diff('day', day, DATE '{CUTOFF}')"
_F = {"level": "max_by(v, day)", "age_days": "min(a)"} | {f"lag_{n}": f"max_by(v, day) FILTER (a >= {n})" for n in (1, 3, 7, 14, 21, 28)}
for _n in (3, 7, 14):
    _F |= {f"mean_{_n}": f"avg(v) FILTER (a < {_n})", f"std_{_n}": f"stddev_pop(v) FILTER (a < {_n})", f"min_{_n}": f"min(v) FILTER (a < {_n})", f"max_{_n}": f"max(v) FILTER (a < {_n})"}
_SL = lambda n: f"CASE WHEN var_pop(a) FILTER (a < {n}) > 0 THEN covar_pop(v, -a) FILTER (a < {n}) / var_pop(a) FILTER (a < {n}) END"
_F |= {"slope_7": _SL(7), "slope_14": _SL(14), "missing_28": "28 - count(DISTINCT day) FILTER (a < 28)", "days_since_peak": "arg_max(a, v)"}
_F |= {"z_28": "(max_by(v, day) - avg(v) FILTER (a < 28)) / nullif(stddev_pop(v) FILTER (a < 28), 0)", "change_7": "(max_by(v, day) - max_by(v, day) FILTER (a >= 7)) / greatest(abs(max_by(v, day) FILTER (a >= 7)), 1.0)", "acceleration": f"{_SL(7)} - {_SL(14)}"}
_WHOLE = ("age_days", "missing_28", "days_since_peak")


@query("q_signal_features", f"WITH {DAILY}, x AS (SELECT *, {_AGE} AS a FROM daily WHERE day <= DATE '{CUTOFF}') SELECT region, source, " + ", ".join(f"CAST({e} AS BIGINT) AS s_{n}" if n in _WHOLE else f"round({e}, 8) + 0.0 AS s_{n}" for n, e in _F.items()) + " FROM x GROUP BY ALL")
def signal_features(spark, sf_dir):
    out = series.signal_features(daily(spark, sf_dir), ["region", "source"], "day", "v", F.lit(CUTOFF).cast("date"), "s_")
    return out.select("region", "source", *(F.col(f"s_{n}").cast("long").alias(f"s_{n}") if n in _WHOLE else r(F.col(f"s_{n}"), 8).alias(f"s_{n}") for n in _F))


@query(
    "q_wave_features",
    f"""WITH {WEEKLY}, s AS (SELECT flag, week, quantile_cont(v, 0.5) OVER (PARTITION BY flag ORDER BY week ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM weekly),
        b AS (SELECT *, quantile_cont(s, 0.2) OVER (PARTITION BY flag ORDER BY week ROWS BETWEEN 103 PRECEDING AND CURRENT ROW) AS b FROM s), m AS (SELECT flag, quantile_cont(abs(s - b), 0.5) AS mad FROM b GROUP BY flag),
        o AS (SELECT b.*, s > b + mad AS on_ FROM b JOIN m USING (flag)), c AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY week) - row_number() OVER (PARTITION BY flag, on_ ORDER BY week) AS run FROM o)
        SELECT flag, CAST(min(week) AS VARCHAR) AS onset, CAST(max(week) AS VARCHAR) AS "end", count(*) AS length, CAST(arg_max(week, s) AS VARCHAR) AS peak, round(max(s), 4) AS peak_value, round(avg(s - b), 4) AS strength FROM c WHERE on_ GROUP BY flag, run HAVING count(*) >= 2""",
)
def wave_features(spark, sf_dir):
    out = series.wave_features(weekly(spark, sf_dir), ["flag"], "week", "v")
    return out.select("flag", *(F.col(c).cast("string").alias(c) for c in ("onset", "end", "peak")), "length", r(F.col("peak_value"), 4).alias("peak_value"), r(F.col("strength"), 4).alias("strength"))


@query("q_baseline_stability", f"WITH {WEEKLY}, x AS (SELECT flag, week, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM weekly WINDOW w AS (PARTITION BY flag ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT flag, CAST(week AS VARCHAR) AS week, round(CASE WHEN m = 0 THEN 0.5 WHEN m IS NOT NULL THEN 1 / (1 + s / abs(m)) END, 6) AS stability FROM x")
def stability(spark, sf_dir):
    return series.baseline_stability(weekly(spark, sf_dir), ["flag"], "week", "v").select("flag", week_text(), r(F.col("stability")).alias("stability"))


@query("q_step_days", f"WITH {DAILY}, g AS (SELECT region, source, date_diff('day', lag(day) OVER (PARTITION BY region, source ORDER BY day), day) AS g FROM daily) SELECT region, source, quantile_cont(g, 0.5) AS step FROM g GROUP BY ALL")
def step_days(spark, sf_dir):
    return series.resample_step(daily(spark, sf_dir), ["region", "source"], "day")


@query(
    "q_seasonal_naive",
    f"WITH {WEEKLY}, p AS (SELECT * FROM weekly WHERE week < DATE '2000-05-15') SELECT flag, round(coalesce(quantile_cont(v, 0.5) FILTER (weekofyear(week) = weekofyear(DATE '2000-05-15')), quantile_cont(v, 0.5) FILTER (month(week) = 5), quantile_cont(v, 0.5)), 5) AS expected FROM p GROUP BY flag",
)
def seasonal_naive(spark, sf_dir):
    return series.seasonal_naive(weekly(spark, sf_dir), ["flag"], "week", "v", F.lit("2000-05-15").cast("date")).select("flag", r(F.col("expected"), 5).alias("expected"))


_EV = f"{DAILY}, w AS (SELECT region, max(v) FILTER (source = 'click') AS c, max(v) FILTER (source = 'purchase') AS p, max(v) FILTER (source = 'view' AND day > DATE '{CUTOFF}') AS q FROM daily GROUP BY region)"


def evidence(spark, sf_dir):
    of = lambda s, more=F.lit(True): F.max(F.when((F.col("source") == s) & more, F.col("v")))
    return daily(spark, sf_dir).groupBy("region").agg(of("click").alias("c"), of("purchase").alias("p"), of("view", F.col("day") > CUTOFF).alias("q"))


@query(
    "q_rule_scores",
    f"""WITH {_EV}, x AS (SELECT region, c / 300 AS c, p / 300 AS p, q / 300 AS q, (c - p) / 100 AS d, (p - q) / 100 AS e FROM w),
        s AS (SELECT region, CASE WHEN (c IS NOT NULL)::INT + (p IS NOT NULL)::INT + (q IS NOT NULL)::INT > 0 THEN (coalesce(c, 0) * 0.5 + coalesce(p, 0) * 0.3 + coalesce(q, 0) * 0.2) / ((c IS NOT NULL)::INT * 0.5 + (p IS NOT NULL)::INT * 0.3 + (q IS NOT NULL)::INT * 0.2) END AS score,
              greatest((d > 0.1)::INT + (e > 0.1)::INT, (d < -0.1)::INT + (e < -0.1)::INT) / nullif((d > 0.1)::INT + (e > 0.1)::INT + (d < -0.1)::INT + (e < -0.1)::INT, 0) AS agreed, d FROM x)
        SELECT region, round(score, 6) AS score, round(agreed, 6) AS agreed, CASE WHEN score >= 0.6 AND d > 0 AND agreed >= 0.6 THEN 'activate' WHEN score >= 0.4 OR d > 0.1 THEN 'prepare' ELSE 'watch' END AS stage FROM s""",
)
def rule_scores(spark, sf_dir):
    x = evidence(spark, sf_dir).select("region", (F.col("c") / 300).alias("c"), (F.col("p") / 300).alias("p"), (F.col("q") / 300).alias("q"), ((F.col("c") - F.col("p")) / 100).alias("d"), ((F.col("p") - F.col("q")) / 100).alias("e"))
    score, agreed = op.weighted_available([(0.5, F.col("c")), (0.3, F.col("p")), (0.2, F.col("q"))]), op.agreement([F.col("d"), F.col("e")], 0.1)
    return x.select("region", r(score).alias("score"), r(agreed).alias("agreed"), op.stage(score, F.col("d"), agreed).alias("stage"))


@query(
    "q_confidence",
    f"WITH {_EV}, x AS (SELECT region, [c / 500, p / 500, 0.5] AS v FROM w) SELECT region, round(least(greatest(1 - 2 * list_stddev_pop(v), 0.0), 1.0), 6) AS confidence FROM x",
)
def confidence(spark, sf_dir):
    return evidence(spark, sf_dir).select("region", r(op.confidence([F.col("c") / 500, F.col("p") / 500, F.lit(0.5)])).alias("confidence"))


@query("q_horizon_alignment", f"WITH {_EV} SELECT CASE WHEN c >= 250 AND p >= 250 THEN 'sustained' WHEN c >= 250 THEN 'fading' WHEN p >= 250 THEN 'building' ELSE 'quiet' END AS alignment, count(*) AS n FROM w GROUP BY 1")
def horizon_alignment(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy(op.alignment(F.col("c"), F.col("p"), 250).alias("alignment")).agg(F.count("*").alias("n"))


@query(
    "q_performance_weights",
    f"""WITH {WEEKLY}, x AS (SELECT flag, v, lag(v) OVER w AS p, lag(v, 52) OVER w AS s FROM weekly WINDOW w AS (PARTITION BY flag ORDER BY week)), l AS (SELECT flag, 'p' AS candidate, avg(abs(p - v)) AS loss FROM x GROUP BY flag UNION ALL SELECT flag, 's', avg(abs(s - v)) FROM x GROUP BY flag)
        SELECT flag, candidate, round((1 / loss) / sum(1 / loss) OVER (PARTITION BY flag), 6) AS weight FROM l""",
)
def performance_weights(spark, sf_dir):
    w = Window.partitionBy("flag").orderBy("week")
    x = weekly(spark, sf_dir).withColumn("p", F.lag("v").over(w)).withColumn("s", F.lag("v", 52).over(w)).unpivot(["flag", "v"], ["p", "s"], "candidate", "f")
    loss = x.groupBy("flag", "candidate").agg(F.avg(F.abs(F.col("f") - F.col("v"))).alias("loss"))
    return op.performance_weights(loss, ["flag"], "loss").select("flag", "candidate", r(F.col("weight")).alias("weight"))


@query(
    "q_sample_crps",
    f"WITH {WEEKLY}, x AS (SELECT flag, v AS y, [lag(v) OVER w, lag(v, 2) OVER w, lag(v, 3) OVER w] AS s, lag(v, 3) OVER w AS c FROM weekly WINDOW w AS (PARTITION BY flag ORDER BY week)) SELECT flag, round(avg((abs(s[1] - y) + abs(s[2] - y) + abs(s[3] - y)) / 3 - (abs(s[1] - s[2]) + abs(s[1] - s[3]) + abs(s[2] - s[3])) / 9), 5) AS crps FROM x WHERE c IS NOT NULL GROUP BY flag",
)
def sample_crps(spark, sf_dir):
    w = Window.partitionBy("flag").orderBy("week")
    x = weekly(spark, sf_dir).withColumn("s", F.array(*[F.lag("v", k).over(w) for k in (1, 2, 3)])).where("s[2] IS NOT NULL")
    return x.groupBy("flag").agg(r(F.avg(op.sample_crps(F.col("v"), F.col("s"))), 5).alias("crps"))


@query(
    "q_rank_scores",
    f"WITH {DEMAND}, x AS (SELECT nation, week, dense_rank() OVER (PARTITION BY week ORDER BY n) - 1 AS d FROM demand), y AS (SELECT *, max(d) OVER (PARTITION BY week) AS m FROM x) SELECT nation, CAST(week AS VARCHAR) AS week, round(CASE WHEN m = 0 THEN 0.5 ELSE d / m END, 6) AS rank_score FROM y",
)
def rank_scores(spark, sf_dir):
    return op.rank_scores(demand(spark, sf_dir), ["week"], "n").select("nation", week_text(), r(F.col("rank_score")).alias("rank_score"))


@query(
    "q_allocation_regret",
    f"""WITH {DEMAND}, x AS (SELECT nation, week, v, CASE WHEN lead(v) OVER w IS NOT NULL THEN greatest(lead(v) OVER w - v, 0) / 1000 END AS gain FROM demand WINDOW w AS (PARTITION BY nation ORDER BY week)), s AS (SELECT *, v / sum(v) OVER (PARTITION BY week) AS share FROM x WHERE gain IS NOT NULL)
        SELECT CAST(week AS VARCHAR) AS week, round(sum(share * gain), 4) AS captured, round(max(gain), 4) AS best, round(max(gain) - sum(share * gain), 4) + 0.0 AS regret FROM s GROUP BY week""",
)
def allocation_regret(spark, sf_dir):
    x = demand(spark, sf_dir).withColumn("next", F.lead("v").over(Window.partitionBy("nation").orderBy("week"))).where("next IS NOT NULL").withColumn("gain", F.greatest(F.col("next") - F.col("v"), F.lit(0.0)) / 1000)
    s = x.withColumn("share", ratio(F.col("v"), F.sum("v").over(Window.partitionBy("week"))))
    return op.regret(s, ["week"], "share", "gain").select(week_text(), *(r(F.col(c), 4).alias(c) for c in ("captured", "best", "regret")))


@query(
    "q_wave_radar",
    f"""WITH {DEMAND}, b AS (SELECT nation, avg(v) AS b FROM demand WHERE week BETWEEN DATE '1998-04-01' AND DATE '1998-09-28' GROUP BY nation), s AS (SELECT * FROM demand WHERE week BETWEEN DATE '1998-10-01' AND DATE '1999-05-31'),
        o AS (SELECT s.nation, min(week) FILTER (v >= b * 1.5) AS onset, arg_max(week, v) AS peak, sum(v) AS total FROM s JOIN b USING (nation) GROUP BY s.nation)
        SELECT nation, CAST(onset AS VARCHAR) AS onset, CAST(peak AS VARCHAR) AS peak, round(total, 2) AS total, row_number() OVER (ORDER BY onset NULLS LAST, nation) AS rank FROM o""",
)
def wave_radar(spark, sf_dir):
    d = demand(spark, sf_dir)
    base = d.where("week BETWEEN date'1998-04-01' AND date'1998-09-28'").groupBy("nation").agg(F.avg("v").alias("b"))
    s = d.where("week BETWEEN date'1998-10-01' AND date'1999-05-31'").join(base, "nation")
    o = s.groupBy("nation").agg(F.min(F.when(F.col("v") >= F.col("b") * 1.5, F.col("week"))).alias("onset"), F.max_by("week", "v").alias("peak"), F.sum("v").alias("total"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("onset"), "nation")).cast("long")  # a row per nation
    return o.select("nation", F.col("onset").cast("string").alias("onset"), F.col("peak").cast("string").alias("peak"), r(F.col("total"), 2).alias("total"), rank.alias("rank"))


@query("q_source_freshness", f"WITH {OBS} SELECT source, CAST(max(day) AS VARCHAR) AS last_day, CAST(date_diff('day', max(day), DATE '2024-01-31') AS BIGINT) AS age_days, round(exp(-date_diff('day', max(day), DATE '2024-01-31') / 14.0), 6) AS freshness, count(DISTINCT region) AS regions FROM obs GROUP BY source")
def freshness(spark, sf_dir):
    o = obs(spark, sf_dir).groupBy("source").agg(F.max("day").alias("d"), F.countDistinct("region").alias("regions"))
    age = F.datediff(F.lit("2024-01-31"), "d")
    return o.select("source", F.col("d").cast("string").alias("last_day"), age.cast("long").alias("age_days"), r(F.exp(-age / 14.0)).alias("freshness"), "regions")


_NB = op.shifted_negative_binomial(10, 2, 4.0, 3.0)


@query("q_renewal_pressure", f"WITH {OBS}, nat AS (SELECT source, day, avg(value) AS v FROM obs GROUP BY ALL), x AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY day) - 1 AS INTEGER) AS t, v FROM nat), k AS (SELECT unnest(generate_series(0, 9)) AS age, unnest({_NB}) AS w) SELECT a.source, a.t, round(ln((a.v + 1) / (sum(k.w * b.v) + 1)), 6) + 0.0 AS log_r FROM x a CROSS JOIN k JOIN x b ON a.source = b.source AND b.t = greatest(a.t - k.age, 0) GROUP BY a.source, a.t, a.v")
def renewal(spark, sf_dir):
    n = obs(spark, sf_dir).groupBy("source", "day").agg(F.avg("value").alias("v"))
    x = n.withColumn("t", F.row_number().over(Window.partitionBy("source").orderBy("day")) - 1).select("source", "t", "v")
    return x.join(series.convolve(x, ["source"], "t", "v", _NB), ["source", "t"]).select("source", "t", r(F.log((F.col("v") + 1) / (F.col("convolved") + 1))).alias("log_r"))

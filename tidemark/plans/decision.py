"""Evidence fusion, gates, allocation and site alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clamp, r, ratio, sigmoid
from ..operators import regional as op
from ..registry import query
from .inputs import DAILY, DEMAND, daily, demand, table


@query(
    "q_fusion_posterior",
    f"WITH {DAILY}, e AS (SELECT region, source, avg(v) / 100 AS x, var_pop(v) / 10000 + 0.01 AS s FROM daily GROUP BY ALL) SELECT region, round((0.5 / 0.25 + sum(x / s)) / (1 / 0.25 + sum(1 / s)), 6) AS mean, round(1 / (1 / 0.25 + sum(1 / s)), 6) AS variance, count(*) AS sources FROM e GROUP BY region",
)
def fusion(spark, sf_dir):
    e = daily(spark, sf_dir).groupBy("region", "source").agg((F.avg("v") / 100).alias("x"), (F.var_pop("v") / 10000 + 0.01).alias("s"))
    return op.fuse(e, ["region"], "x", "s", 0.5, 0.25).select("region", r(F.col("mean")).alias("mean"), r(F.col("variance")).alias("variance"), "sources")


@query("q_softmax_weights", f"WITH {DAILY}, e AS (SELECT region, source, avg(v) / 50 AS x FROM daily GROUP BY ALL) SELECT region, source, round(exp(x) / sum(exp(x)) OVER (PARTITION BY region), 6) AS weight FROM e")
def softmax(spark, sf_dir):
    e = daily(spark, sf_dir).groupBy("region", "source").agg((F.avg("v") / 50).alias("x"))
    return op.softmax_weights(e, ["region"], "x").select("region", "source", r(F.col("weight")).alias("weight"))


@query(
    "q_wave_phase",
    f"""WITH {DAILY}, x AS (SELECT region, source, day, v, v / max(v) OVER (PARTITION BY region, source) AS lvl, (v - lag(v, 3) OVER w) / greatest(abs(lag(v, 3) OVER w), 1.0) AS g FROM daily WINDOW w AS (PARTITION BY region, source ORDER BY day)),
        p AS (SELECT CASE WHEN lvl IS NULL OR g IS NULL THEN 'unknown' WHEN lvl < 0.2 AND g < 0.1 THEN 'baseline' WHEN g >= 0.3 AND lvl < 0.5 THEN 'early_growth' WHEN g >= 0.1 THEN 'acceleration' WHEN lvl >= 0.6 AND g > -0.1 THEN 'peak' ELSE 'decline' END AS phase, source FROM x)
        SELECT source, phase, count(*) AS n FROM p GROUP BY ALL""",
)
def wave_phase(spark, sf_dir):
    w = Window.partitionBy("region", "source")
    b = F.lag("v", 3).over(w.orderBy("day"))
    x = daily(spark, sf_dir).select("source", ratio(F.col("v"), F.max("v").over(w)).alias("level"), ((F.col("v") - b) / F.greatest(F.abs(b), F.lit(1.0))).alias("g"), b.alias("b"))
    g = F.when(F.col("b").isNotNull(), F.col("g"))
    return x.withColumn("phase", op.phase(F.col("level"), g)).groupBy("source", "phase").agg(F.count("*").alias("n"))


@query(
    "q_budget_permission",
    f"""WITH {DEMAND}, x AS (SELECT nation, count(*) AS weeks, avg(v) AS m, stddev_pop(v) / avg(v) AS cv FROM demand GROUP BY nation) SELECT nation, CASE WHEN cv > 0.8 THEN 'blocked' WHEN weeks < 100 THEN 'calibration_window' WHEN m < 400000 THEN 'shadow_only' ELSE 'limited' END AS permission FROM x""",
)
def permission(spark, sf_dir):
    x = demand(spark, sf_dir).groupBy("nation").agg(F.count("*").alias("weeks"), F.avg("v").alias("m"), ratio(F.stddev_pop("v"), F.avg("v")).alias("cv"))
    return x.select("nation", op.permission(F.col("cv") > 0.8, F.col("weeks") >= 100, F.col("m") >= 400000).alias("permission"))


@query(
    "q_evidence_quality",
    f"""WITH {DAILY}, x AS (SELECT source, region, exp(-date_diff('day', max(day), DATE '2024-01-31') / 14.0) AS fresh, count(DISTINCT day) / 30.0 AS cover, 1 / (1 + stddev_pop(v) / avg(v)) AS stable FROM daily GROUP BY ALL)
        SELECT source, region, round(greatest(least(0.4 * fresh + 0.4 * least(cover, 1.0) + 0.2 * stable, 1.0), 0.0), 6) AS quality FROM x""",
)
def evidence_quality(spark, sf_dir):
    x = daily(spark, sf_dir).groupBy("source", "region").agg(F.exp(-F.datediff(F.lit("2024-01-31"), F.max("day")) / 14.0).alias("fresh"), (F.countDistinct("day") / 30.0).alias("cover"), (1 / (1 + ratio(F.stddev_pop("v"), F.avg("v")))).alias("stable"))
    return x.select("source", "region", r(clamp(0.4 * F.col("fresh") + 0.4 * F.least("cover", F.lit(1.0)) + 0.2 * F.col("stable"))).alias("quality"))


@query(
    "q_opportunity_ranking",
    f"""WITH {DEMAND}, x AS (SELECT nation, max_by(v, week) AS now, avg(v) AS m, stddev_pop(v) AS s FROM demand GROUP BY nation), z AS (SELECT nation, 1 / (1 + exp(-(now - m) / s)) AS score FROM x) SELECT nation, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, nation) AS rank FROM z""",
)
def opportunity(spark, sf_dir):
    x = demand(spark, sf_dir).groupBy("nation").agg(F.max_by("v", "week").alias("now"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = x.select("nation", r(sigmoid(ratio(F.col("now") - F.col("m"), F.col("s")))).alias("score"))  # a row per nation
    return z.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "nation")).cast("long"))


@query("q_budget_shares")
def budget_shares(spark, sf_dir):
    x = demand(spark, sf_dir).groupBy("nation").agg(F.sum("v").alias("w"))
    held = x.join(table(spark, sf_dir, "nation"), F.col("nation") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("nation").cast("long").alias("nation"), "w")
    return op.allocate(held, ["region"], "nation", "w", 0.1, 0.35).select("region", "nation", r(F.col("share")).alias("share"))


@query("q_site_alerts")
def site_alerts(spark, sf_dir):
    out = op.alert_states(daily(spark, sf_dir).select("region", "source", F.col("day").cast("string").alias("day"), "v"), ["region", "source"], "day", "v")
    return out.groupBy("source", "state").agg(F.count("*").alias("n"))


@query(
    "q_stockpile_flag",
    "WITH m AS (SELECT l_partkey, quantile_cont(l_quantity, 0.5) AS m, count(*) AS n FROM lineitem GROUP BY 1) SELECT l.l_partkey AS part, l.l_orderkey AS order_key, l.l_linenumber AS line, l.l_quantity AS quantity FROM lineitem l JOIN m ON l.l_partkey = m.l_partkey WHERE l.l_quantity > 1.8 * m.m AND m.n >= 5",
)
def stockpile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy("l_partkey").agg(F.percentile("l_quantity", F.lit(0.5)).alias("m"), F.count("*").alias("n")).where("n >= 5")
    return li.join(m, "l_partkey").where("l_quantity > 1.8 * m").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))


@query(
    "q_stockout",
    """WITH d AS (SELECT l_partkey AS part, sum(l_quantity) / 2400.0 AS per_day, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT part, per_day, CAST(part * 37 % 400 AS DOUBLE) AS stock FROM d)
       SELECT part, CAST(floor(stock / per_day) AS BIGINT) AS days_left, CAST(ceil(per_day * 14 + 2) AS BIGINT) AS reorder_point, CASE WHEN stock / per_day < 7 THEN 'critical' WHEN stock / per_day < 21 THEN 'low' ELSE 'fine' END AS risk FROM x""",
)
def stockout(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg((F.sum("l_quantity") / 2400.0).alias("per_day"))
    days = ratio((F.col("part") * 37 % 400).cast("double"), F.col("per_day"))
    return d.select("part", F.floor(days).alias("days_left"), F.ceil(F.col("per_day") * 14 + 2).alias("reorder_point"), F.when(days < 7, "critical").when(days < 21, "low").otherwise("fine").alias("risk"))


@query(
    "q_quality_gate",
    f"""WITH {DEMAND}, f AS (SELECT nation, week, v, lag(v) OVER w AS p, lag(v, 4) OVER w AS c FROM demand WINDOW w AS (PARTITION BY nation ORDER BY week)), m AS (SELECT nation, avg(abs(p - v)) AS mp, avg(abs(c - v)) AS mc, count(*) AS n FROM f WHERE c IS NOT NULL GROUP BY nation)
        SELECT nation, mp <= 0.95 * mc AS better, n >= 100 AS enough, mp <= 0.95 * mc AND n >= 100 AS passed FROM m""",
)
def gate(spark, sf_dir):
    w = Window.partitionBy("nation").orderBy("week")
    f = demand(spark, sf_dir).withColumn("p", F.lag("v").over(w)).withColumn("c", F.lag("v", 4).over(w)).where("c IS NOT NULL")
    m = f.groupBy("nation").agg(F.avg(F.abs(F.col("p") - F.col("v"))).alias("mp"), F.avg(F.abs(F.col("c") - F.col("v"))).alias("mc"), F.count("*").alias("n"))
    better, enough = F.col("mp") <= 0.95 * F.col("mc"), F.col("n") >= 100
    return m.select("nation", better.alias("better"), enough.alias("enough"), (better & enough).alias("passed"))

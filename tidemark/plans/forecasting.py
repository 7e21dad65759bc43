"""Forecast queries: walk-forward quantiles, choice of a calibration, whole hierarchies, spread of clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r
from ..operators import forecasting as op
from ..operators import learning, metrics, phase
from ..registry import query
from .inputs import DEMAND, demand, scores, table


@query("q_quantile_walk_forward")
def quantile_walk_forward(spark, sf_dir):
    """Per fold: rows, pinball losses, the share inside 80 per cent, and the loss of persistence at the median."""
    w = Window.partitionBy("nation").orderBy("week")
    log = F.log1p("v")
    x = demand(spark, sf_dir).withColumns({"now": log, "before": F.lag(log, 1).over(w), "mean": F.avg(log).over(w.rowsBetween(-8, -1)), "next": F.lead(log).over(w)}).where("before IS NOT NULL AND next IS NOT NULL")
    out = op.quantile_walk_forward(x, "week", ["now", "before", "mean"], "next", (0.1, 0.5, 0.9), 104, 52, 4)
    q, y = F.col("quantiles"), F.col("next")
    m = out.groupBy("fold").agg(F.count("*").alias("n"), *[F.avg(metrics.pinball(y, q[i], p)).alias(name) for i, (p, name) in enumerate(((0.1, "loss_10"), (0.5, "loss_50"), (0.9, "loss_90")))], F.avg(y.between(q[0], q[2]).cast("double")).alias("inside"), F.avg(metrics.pinball(y, F.col("now"), 0.5)).alias("persistence"))
    return m.select("fold", "n", *(r(F.col(c), 4).alias(c) for c in ("loss_10", "loss_50", "loss_90", "inside", "persistence")))


@query("q_calibration_choice")
def calibration_choice(spark, sf_dir):
    s, half = scores(spark, sf_dir), F.col("day") < "2024-01-16"
    name, found = op.choose_calibration(s.where(half), s.where(~half), "score", "label")
    return spark.createDataFrame([(n, n == name, b, e) for n, b, e in found], "calibration string, chosen boolean, brier double, ece double").select("calibration", "chosen", r(F.col("brier"), 5).alias("brier"), r(F.col("ece"), 5).alias("ece"))


@query("q_reconcile_levels")
def reconcile_levels(spark, sf_dir):
    """Nations, regions and the whole: mean weekly demand of each year with its quartiles, made to add up."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.concat(F.lit("r"), "n_regionkey").alias("region"))
    d = demand(spark, sf_dir).join(F.broadcast(n), "nation").select(F.year("week").alias("year"), F.concat(F.lit("n"), "nation").alias("leaf"), "region", "v", F.weekofyear("week").alias("w"))
    level = lambda node, parent: d.groupBy("year", node.alias("node"), parent.alias("parent"), "w").agg(F.sum("v").alias("v"))
    weekly = level(F.col("leaf"), F.col("region")).unionByName(level(F.col("region"), F.lit("all"))).unionByName(level(F.lit("all"), F.lit(None).cast("string")))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    gone = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.coalesce(F.element_at("seen", i), F.lit(0.0)) - F.col("q")[1])
    nodes = weekly.groupBy("year", "node", "parent").agg(q.alias("q"), F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("seen")).withColumn("errors", gone)
    nodes = nodes.select("year", "node", "parent", *(F.col("q")[i].alias(f"q{k}") for i, k in enumerate((25, 50, 75))), "errors")
    out = op.reconcile_levels(nodes, ["year"], "node", "parent", ["q25", "q50", "q75"], "errors")
    return out.select("year", "node", *(r(F.col(f"q{k}_reconciled"), 2).alias(f"q{k}") for k in (25, 50, 75)))


@query("q_cluster_spread", f"WITH {DEMAND}, m AS (SELECT nation, avg(v) AS m FROM demand GROUP BY 1), x AS (SELECT n_regionkey AS region, m FROM m JOIN nation ON nation = n_nationkey) SELECT region, count(*) AS n, round(var_pop(m) / 1e6, 3) AS within, round(var_pop(m) / (SELECT var_pop(m) FROM x), 5) AS share FROM x GROUP BY region")
def cluster_spread(spark, sf_dir):
    m = demand(spark, sf_dir).groupBy("nation").agg(F.avg("v").alias("m"))
    x = m.join(table(spark, sf_dir, "nation"), F.col("nation") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), "m")
    return op.cluster_spread(x, "region", "m").select("region", "n", r(F.col("within") / 1e6, 3).alias("within"), r(F.col("share"), 5).alias("share"))


@query("q_phase_fit")
def phase_fit(spark, sf_dir):
    """Growth and acceleration per nation from the last week's log demand at three delays."""
    kernels = [[1.0], [0.2, 0.5, 0.3], [0.0, 0.1, 0.3, 0.4, 0.2]]
    w = Window.partitionBy("nation").orderBy("week")
    delayed = [sum((k * F.lag("v", a).over(w) for a, k in enumerate(kernel) if k), F.lit(0.0)) for kernel in kernels]
    x = demand(spark, sf_dir).withColumn("z", F.array(*[F.log(F.greatest(d, F.lit(1.0))) for d in delayed])).groupBy("nation").agg(F.max_by("z", "week").alias("z"))
    out = phase.phase_fit(x.withColumn("variance", F.array(*[F.lit(0.01)] * 3)), ["nation"], "z", "variance", kernels)
    return out.select("nation", *(r(F.col(c), 5).alias(c) for c in ("q", "c", "level")), F.array_join("warnings", ",").alias("warnings"))


@query("q_renewal_forecast")
def renewal_forecast(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    edges = n.select("src", ((F.col("src") + 1) % 25).alias("dst"), F.lit(0.6).alias("weight")).unionByName(n.select("src", ((F.col("src") + 24) % 25).alias("dst"), F.lit(0.4).alias("weight")))
    weeks = demand(spark, sf_dir).select("nation", "week", F.col("n").cast("double").alias("n"))
    out = phase.renewal_forecast(weeks, edges, "nation", "week", "n", [0.5, 0.3, 0.2], 4, samples=200)
    return out.select("nation", "ahead", "q10", "q50", "q90", r(F.col("p_up"), 4).alias("p_up"))


@query("q_ridge_shares")
def ridge_shares(spark, sf_dir):
    """What moves next week's demand: coefficients on standardised lags, by an ordinary ridge."""
    w = Window.partitionBy("nation").orderBy("week")
    x = demand(spark, sf_dir).withColumns({"before": F.lag("v").over(w), "mean": F.avg("v").over(w.rowsBetween(-8, -1)), "next": F.lead("v").over(w)})
    out = learning.ridge_shares(x, ["v", "before", "mean"], "next")
    return out.select("feature", r(F.col("share"), 4).alias("share"), r(F.col("r2"), 4).alias("r2"))

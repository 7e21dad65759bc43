"""Model queries. Their fits are iterative, so they have no SQL; tests hold their operators against plain forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r
from ..operators import learning as op
from ..operators import metrics
from ..registry import query
from .inputs import WEEKLY, demand, scores, weekly

LAGS = ["lag_1", "lag_2", "lag_4", "lag_52"]


def lagged(spark, sf_dir):
    w = Window.partitionBy("nation").orderBy("week")
    x = demand(spark, sf_dir).withColumns({f"lag_{k}": F.lag("v", k).over(w) for k in (1, 2, 4, 52)}).withColumn("next", F.lead("v").over(w)).where("next IS NOT NULL")
    return x.withColumn("label", (F.col("next") > 1.1 * F.col("v")).cast("double")).withColumn("test", (F.col("week") >= "2000-01-01").cast("int"))


@query("q_gbt_event")
def gbt_event(spark, sf_dir):
    x = lagged(spark, sf_dir)
    model = op.event_classifier(x.where("test = 0"), ["v", *LAGS], "label", 10)
    out = op.probability(model, x.where("test = 1"), ["v", *LAGS])
    return metrics.roc_auc(out, ["test"], "p", "label").join(metrics.calibration_error(out, ["test"], "p", "label"), "test").select(r(F.col("auc"), 4).alias("auc"), r(F.col("ece"), 4).alias("ece"))


@query("q_logistic_event")
def logistic_event(spark, sf_dir):
    x = lagged(spark, sf_dir)
    out = op.probability(op.logistic(x.where("test = 0"), ["v", *LAGS], "label"), x.where("test = 1"), ["v", *LAGS])
    return metrics.classification(out, ["test"], "p", "label", 0.5).select("tp", "fp", "fn", "tn", r(F.col("brier"), 4).alias("brier"))


@query("q_isotonic")
def isotonic(spark, sf_dir):
    s, half = scores(spark, sf_dir), F.col("day") < "2024-01-16"
    out = op.calibrated(op.isotonic(s.where(half), "score", "label", 3), s.where(~half), "score", "p")
    return metrics.calibration_error(out, ["source"], "p", "label").select("source", r(F.col("ece"), 4).alias("ece"))


@query(
    "q_trend_forecast",
    f"""WITH {WEEKLY}, d AS (SELECT flag, v, v - lag(v) OVER (PARTITION BY flag ORDER BY week) AS s, row_number() OVER (PARTITION BY flag ORDER BY week DESC) AS k FROM weekly), m AS (SELECT flag, max(v) FILTER (k = 1) AS last, avg(s) FILTER (k <= 4) AS step, greatest(stddev_pop(s), 1) AS width FROM d GROUP BY flag),
        f AS (SELECT flag, CAST(h AS INTEGER) AS step, greatest(last + m.step * h, 0) AS mid, 1.2816 * width * sqrt(h) AS half FROM m, (SELECT unnest([1, 2, 3, 4]) AS h))
        SELECT flag, step, round(mid, 4) AS forecast, round(greatest(mid - half, 0), 4) AS low, round(mid + half, 4) AS high FROM f""",
)
def trend_forecast(spark, sf_dir):
    out = op.trend_forecast(weekly(spark, sf_dir).select("flag", F.col("week").cast("string").alias("week"), "v"), ["flag"], "week", "v", 4)
    return out.select("flag", "step", *(r(F.col(c), 4).alias(c) for c in ("forecast", "low", "high")))


@query("q_ward_clusters")
def ward(spark, sf_dir):
    x = demand(spark, sf_dir).groupBy("nation").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").cast("double").alias("n"))
    return op.clusters(x, "nation", ["m", "s", "n"], 3)

"""The driver tables as surveillance inputs, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import week_start

CUTOFF = "2024-01-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark, sf_dir) -> DataFrame:
    """Observations: region, source, event time, and an availability that is late or unknown."""
    e = table(spark, sf_dir, "events")
    known = F.when(F.col("event_id") % 7 != 0, F.col("ts") + F.make_dt_interval((F.col("event_id") % 5).cast("int")))
    return e.select("event_id", (F.col("user_id") % 16).alias("region"), F.col("event_type").alias("source"), "ts", F.to_date("ts").alias("day"), "value", known.alias("available"))


OBS = """obs AS (SELECT event_id, user_id % 16 AS region, event_type AS source, ts, CAST(ts AS DATE) AS day, value,
    CASE WHEN event_id % 7 <> 0 THEN ts + to_days(CAST(event_id % 5 AS INTEGER)) END AS available FROM events)"""


def daily(spark, sf_dir) -> DataFrame:
    return obs(spark, sf_dir).groupBy("region", "source", "day").agg(F.avg("value").alias("v"), F.count("*").alias("n"))


DAILY = OBS + ", daily AS (SELECT region, source, day, avg(value) AS v, count(*) AS n FROM obs GROUP BY ALL)"


def weekly(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), week_start(F.col("l_shipdate")).alias("week")).agg(F.sum("l_quantity").alias("v"))


WEEKLY = "weekly AS (SELECT l_returnflag AS flag, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def demand(spark, sf_dir) -> DataFrame:
    """Weekly order value of each nation; customers are joined by key, nations are a fixed dimension."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), week_start(F.col("o_orderdate")).alias("week")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


DEMAND = "demand AS (SELECT c_nationkey AS nation, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, sum(o_totalprice) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def scores(spark, sf_dir) -> DataFrame:
    """Event probabilities and outcomes per region and day."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).alias("region"), F.col("event_type").alias("source"), F.to_date("ts").alias("day"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), ((F.col("event_id") * 7919) % 500 < F.col("value")).cast("int").alias("label"))


SCORES = "scores AS (SELECT event_id, user_id % 16 AS region, event_type AS source, CAST(ts AS DATE) AS day, least(value / 500, 1.0) AS score, CAST((event_id * 7919) % 500 < value AS INTEGER) AS label FROM events)"

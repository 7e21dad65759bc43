"""As-of visibility, as-of joins and fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r
from ..operators import visibility as op
from ..registry import query
from .inputs import CUTOFF, DAILY, OBS, WEEKLY, daily, obs, table, weekly


def cutoff():
    return F.lit(CUTOFF).cast("timestamp")


@query("q_asof_visible", f"WITH {OBS} SELECT region, source, count(*) AS n, round(sum(value), 4) AS total FROM obs WHERE available <= TIMESTAMP '{CUTOFF}' OR (available IS NULL AND ts <= TIMESTAMP '{CUTOFF}') GROUP BY ALL")
def asof_visible(spark, sf_dir):
    return op.visible(obs(spark, sf_dir), cutoff(), "ts", "available").groupBy("region", "source").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("q_asof_known_only", f"WITH {OBS} SELECT region, source, count(*) AS n, round(sum(value), 4) AS total FROM obs WHERE day <= DATE '{CUTOFF}' AND available <= TIMESTAMP '{CUTOFF}' GROUP BY ALL")
def asof_known(spark, sf_dir):
    return op.visible_known(obs(spark, sf_dir), cutoff(), "ts", "available").groupBy("region", "source").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("q_inferred_availability", f"WITH {OBS}, k AS (SELECT source, available IS NULL AS inferred, coalesce(available, ts + to_days(CASE source WHEN 'click' THEN 3 WHEN 'purchase' THEN 10 ELSE 7 END)) AS known_at FROM obs) SELECT source, inferred, count(*) AS n, CAST(CAST(max(known_at) AS DATE) AS VARCHAR) AS last_known FROM k GROUP BY ALL")
def inferred(spark, sf_dir):
    return op.with_availability(obs(spark, sf_dir), "ts", "available", "source", {"click": 3, "purchase": 10}, 7).groupBy("source", "inferred").agg(F.count("*").alias("n"), F.to_date(F.max("known_at")).cast("string").alias("last_known"))


@query(
    "q_bitemporal_latest",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC) AS k
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-30')
       SELECT l_orderkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS published, l_quantity AS value FROM v WHERE k = 1""",
)
def bitemporal(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    last = op.latest_revision(lines, ["l_orderkey"], F.lit("1998-06-30").cast("timestamp"), "l_shipdate", ["l_linenumber", "l_quantity"])
    return last.select("l_orderkey", F.to_date("l_shipdate").cast("string").alias("published"), F.col("l_quantity").alias("value"))


@query("q_groupwise_max", "SELECT o.o_custkey, o.o_orderkey, o.o_totalprice FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) m ON o.o_custkey = m.o_custkey AND o.o_orderdate = m.d")
def groupwise_max(spark, sf_dir):
    return op.latest_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "q_latest_and_previous",
    f"""WITH {DAILY}, k AS (SELECT region, source, v, row_number() OVER (PARTITION BY region, source ORDER BY day DESC) AS i FROM daily)
        SELECT region, source, round(max(v) FILTER (i = 1), 6) AS latest, round(max(v) FILTER (i = 2), 6) AS previous FROM k WHERE i <= 2 GROUP BY ALL""",
)
def last_two(spark, sf_dir):
    return op.last_two(daily(spark, sf_dir), ["region", "source"], ["day"], "v").select("region", "source", r(F.col("latest")).alias("latest"), r(F.col("previous")).alias("previous"))


_LAGS = ", ".join(f"round(max_by(v, day) FILTER (day <= DATE '{CUTOFF}' - {n}), 6) AS lag_{n}" for n in (0, 7, 14))


@query("q_asof_lags", f"WITH {DAILY} SELECT region, source, {_LAGS} FROM daily WHERE day <= DATE '{CUTOFF}' GROUP BY ALL")
def asof_lags(spark, sf_dir):
    out = op.asof_lags(daily(spark, sf_dir), ["region", "source"], F.lit(CUTOFF).cast("date"), "day", "v", [0, 7, 14])
    return out.select("region", "source", *(r(F.col(f"lag_{n}")).alias(f"lag_{n}") for n in (0, 7, 14)))


@query(
    "q_asof_backward",
    f"""WITH {OBS}, l AS (SELECT * FROM obs WHERE source = 'purchase'), rr AS (SELECT region, ts, max(value) AS value FROM obs WHERE source = 'click' GROUP BY ALL)
        SELECT l.event_id, round(rr.value, 6) AS seen FROM l ASOF LEFT JOIN rr ON l.region = rr.region AND l.ts >= rr.ts""",
)
def asof_backward(spark, sf_dir):
    o = obs(spark, sf_dir)
    right = o.where("source = 'click'").groupBy("region", "ts").agg(F.max("value").alias("value"))
    left = o.where("source = 'purchase'").select("event_id", "region", "ts")
    return op.asof_backward(left, right, ["region"], "ts", "value", ["event_id"]).select("event_id", r(F.col("asof_value")).alias("seen"))


@query(
    "q_asof_nearest",
    """WITH a AS (SELECT l_linestatus AS status, CAST(l_shipdate AS DATE) AS day, count(*) AS lines FROM lineitem GROUP BY ALL),
            b AS (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, min(o_totalprice) AS v FROM orders GROUP BY ALL),
            p AS (SELECT a.status, a.day, a.lines, b.day AS near, b.v, row_number() OVER (PARTITION BY a.status, a.day ORDER BY abs(date_diff('day', b.day, a.day)), b.day) AS k FROM a JOIN b ON a.status = b.status AND b.day BETWEEN a.day - 10 AND a.day + 10)
       SELECT status, CAST(day AS VARCHAR) AS day, lines, CAST(near AS VARCHAR) AS nearest_day, round(v, 4) AS nearest_value FROM p WHERE k = 1""",
)
def asof_nearest(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("day"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    out = op.asof_nearest(lines, orders, ["status"], "day", "o_totalprice", 10).groupBy("status", "day", "nearest_day", "nearest_value").agg(F.count("*").alias("lines"))
    return out.select("status", F.col("day").cast("string").alias("day"), "lines", F.col("nearest_day").cast("string").alias("nearest_day"), r(F.col("nearest_value"), 4).alias("nearest_value"))


@query(
    "q_national_fallback",
    f"""WITH {OBS}, hourly AS (SELECT region, source, date_trunc('hour', ts) AS hour, avg(value) AS v FROM obs GROUP BY ALL)
        SELECT source, strftime(hour, '%Y-%m-%d %H') AS hour, region, round(v, 6) AS v FROM hourly x WHERE region <> 0 OR NOT EXISTS (SELECT 1 FROM hourly y WHERE y.region <> 0 AND y.source = x.source AND y.hour = x.hour)""",
)
def fallback(spark, sf_dir):
    hourly = obs(spark, sf_dir).groupBy("region", "source", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    out = op.without_superseded(hourly, ["source", "hour"], F.col("region") == 0)
    return out.select("source", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "region", r(F.col("v")).alias("v"))


_SPANS = [("1995-12-20", "1996-01-06"), ("1997-07-01", "1997-08-15"), ("1997-08-10", "1997-08-20")]


@query("q_interval_flag", "SELECT (" + " OR ".join(f"CAST(o_orderdate AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in _SPANS) + ") AS holiday, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def interval(spark, sf_dir):
    spans = spark.createDataFrame(_SPANS, "a string, b string").selectExpr("cast(a as date) a", "cast(b as date) b")
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return op.in_interval(days, "day", spans, "a", "b", "holiday").groupBy("holiday").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "q_alias_priority",
    f"""WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY region, day ORDER BY CASE source WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, source, event_id) AS i FROM obs)
        SELECT region, CAST(day AS VARCHAR) AS day, source, event_id FROM k WHERE i = 1""",
)
def alias_priority(spark, sf_dir):
    return op.best_alias(obs(spark, sf_dir), ["region", "day"], "source", ["purchase", "click"], ["source", "event_id"]).select("region", F.col("day").cast("string").alias("day"), "source", "event_id")


@query(
    "q_forecast_vintage",
    f"""WITH {WEEKLY}, f AS (SELECT flag, week AS run, week + to_days(7 * h) AS target, v * (1 + 0.01 * h) AS v, week + to_days(2) AS known FROM weekly, (SELECT unnest([1, 2, 3]) AS h)),
            l AS (SELECT max(run) AS run FROM f WHERE known <= TIMESTAMP '1998-03-04' AND run <= TIMESTAMP '1998-03-04')
        SELECT flag, CAST(CAST(target AS DATE) AS VARCHAR) AS target, round(v, 4) AS v FROM f JOIN l USING (run) WHERE target > TIMESTAMP '1998-03-04'""",
)
def vintage(spark, sf_dir):
    f = weekly(spark, sf_dir).select("flag", F.col("week").alias("run"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("h"), "v")
    f = f.select("flag", "run", F.date_add("run", F.col("h") * 7).alias("target"), (F.col("v") * (1 + 0.01 * F.col("h"))).alias("v"), F.date_add("run", 2).alias("known"))
    return op.latest_run(f, F.lit("1998-03-04").cast("date"), "run", "known", "target").select("flag", F.col("target").cast("string").alias("target"), r(F.col("v"), 4).alias("v"))


@query(
    "q_asof_scaled",
    f"""WITH {DAILY}, t AS (SELECT region, source, max(v) FILTER (day > DATE '{CUTOFF}' - 365) AS top, max_by(v, day) AS a, max_by(v, day) FILTER (day <= DATE '{CUTOFF}' - 7) AS b, max_by(v, day) FILTER (day <= DATE '{CUTOFF}' - 14) AS c FROM daily WHERE day <= DATE '{CUTOFF}' GROUP BY ALL)
        SELECT region, source, round(coalesce(a / top, 0), 6) AS lag_0, round(coalesce(b / top, 0), 6) AS lag_7, round(coalesce(c / top, 0), 6) AS lag_14 FROM t""",
)
def asof_scaled(spark, sf_dir):
    """Levels as of the cutoff and of one and two weeks before, over the year's greatest."""
    out = op.asof_scaled(daily(spark, sf_dir), ["region", "source"], F.lit(CUTOFF).cast("date"), "day", "v", [7, 14])
    return out.select("region", "source", *(r(F.col(c)).alias(c) for c in ("lag_0", "lag_7", "lag_14")))


@query(
    "q_future_window",
    f"""WITH {DAILY}, t AS (SELECT region, source, max_by(v, day) FILTER (day <= DATE '{CUTOFF}') AS now, max(v) FILTER (day BETWEEN DATE '{CUTOFF}' + 3 AND DATE '{CUTOFF}' + 7) AS peak, count(*) FILTER (day BETWEEN DATE '{CUTOFF}' + 3 AND DATE '{CUTOFF}' + 7) AS n FROM daily GROUP BY ALL)
        SELECT region, source, round(now, 6) AS now, round(peak, 6) AS peak, n, CAST(peak >= 1.2 * now AS INTEGER) AS label FROM t""",
)
def future_window(spark, sf_dir):
    """What the third to seventh day after the cutoff brought, and whether that is a rise."""
    out = op.future_window(daily(spark, sf_dir), ["region", "source"], F.lit(CUTOFF).cast("date"), "day", "v", 3, 7, 1.2)
    return out.select("region", "source", r(F.col("now")).alias("now"), r(F.col("peak")).alias("peak"), "n", "label")

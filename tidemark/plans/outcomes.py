"""Intervals, budget rules, stages of a signal, frames carried on, and batches taken in once."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import r
from ..operators import intervals, readiness, scores, series
from ..registry import query
from ..sources.ledger import Store
from .inputs import DEMAND, OBS, demand, obs, table
from .readiness import panel

_ORDERS = "o AS (SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(
    "q_interval_distances",
    f"""WITH {_ORDERS}, s AS (SELECT nation, day AS a, day + CAST(o_orderkey % 6 AS INTEGER) AS b FROM o WHERE o_orderpriority LIKE '1%'), d AS (SELECT DISTINCT nation, day FROM o),
        n AS (SELECT d.nation, d.day, coalesce(bool_or(a <= d.day AND d.day <= b), false) AS inside, coalesce(min(a - d.day) FILTER (a > d.day), 15) AS days_until, coalesce(min(d.day - b) FILTER (b < d.day), 15) AS days_since FROM d LEFT JOIN s ON s.nation = d.nation GROUP BY ALL),
        h AS (SELECT nation, day, day + CAST(i AS INTEGER) AS ahead FROM d, (SELECT unnest(range(1, 15)) AS i)), c AS (SELECT h.nation, h.day, count(DISTINCT h.ahead) AS k FROM h JOIN s ON s.nation = h.nation AND h.ahead BETWEEN s.a AND s.b GROUP BY ALL)
        SELECT n.nation, CAST(n.day AS VARCHAR) AS day, inside, CAST(days_until AS BIGINT) AS days_until, CAST(days_since AS BIGINT) AS days_since, round(coalesce(k, 0) / 14, 6) AS overlap FROM n LEFT JOIN c ON n.nation = c.nation AND n.day = c.day""",
)
def interval_distances(spark, sf_dir):
    """Every day with orders of a nation, against intervals that its urgent orders open: distances and what is covered ahead."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderpriority")
    spans = o.where("o_orderpriority LIKE '1%'").select("nation", F.col("day").alias("a"), F.date_add("day", (F.col("o_orderkey") % 6).cast("int")).alias("b"))
    out = intervals.interval_distances(o.select("nation", "day").distinct(), spans, ["nation"], "day", "a", "b", 14)
    return out.select("nation", F.col("day").cast("string").alias("day"), "inside", F.col("days_until").cast("long").alias("days_until"), F.col("days_since").cast("long").alias("days_since"), r(F.col("overlap")).alias("overlap"))


@query("q_lift_intervals")
def lift_intervals(spark, sf_dir):
    """Per year the lift of hits over persistence in the weeks with both, with its interval from blocks of weeks."""
    weeks = readiness.panel_weeks(panel(spark, sf_dir), ["week"], "nation", "score", "label", "known").withColumn("y", F.year("week").cast("long"))
    out = intervals.lift_intervals(weeks.select("y", "week", F.col("hit").cast("double").alias("hit"), F.col("persistence_hit").cast("double").alias("base")), ["y"], "week", "hit", "base")
    return out.select("y", "blocks", *(r(F.col(c)).alias(c) for c in ("lift", "low", "high")))


_STRATEGIES = {"model": "p * (growth + 1e-6)", "static": "1.0", "population": "pop", "current": "known", "growth": "growth", "persistence": "known", "oracle": "rise"}


@query(
    "q_spending_strategies",
    f"""WITH {DEMAND}, pop AS (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS pop FROM customer GROUP BY 1),
        x AS (SELECT week, nation, v / 997 AS known, avg(v) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) / 997 AS expected, coalesce(lead(v) OVER (PARTITION BY nation ORDER BY week) / 997, 0) AS actual, (n % 7) / 10.0 AS p FROM demand),
        y AS (SELECT week, nation, known, p, coalesce(pop, 1.0) AS pop, greatest(actual - known, 0) AS rise, greatest(coalesce(expected, 0) - known, 0) AS growth FROM x LEFT JOIN pop USING (nation)),
        z AS (SELECT *, sum(rise) OVER (PARTITION BY week) AS total, count(*) OVER (PARTITION BY week) AS m FROM y), e AS (SELECT week, nation, rise, total, m, unnest([{", ".join(f"{{'strategy': '{k}', 'score': CAST({v} AS DOUBLE)}}" for k, v in _STRATEGIES.items())}], recursive := true) FROM z WHERE total > 0 AND m > 1),
        w AS (SELECT *, sum(score) OVER (PARTITION BY week, strategy) AS s, row_number() OVER (PARTITION BY week, strategy ORDER BY score DESC, nation) AS k FROM e),
        c AS (SELECT week, strategy, sum(CASE WHEN s > 0 THEN score / s ELSE 1.0 / m END * rise) / max(total) AS capture, CASE WHEN strategy = 'oracle' THEN 1 ELSE avg((rise > 0)::INT) FILTER (k <= 3) END AS hits FROM w GROUP BY week, strategy),
        g AS (SELECT *, greatest(max(capture) FILTER (strategy = 'oracle') OVER (PARTITION BY week) - capture, 0) AS regret FROM c), a AS (SELECT strategy, count(*) AS issues, round(avg(capture), 6) AS capture, round(avg(regret), 6) AS regret, round(avg(hits), 6) AS hits FROM g GROUP BY strategy)
        SELECT strategy, issues, capture, regret, hits, round(regret - (SELECT regret FROM a WHERE strategy = 'model'), 6) + 0.0 AS reduction, CASE WHEN strategy <> 'oracle' THEN CAST(row_number() OVER (ORDER BY strategy = 'oracle', regret, strategy <> 'model', strategy) AS INTEGER) END AS rank FROM a""",
)
def spending_strategies(spark, sf_dir):
    """Budget rules held against an oracle, issue by issue."""
    w = Window.partitionBy("nation").orderBy("week")
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("pop"))
    x = demand(spark, sf_dir).select("week", "nation", (F.col("v") / 997).alias("known"), (F.avg("v").over(w.rowsBetween(-8, -1)) / 997).alias("expected"), (F.lead("v").over(w) / 997).alias("actual"), ((F.col("n") % 7) / 10).alias("p")).join(people, "nation", "left")
    out = scores.strategy_report(scores.strategy_metrics(x, ["week"], "nation", "known", "expected", "actual", "pop", "p"), ["week"])
    return out.select("strategy", "issues", "capture", "regret", "hits", (F.col("reduction") + F.lit(0.0)).alias("reduction"), "rank")


_LIMITS = {f"{level}_{name}": v for level, vs in {"activate": (0.6, 0.55, 0.5, 0.4, 0.6, 0.4, 0.5), "prepare": (0.4, 0.3, 0.3, 0.2, 0.8, 0.1, 0.3)}.items() for name, v in zip(("score", "probability", "confidence", "freshness", "revision_risk", "trend", "agreement"), vs, strict=True)}
_INPUTS = {"decision": 101, "probability": 103, "confidence": 107, "freshness": 109, "risk": 113, "trend": 127, "support": 131}


def _rule(level: str, score: float, probability: bool, agreed: str) -> str:
    more = f" AND probability >= {_LIMITS[f'{level}_probability']}" if probability else ""
    return f"decision >= {score} AND confidence >= {_LIMITS[f'{level}_confidence']} AND freshness >= {_LIMITS[f'{level}_freshness']} AND risk <= {_LIMITS[f'{level}_revision_risk']} AND trend >= {_LIMITS[f'{level}_trend']} AND ({agreed}){more}"


@query(
    "q_signal_stage",
    f"""WITH {OBS}, x AS (SELECT source, {", ".join(f"(event_id * {k} % 97) / 96.0 AS {c}" for c, k in _INPUTS.items())}, event_id % 4 AS signals, CASE WHEN event_id % 3 = 0 THEN 'Up' WHEN event_id % 3 = 1 THEN 'down' END AS direction FROM obs)
        SELECT source, CASE WHEN {_rule("activate", 0.6, True, "signals < 2 OR support >= 0.5")} THEN 'activate' WHEN {_rule("prepare", 0.4, True, "signals < 2 OR support >= 0.3")} THEN 'prepare'
            WHEN {_rule("prepare", 0.34, False, "(signals < 2 AND lower(direction) = 'up') OR (signals >= 2 AND support >= 0.3)")} THEN 'prepare_early' ELSE 'watch' END AS stage, count(*) AS n FROM x GROUP BY ALL""",
)
def signal_stage(spark, sf_dir):
    """What each event's signal asks for, by eight inputs."""
    i = F.col("event_id")
    x = obs(spark, sf_dir).select("source", *[((i * k % 97) / 96.0).alias(c) for c, k in _INPUTS.items()], (i % 4).alias("signals"), F.when(i % 3 == 0, "Up").when(i % 3 == 1, "down").alias("direction"))
    stage = scores.signal_stage(*[F.col(c) for c in (*_INPUTS, "signals", "direction")], _LIMITS)
    return x.groupBy("source", stage.alias("stage")).agg(F.count("*").alias("n"))


@query(
    "q_extended_frame",
    f"""WITH {DEMAND}, l AS (SELECT nation, max(week) AS last, max_by(v, week) AS v FROM demand GROUP BY nation), u AS (SELECT max(week) + 5 AS until FROM demand),
        e AS (SELECT nation, CAST(unnest(generate_series(CAST(last AS TIMESTAMP) + INTERVAL 1 DAY, CAST(until AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS week, v, true AS filled FROM l, u WHERE until - last BETWEEN 1 AND 14), f AS (SELECT nation, week, v, false AS filled FROM demand UNION ALL SELECT * FROM e)
        SELECT nation, CAST(week AS VARCHAR) AS day, filled, round(v, 2) AS v, round(lag(v, 1, 0) OVER w, 2) AS lag_1, round(avg(v) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 2) AS mean_7 FROM f WINDOW w AS (PARTITION BY nation ORDER BY week)""",
)
def extended_frame(spark, sf_dir):
    """Nations' series carried on to a common day, and lags over what that gives."""
    d = demand(spark, sf_dir).drop("n")
    until = d.agg(F.date_add(F.max("week"), 5).alias("until")).first().until
    out = series.extended_to(d, ["nation"], "week", F.lit(until), ["v"])
    w = Window.partitionBy("nation").orderBy("week")
    return out.select("nation", F.col("week").cast("string").alias("day"), "filled", r(F.col("v"), 2).alias("v"), r(F.lag("v", 1, 0.0).over(w), 2).alias("lag_1"), r(F.avg("v").over(w.rowsBetween(-7, -1)), 2).alias("mean_7"))


@query(
    "q_batch_ingest",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice, 2) WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) * 2 END AS price, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 THEN 'none' ELSE o_orderstatus END AS status FROM orders WHERE o_totalprice > 0""",
)
def batch_ingest(spark, sf_dir):
    """All orders taken in as a batch, two thirds of them replaced by a second one, the first one sent again and a third one merged
    that tells nothing new of prices. The store is a table of its own in the shared folder."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("price"), F.col("o_orderstatus").alias("status"))
    store = Store(spark, f"{scratch.folder(spark)}/tidemark-store-{uuid.uuid4().hex}", "k long, price double, status string", ["k"], {"price_not_positive": F.col("price") > 0})
    store.ingest(o, "orders", "1")
    # the rules hold for merged rows; in the replacing batch a null price stands for a price withdrawn
    store.rules = {}
    seven = F.col("k") % 7 == 0
    store.ingest(o.where("k % 3 <> 0 AND price > 0").select("k", F.when(~seven, F.col("price") * 2).alias("price"), F.when(seven, "none").otherwise(F.col("status")).alias("status")), "orders", "2", mode="replace")
    store.ingest(o, "orders", "1")
    store.ingest(o.where("price > 0 AND k % 3 = 0").select("k", F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("status")), "orders", "3")
    return store.current()

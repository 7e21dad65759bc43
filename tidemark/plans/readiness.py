"""Readiness of forecasts, signal quality, matches, vintages and ingest of outcomes over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import r
from ..operators import metrics
from ..operators import readiness as op
from ..operators import scores as score_op
from ..operators import visibility
from ..registry import query
from .inputs import DEMAND, OBS, WEEKLY, demand, obs, table, weekly

PANEL = f"""{DEMAND}, lagged AS (SELECT nation, week, v, lag(v) OVER w AS before, lag(v, 2) OVER w AS before2, lead(v) OVER w AS next FROM demand WINDOW w AS (PARTITION BY nation ORDER BY week)),
    panel AS (SELECT week, nation, CASE WHEN before IS NOT NULL THEN (v + before) / 2 END AS score, before AS known, CASE WHEN next IS NOT NULL THEN CAST(next > 1.3 * v AS INTEGER) END AS label FROM lagged)"""


def panel(spark, sf_dir):
    w = Window.partitionBy("nation").orderBy("week")
    x = demand(spark, sf_dir).withColumn("before", F.lag("v").over(w)).withColumn("next", F.lead("v").over(w))
    return x.select("week", "nation", F.when(F.col("before").isNotNull(), (F.col("v") + F.col("before")) / 2).alias("score"), F.col("before").alias("known"), F.when(F.col("next").isNotNull(), (F.col("next") > 1.3 * F.col("v")).cast("int")).alias("label"))


WEEKS = PANEL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY score DESC, nation) AS s, row_number() OVER (PARTITION BY week ORDER BY known DESC NULLS LAST, nation) AS k FROM panel WHERE score IS NOT NULL AND label IS NOT NULL),
    counted AS (SELECT week, count(*) AS scored, sum(label) AS events, bool_or(label = 1 AND s <= 3) AS hit, CASE WHEN count(known) = count(*) THEN bool_or(label = 1 AND k <= 3) END AS persistence_hit FROM ranked GROUP BY week),
    weeks AS (SELECT *, CASE WHEN events > 0 THEN 1 - greatest(scored - events, 0) / scored * CASE WHEN scored >= 2 THEN greatest(scored - events - 1, 0) / (scored - 1) ELSE 1 END * CASE WHEN scored >= 3 THEN greatest(scored - events - 2, 0) / (scored - 2) ELSE 1 END END AS random_hit, scored >= 14 AND events > 0 AS evaluable FROM counted)"""


@query("q_panel_weeks", f"WITH {WEEKS} SELECT CAST(week AS VARCHAR) AS week, scored, CAST(events AS BIGINT) AS events, hit, persistence_hit, round(random_hit, 6) AS random_hit, evaluable FROM weeks")
def panel_weeks(spark, sf_dir):
    out = op.panel_weeks(panel(spark, sf_dir), ["week"], "nation", "score", "label", "known")
    return out.select(F.col("week").cast("string").alias("week"), "scored", "events", "hit", "persistence_hit", r(F.col("random_hit")).alias("random_hit"), "evaluable")


@query(
    "q_truth_card",
    f"""WITH {WEEKS}, m AS (SELECT year(week) AS y, count(*) FILTER (evaluable) AS weeks, avg(hit::INT) FILTER (evaluable) AS hit_rate, avg(persistence_hit::INT) FILTER (evaluable) AS p, avg(random_hit) FILTER (evaluable) AS q, count(*) FILTER (NOT evaluable AND events > 0) AS rejected,
            avg(scored) / 20.0 AS pr, 1.0 AS base_pr, avg(hit::INT) AS prec, avg(persistence_hit::INT) AS base_prec, 0.04 + (year(week) % 3) * 0.01 AS ece, year(week) % 2 = 0 AS passed FROM weeks GROUP BY year(week)),
        x AS (SELECT *, list_filter([CASE WHEN weeks < 12 THEN 'too_few_weeks' END, CASE WHEN hit_rate IS NULL THEN 'no_weeks' END, CASE WHEN hit_rate < 0.6 THEN 'hit_rate_low' END, CASE WHEN hit_rate - p < 0.05 THEN 'not_better_than_persistence' END, CASE WHEN pr / base_pr < 1.05 THEN 'pr_auc_not_better' END, CASE WHEN prec - base_prec < 0 THEN 'precision_below_persistence' END, CASE WHEN NOT passed THEN 'gates_not_passed' END], lambda c: c IS NOT NULL) AS blockers,
            list_filter([CASE WHEN hit_rate IS NOT NULL AND p IS NULL THEN 'persistence_unknown' END, CASE WHEN hit_rate - q < 0.05 THEN 'not_better_than_random' END, CASE WHEN rejected > 0 THEN 'weeks_rejected' END, CASE WHEN pr IS NULL THEN 'pr_auc_unknown' END, CASE WHEN prec - base_prec IS NULL THEN 'precision_unknown' END, CASE WHEN ece > 0.05 THEN 'ece_high' END], lambda c: c IS NOT NULL) AS warnings,
            round(coalesce(least(greatest(hit_rate, 0), 1), 0) * 35 + coalesce(least(greatest((pr / base_pr - 1) / 2, 0), 1), 0) * 25 + coalesce(least(greatest((prec - base_prec + 0.05) / 0.25, 0), 1), 0) * 20 + least(greatest((0.1 - ece) / 0.1, 0), 1) * 10 + CASE WHEN passed THEN 10 ELSE 4 END, 1) AS raw FROM m)
        SELECT y, weeks, round(hit_rate, 6) AS hit_rate, array_to_string(blockers, ',') AS blockers, array_to_string(warnings, ',') AS warnings, CASE WHEN len(blockers) > 0 THEN 'blocked' WHEN len(warnings) > 0 THEN 'candidate' ELSE 'go' END AS readiness,
            CASE WHEN len(blockers) > 0 THEN least(raw, 49) WHEN len(warnings) > 0 THEN least(raw, 79) ELSE greatest(raw, 80) END AS score FROM x""",
)
def truth_card(spark, sf_dir):
    weeks = op.panel_weeks(panel(spark, sf_dir), ["week"], "nation", "score", "label", "known").withColumn("y", F.year("week").cast("long"))
    measures = weeks.groupBy("y").agg((F.avg("scored") / 20.0).alias("pr_auc"), F.lit(1.0).alias("base_pr_auc"), F.avg(F.col("hit").cast("double")).alias("precision"), F.avg(F.col("persistence_hit").cast("double")).alias("base_precision"))
    measures = measures.withColumn("ece", 0.04 + (F.col("y") % 3) * 0.01).withColumn("passed", F.col("y") % 2 == 0)
    out = op.truth_card(weeks, measures, ["y"])
    return out.select("y", "weeks", r(F.col("hit_rate")).alias("hit_rate"), F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"), "readiness", "score")


@query(
    "q_five_gates",
    f"""WITH {OBS}, s AS (SELECT source, region, least(value / 500, 1.0) AS p, CAST((event_id * 7919) % 500 < value AS INTEGER) AS y FROM obs),
        m AS (SELECT source, region, count(*) FILTER (p >= 0.3 AND y = 1) / nullif(count(*) FILTER (p >= 0.3), 0) AS prec, count(*) FILTER (p >= 0.3 AND y = 0) / nullif(count(*) FILTER (y = 0), 0) AS fa, avg((p - y) ** 2) AS brier, avg(y) * (1 - avg(y)) AS clim FROM s GROUP BY ALL),
        b AS (SELECT source, region, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(p) AS pp, avg(y) AS yy FROM s GROUP BY ALL), e AS (SELECT source, region, sum(n * abs(pp - yy)) / sum(n) AS ece FROM b GROUP BY ALL)
        SELECT m.source, m.region, concat_ws(',', CASE WHEN coalesce(prec < 0.7, true) THEN 'precision' END, CASE WHEN coalesce(fa > 0.25, true) THEN 'false_alarm_rate' END, CASE WHEN coalesce(1 - brier < 1.15 * (1 - clim), true) THEN 'pr_auc_lift' END, CASE WHEN coalesce(brier > 0.9 * clim, true) THEN 'brier_ratio' END, CASE WHEN coalesce(ece > 0.05, true) THEN 'ece' END) AS failed FROM m JOIN e ON m.source = e.source AND m.region = e.region""",
)
def five_gates(spark, sf_dir):
    s = obs(spark, sf_dir).select("source", "region", F.least(F.col("value") / 500, F.lit(1.0)).alias("p"), ((F.col("event_id") * 7919) % 500 < F.col("value")).cast("int").alias("y"))
    keys = ["source", "region"]
    base = s.groupBy(*keys).agg((F.avg("y") * (1 - F.avg("y"))).alias("climatology"))
    m = metrics.classification(s, keys, "p", "y", 0.3).join(metrics.calibration_error(s, keys, "p", "y"), keys).join(base, keys)
    failed = op.quality_gates(F.col("precision"), F.col("false_alarm_rate"), 1 - F.col("brier"), 1 - F.col("climatology"), F.col("brier"), F.col("climatology"), F.col("ece"))
    return m.select(*keys, F.array_join(failed, ",").alias("failed"))


@query(
    "q_reliability_score",
    f"""WITH {OBS}, s AS (SELECT source, region, least(value / 500, 1.0) AS p, CAST((event_id * 7919) % 500 < value AS INTEGER) AS y FROM obs), m AS (SELECT source, region, avg((p - y) ** 2) AS brier, -avg(CASE WHEN y = 1 THEN ln(greatest(p, 1e-6)) ELSE ln(greatest(1 - p, 1e-6)) END) AS ll, count(*) AS n, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY ALL)
        SELECT source, region, round((least(greatest(1 - brier / 0.25, 0), 1) + least(greatest(1 - ll / 1.2, 0), 1)) / 2 * greatest(0.25, least(1.0, greatest(n / 40, least(pos, neg) / 10))), 4) AS reliability FROM m""",
)
def reliability_score(spark, sf_dir):
    p, y, none = F.least(F.col("value") / 500, F.lit(1.0)), ((F.col("event_id") * 7919) % 500 < F.col("value")).cast("int"), F.lit(None).cast("double")
    s = obs(spark, sf_dir).select("source", "region", p.alias("p"), y.alias("y"))
    loss = -F.avg(F.when(F.col("y") == 1, F.log(F.greatest("p", F.lit(1e-6)))).otherwise(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))
    m = s.groupBy("source", "region").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), loss.alias("ll"), F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return m.select("source", "region", op.reliability_score(F.col("brier"), none, F.col("ll"), none, none, F.col("n"), F.col("pos"), F.col("neg")).alias("reliability"))


@query(
    "q_drift",
    f"""WITH {DEMAND}, f AS (SELECT nation, v, lag(v) OVER (PARTITION BY nation ORDER BY week) AS p FROM demand), m AS (SELECT nation, count(*) AS n, 100 * avg(CASE WHEN v <> 0 THEN abs((p - v) / v) END) AS mape FROM f WHERE p IS NOT NULL GROUP BY nation) SELECT nation, n, round(mape, 4) AS mape, CASE WHEN n >= 5 THEN mape > 35 END AS drifted FROM m""",
)
def drift(spark, sf_dir):
    f = demand(spark, sf_dir).withColumn("p", F.lag("v").over(Window.partitionBy("nation").orderBy("week"))).where("p IS NOT NULL")
    m = metrics.regression(f, ["nation"], "v", "p").withColumn("mape", 100 * F.col("mape"))
    return m.select("nation", "n", r(F.col("mape"), 4).alias("mape"), op.drift(F.col("n"), F.col("mape")).alias("drifted"))


@query("q_false_triggers", "SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus IN ('O', 'P') AND NOT o_totalprice > 200000) AS false_triggers FROM orders GROUP BY 1")
def false_triggers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderstatus", (F.col("o_totalprice") > 200000).alias("onset"))
    return op.false_triggers(o, ["priority"], "o_orderstatus", "onset", ("O", "P"))


_PHASES = ["pre_wave", "early_growth", "acceleration", "peak_plateau", "decline", "post_wave", "unknown"]
_PHASE_SQL = lambda x: "CASE " + " ".join(f"WHEN {x} = {i} THEN '{p}'" for i, p in enumerate(_PHASES)) + " END"


@query(
    "q_phase_match",
    f"""WITH x AS (SELECT {_PHASE_SQL('l_linenumber % 7')} AS a, {_PHASE_SQL('l_orderkey % 7')} AS b FROM lineitem), y AS (SELECT CASE WHEN a = b THEN 1.0 WHEN a IN ('early_growth', 'acceleration') AND b IN ('early_growth', 'acceleration') THEN 0.85 WHEN a IN ('pre_wave', 'post_wave', 'unknown') AND b IN ('pre_wave', 'post_wave', 'unknown') THEN 0.7 WHEN a = 'early_growth' AND b = 'peak_plateau' THEN 0.65 WHEN a = 'decline' AND b = 'peak_plateau' THEN 0.55 ELSE 0.35 END AS fit FROM x)
        SELECT CAST(fit AS DOUBLE) AS fit, count(*) AS n FROM y GROUP BY fit""",
)
def phase_match(spark, sf_dir):
    named = lambda c: F.element_at(F.array(*[F.lit(p) for p in _PHASES]), (F.col(c) % 7 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(op.phase_match(named("l_linenumber"), named("l_orderkey")).alias("fit")).agg(F.count("*").alias("n"))


@query(
    "q_signal_quality",
    f"""WITH {OBS}, x AS (SELECT event_id, date_diff('day', coalesce(CAST(available AS DATE), day), DATE '2024-01-31') AS age, available, CASE WHEN event_id % 5 <> 0 THEN (event_id % 40) / 100.0 END AS cov, event_id % 50 AS sites, value, CASE WHEN event_id % 4 <> 0 THEN value * 0.5 END AS lo, value * 1.7 AS hi, CASE WHEN event_id % 3 <> 0 THEN event_id % 3 = 1 END AS bg FROM obs),
        y AS (SELECT *, greatest(hi - lo, 0) / greatest(abs(value), 1e-6) AS width FROM x),
        z AS (SELECT *, least(greatest(1 - greatest(age, 0) / 28, 0), 1) AS f, CASE WHEN cov IS NULL THEN 0.55 ELSE least(cov / 0.25, 1) END AS c, CASE WHEN sites <= 0 THEN 0.5 ELSE least(sites / 40, 1) END AS s, CASE WHEN lo IS NULL THEN 0.65 ELSE least(greatest(1 - width / 3, 0), 1) END AS u, CASE WHEN bg IS NULL THEN 0.8 WHEN bg THEN 0.25 ELSE 1.0 END AS d FROM y)
        SELECT event_id, round(least(0.24 * f + 0.20 * c + 0.16 * s + 0.18 * u + 0.10 * d + 0.12 * CASE WHEN sites <= 0 THEN 0.55 ELSE 0.5 * s + 0.5 * u END, 1), 6) AS quality,
            concat_ws(',', CASE WHEN available IS NULL THEN 'available_time_missing' END, CASE WHEN greatest(age, 0) > 21 THEN 'stale' END, CASE WHEN cov IS NULL THEN 'coverage_missing' END, CASE WHEN cov < 0.05 THEN 'low_coverage' END, CASE WHEN sites <= 0 THEN 'sites_missing' END, CASE WHEN sites > 0 AND sites < 8 THEN 'few_sites' END, CASE WHEN lo IS NULL THEN 'interval_missing' END, CASE WHEN lo IS NOT NULL AND width > 1.5 THEN 'wide_interval' END, CASE WHEN bg THEN 'below_detection' END, CASE WHEN bg IS NULL THEN 'detection_missing' END) AS flags FROM z""",
)
def signal_quality(spark, sf_dir):
    o, e = obs(spark, sf_dir), F.col("event_id")
    out = op.signal_quality(
        o, F.lit("2024-01-31").cast("date"), F.col("day"), F.to_date("available"), F.when(e % 5 != 0, (e % 40) / 100.0), e % 50, F.col("value"), F.when(e % 4 != 0, F.col("value") * 0.5), F.col("value") * 1.7, F.when(e % 3 != 0, e % 3 == 1)
    )
    return out.select("event_id", r(F.col("quality")).alias("quality"), F.array_join("flags", ",").alias("flags"))


@query(
    "q_greedy_match",
    f"""WITH RECURSIVE {DEMAND}, x AS (SELECT nation, week, row_number() OVER (PARTITION BY nation ORDER BY week) AS i, coalesce(v > 1.2 * lag(v) OVER (PARTITION BY nation ORDER BY week), false) AS a, coalesce(v > avg(v) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) * 1.3, false) AS s FROM demand),
        al AS (SELECT nation, i, row_number() OVER (PARTITION BY nation ORDER BY i) AS n FROM x WHERE a), sp AS (SELECT nation, i FROM x WHERE s),
        near AS (SELECT al.nation, al.n, al.i, list_sort(list(sp.i) FILTER (sp.i IS NOT NULL)) AS open FROM al LEFT JOIN sp ON sp.nation = al.nation AND sp.i BETWEEN al.i AND al.i + 4 GROUP BY ALL),
        walk AS (SELECT nation, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS lead FROM (SELECT DISTINCT nation FROM x)
            UNION ALL SELECT w.nation, near.n, coalesce(list_min(list_filter(coalesce(near.open, []), lambda q: q > w.last)), w.last), list_min(list_filter(coalesce(near.open, []), lambda q: q > w.last)) - near.i FROM walk w JOIN near ON near.nation = w.nation AND near.n = w.n + 1),
        h AS (SELECT nation, count(lead) AS hits, quantile_cont(lead, 0.5) AS median_lead FROM walk GROUP BY nation)
        SELECT h.nation, hits, (SELECT count(*) FROM al WHERE al.nation = h.nation) - hits AS false_alarms, (SELECT count(*) FROM sp WHERE sp.nation = h.nation) - hits AS misses, median_lead FROM h""",
)
def greedy_match(spark, sf_dir):
    w = Window.partitionBy("nation").orderBy("week")
    x = demand(spark, sf_dir).withColumn("a", F.coalesce(F.col("v") > 1.2 * F.lag("v").over(w), F.lit(False))).withColumn("s", F.coalesce(F.col("v") > F.avg("v").over(w.rowsBetween(-12, -1)) * 1.3, F.lit(False)))
    return op.greedy_match(x, ["nation"], "week", "a", "s")


@query(
    "q_vintage_coverage",
    f"""WITH {OBS}, p AS (SELECT day, day + 3 AS target FROM obs GROUP BY day), rr AS (SELECT day + CAST(CASE WHEN event_id % 11 < 3 THEN event_id % 9 ELSE 400 END AS INTEGER) AS target, min(greatest(CAST(available AS DATE), day)) AS first FROM obs WHERE available IS NOT NULL GROUP BY 1)
        SELECT CAST(p.day AS VARCHAR) AS day, CAST(p.target AS VARCHAR) AS target, coalesce(first <= p.day, false) AS covered FROM p LEFT JOIN rr USING (target)""",
)
def vintage_coverage(spark, sf_dir):
    o = obs(spark, sf_dir)
    # most runs are about days far off, so that days have gaps
    runs = o.select(F.date_add("day", F.when(F.col("event_id") % 11 < 3, F.col("event_id") % 9).otherwise(400).cast("int")).alias("about"), F.to_date("available").alias("known"), F.col("day").alias("run"))
    out = op.vintage_coverage(o.select("day", F.date_add("day", 3).alias("target")), runs, "day", "target", "about", "known", "run")
    return out.select(F.col("day").cast("string").alias("day"), F.col("target").cast("string").alias("target"), "covered")


@query(
    "q_forecast_vintages",
    f"""WITH {WEEKLY}, f AS (SELECT week AS run, flag, h, week + 7 * CAST(h AS INTEGER) AS target, v * (1 + 0.01 * h) AS v FROM weekly, (SELECT unnest([1, 2, 3]) AS h) WHERE NOT (h = 3 AND day(week) < 8)), g AS (SELECT run, count(*) AS points FROM f GROUP BY run), k AS (SELECT run, row_number() OVER (ORDER BY run DESC) AS n FROM g WHERE points >= 5 OR (SELECT max(points) FROM g) < 5)
        SELECT CAST(f.run AS VARCHAR) AS run, flag, CAST(target AS VARCHAR) AS target, round(v, 4) AS v FROM f JOIN k ON f.run = k.run WHERE n <= 5""",
)
def forecast_vintages(spark, sf_dir):
    f = weekly(spark, sf_dir).select(F.col("week").alias("run"), "flag", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("h"), "v").where(~((F.col("h") == 3) & (F.dayofmonth("run") < 8)))
    f = f.select("run", "flag", F.date_add("run", F.col("h") * 7).alias("target"), (F.col("v") * (1 + 0.01 * F.col("h"))).alias("v"))
    return visibility.latest_runs(f, "run", 5, 5).select(F.col("run").cast("string").alias("run"), "flag", F.col("target").cast("string").alias("target"), r(F.col("v"), 4).alias("v"))


@query(
    "q_outcome_records",
    """WITH e AS (SELECT l_returnflag AS product, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, name, value, l_shipdate AS sent, l_orderkey, l_linenumber FROM (SELECT *, unnest(['units', 'price', 'rebate', 'levy']) AS name, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)),
            x AS (SELECT *, concat_ws(',', CASE WHEN NOT name IN ('units', 'price', 'rebate') THEN 'unsupported_metric' END, CASE WHEN NOT value > 0 THEN 'value_not_positive' END) AS issues FROM e),
            k AS (SELECT *, row_number() OVER (PARTITION BY product, week, name ORDER BY sent DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM x WHERE issues = '')
       SELECT product, CAST(week AS VARCHAR) AS week, max(value) FILTER (name = 'units' AND n = 1) AS units, max(value) FILTER (name = 'price' AND n = 1) AS price, max(value) FILTER (name = 'rebate' AND n = 1) AS rebate FROM k GROUP BY ALL""",
)
def outcome_records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("rebate"), F.col("l_tax").alias("levy"))
    e = li.unpivot(["l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber"], ["units", "price", "rebate", "levy"], "name", "value")
    e = sources.issues(e, {"unsupported_metric": F.col("name").isin("units", "price", "rebate"), "value_not_positive": F.col("value") > 0}).where(F.size("issues") == 0)
    e = e.select(F.col("l_returnflag").alias("product"), F.date_trunc("week", "l_shipdate").cast("date").alias("week"), "name", "value", "l_shipdate", "l_orderkey", "l_linenumber")
    return sources.wide_records(e, ["product", "week"], "name", "value", ["l_shipdate", "l_orderkey", "l_linenumber"], ["units", "price", "rebate"]).withColumn("week", F.col("week").cast("string"))


@query(
    "q_snapshot_once",
    "WITH n AS (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS source, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'purchase'), h AS (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') SELECT k, source, CAST(day AS VARCHAR) AS day FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = n.k AND h.day = n.day)",
)
def snapshot_once(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("source"), F.to_date("ts").alias("day"))
    new, held = e.where("source <> 'purchase'").distinct(), e.where("source = 'purchase'")
    return sources.not_held(new, held, ["k", "day"]).withColumn("day", F.col("day").cast("string"))


@query("q_sniffed_panel", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS month, round(sum(o_totalprice), 2) AS sales FROM orders GROUP BY 1")
def sniffed_panel(spark, sf_dir):
    o = sources.pick_columns(table(spark, sf_dir, "orders"), {"day": ["week_start", "datum", "o_orderdate"], "sales": ["revenue", "umsatz", "o_totalprice"]})
    return o.groupBy(F.date_trunc("month", "day").cast("date").cast("string").alias("month")).agg(r(F.sum("sales"), 2).alias("sales"))


@query("q_stable_hash", "SELECT c_custkey, left(sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey || '}'), 16) AS hash FROM customer")
def stable_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", op.stable_hash(["c_nationkey", "c_custkey", "c_mktsegment"]).alias("hash"))


@query(
    "q_phase_transform",
    "WITH c AS (SELECT l_returnflag AS flag, l_linenumber AS age, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT flag, age, n / CAST(sum(n) OVER (PARTITION BY flag) AS DOUBLE) AS w FROM c) SELECT flag, round(ln(sum(exp(ln(w) - age * 0.1 + 0.5 * age * (age - 1) * 0.02))), 6) + 0.0 AS log_phase FROM k GROUP BY flag",
)
def phase_transform(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("age")).agg(F.count("*").alias("n"))
    k = k.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("flag")))
    return op.phase_transform(k, ["flag"], "age", "w", 0.1, 0.02).select("flag", r(F.col("log_phase")).alias("log_phase"))


_FLOWS = "flows AS (SELECT c_nationkey % 5 AS a, CAST(o_custkey % 5 AS INTEGER) AS b, CAST(count(*) AS DOUBLE) AS w FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> o_custkey % 5 GROUP BY ALL)"


def flows(spark, sf_dir):
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy((F.col("c_nationkey") % 5).alias("a"), (F.col("o_custkey") % 5).cast("int").alias("b")).agg(F.count("*").cast("double").alias("w")).where("a <> b")


@query("q_laplacian", f"WITH {_FLOWS}, s AS (SELECT a AS i, b AS j, w / 2 AS w FROM flows UNION ALL SELECT b, a, w / 2 FROM flows), c AS (SELECT i, j, -sum(w) AS w FROM s GROUP BY ALL UNION ALL SELECT i, i, sum(w) FROM s GROUP BY i) SELECT i, j, round(sum(w), 4) + 0.0 AS value FROM c GROUP BY ALL")
def laplacian(spark, sf_dir):
    return op.laplacian(flows(spark, sf_dir), "a", "b", "w").select("i", "j", r(F.col("value"), 4).alias("value"))


@query("q_mapped_regions", f"WITH {_FLOWS}, v AS (SELECT c_nationkey % 5 AS b, avg(c_acctbal) AS x FROM customer GROUP BY 1) SELECT a, round(sum(w * x) / sum(w), 4) + 0.0 AS mapped FROM flows JOIN v USING (b) GROUP BY a")
def mapped_regions(spark, sf_dir):
    v = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("b")).agg(F.avg("c_acctbal").alias("x"))
    return op.map_rows(v, flows(spark, sf_dir), "a", "b", "w", "x").select("a", r(F.col("mapped"), 4).alias("mapped"))


@query(
    "q_dirichlet_counts",
    "WITH c AS (SELECT l_orderkey % 50 AS k, l_returnflag AS flag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), g AS (SELECT flag, sum(n) / sum(sum(n)) OVER () AS pi FROM c GROUP BY flag), x AS (SELECT k, n, 30 * pi AS al FROM c JOIN g USING (flag)) SELECT k, round(lgamma(sum(n) + 1) - sum(lgamma(n + 1)) + lgamma(30.0) - lgamma(sum(n) + 30) + sum(lgamma(n + al) - lgamma(al)), 5) + 0.0 AS log_p FROM x GROUP BY k",
)
def dirichlet_counts(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("k"), F.col("l_returnflag").alias("flag")).agg(F.count("*").cast("double").alias("n"))
    share = c.groupBy("flag").agg(F.sum("n").alias("s")).withColumn("pi", F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(0))))
    return score_op.dirichlet_counts(c.join(share, "flag"), ["k"], "n", "pi", 30.0).select("k", r(F.col("log_p"), 5).alias("log_p"))


_LEVELS = (0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975)


@query(
    "q_persistence_quantiles",
    f"WITH {DEMAND}, d AS (SELECT nation, week, v, v - lag(v) OVER (PARTITION BY nation ORDER BY week) AS s FROM demand), m AS (SELECT nation, max_by(v, week) AS last FROM d GROUP BY nation), q AS (SELECT nation, " + ", ".join(f"quantile_cont(s, {p}) AS s{i}" for i, p in enumerate(_LEVELS)) + " FROM d WHERE s IS NOT NULL GROUP BY nation) SELECT nation, " + ", ".join(f"round(greatest(last + s{i}, 0), 3) AS q{i}" for i in range(7)) + " FROM m JOIN q USING (nation)",
)
def persistence_quantiles(spark, sf_dir):
    out = score_op.persistence_quantiles(demand(spark, sf_dir), ["nation"], "week", "v", _LEVELS)
    return out.select("nation", *(r(F.col("quantiles")[i], 3).alias(f"q{i}") for i in range(7)))


@query(
    "q_seasonal_quantiles",
    f"WITH {DEMAND} SELECT nation, least(week(week), 52) AS season, count(*) AS n, " + ", ".join(f"round(quantile_cont(v, {p}), 3) AS q{i}" for i, p in enumerate(_LEVELS)) + " FROM demand GROUP BY ALL",
)
def seasonal_quantiles(spark, sf_dir):
    d = demand(spark, sf_dir).withColumn("season", F.least(F.weekofyear("week"), F.lit(52)).cast("long"))
    out = d.groupBy("nation", "season").agg(F.count("*").alias("n"), F.percentile("v", F.array(*[F.lit(p) for p in _LEVELS])).alias("q"))
    return out.select("nation", "season", "n", *(r(F.col("q")[i], 3).alias(f"q{i}") for i in range(7)))

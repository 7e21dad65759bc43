"""Regional panels: aggregates, hierarchies, labels, folds and nowcasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r, ratio
from ..operators import regional, splits, visibility
from ..registry import query
from .inputs import CUTOFF, DAILY, DEMAND, OBS, WEEKLY, daily, demand, obs, table, weekly


def week_text():
    return F.col("week").cast("string").alias("week")

_VIS = f"vis AS (SELECT * FROM obs WHERE available <= TIMESTAMP '{CUTOFF}' OR (available IS NULL AND ts <= TIMESTAMP '{CUTOFF}'))"


@query(
    "q_signal_panel",
    f"""WITH {OBS}, {_VIS}, d AS (SELECT region, source, day, avg(value) AS v, stddev_pop(value) AS s, count(*) AS n FROM vis GROUP BY ALL),
        p AS (SELECT region, source, max_by(v, day) AS level, max_by(v, day) FILTER (day <= DATE '{CUTOFF}' - 7) AS lag_7, CASE WHEN count(*) FILTER (day > DATE '{CUTOFF}' - 7) > 1 THEN regr_slope(v, date_diff('day', DATE '2024-01-01', day)) FILTER (day > DATE '{CUTOFF}' - 7) END AS slope, sum(n) AS n FROM d GROUP BY ALL)
        SELECT region, source, CAST(n AS BIGINT) AS n, round(level, 6) AS level, round(lag_7, 6) AS lag_7, round((level - lag_7) / greatest(abs(lag_7), 1.0), 6) + 0.0 AS growth, round(slope, 8) + 0.0 AS slope, row_number() OVER (PARTITION BY source ORDER BY level DESC, region) AS rank FROM p""",
)
def signal_panel(spark, sf_dir):
    """Latest visible signals per region and source: as-of level, week-old level, growth, slope and rank."""
    cut = F.lit(CUTOFF).cast("date")
    seen = visibility.visible(obs(spark, sf_dir), F.lit(CUTOFF).cast("timestamp"), "ts", "available")
    d = seen.groupBy("region", "source", "day").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    late = F.col("day") > F.date_sub(cut, 7)
    x = F.when(late, F.datediff("day", F.lit("2024-01-01")))
    old = F.col("day") <= F.date_sub(cut, 7)
    p = d.groupBy("region", "source").agg(
        F.max_by("v", "day").alias("level"), F.max_by(F.when(old, F.col("v")), F.when(old, F.col("day"))).alias("lag_7"), F.sum("n").alias("n"),
        F.when(F.count(x) > 1, F.regr_slope(F.when(late, F.col("v")), x)).alias("slope"),
    )
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("level"), "region")).cast("long")
    growth = (F.col("level") - F.col("lag_7")) / F.greatest(F.abs("lag_7"), F.lit(1.0))
    return p.select("region", "source", "n", r(F.col("level")).alias("level"), r(F.col("lag_7")).alias("lag_7"), r(growth).alias("growth"), r(F.col("slope"), 8).alias("slope"), rank.alias("rank"))


@query("q_site_daily", "SELECT l_returnflag AS site, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, count(*) AS n, round(avg(CAST(l_linestatus = 'F' AS INTEGER)), 6) AS share_f, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY ALL")
def site_daily(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").cast("string").alias("day")).agg(
        F.max("l_quantity").alias("most"), r(F.avg("l_quantity")).alias("mean"), F.count("*").alias("n"), r(F.avg((F.col("l_linestatus") == "F").cast("int"))).alias("share_f"), r(F.stddev_pop("l_quantity")).alias("std")
    )


@query(
    "q_incidence_per_100k",
    """WITH pop AS (SELECT c_nationkey AS nation, count(*) AS pop FROM customer GROUP BY 1), n AS (SELECT c_nationkey AS nation, year(o_orderdate) AS year, count(*) AS cases FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
       SELECT n.nation, n.year, n.cases, round(n.cases * 100000.0 / pop.pop, 4) AS incidence FROM n JOIN pop ON n.nation = pop.nation""",
)
def incidence(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    people = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("pop"))
    cases = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("cases"))
    return cases.join(people, "nation").select("nation", "year", "cases", r(F.col("cases") * 100000.0 / F.col("pop"), 4).alias("incidence"))


@query(
    "q_rollup_levels",
    """SELECT n_regionkey AS region, n_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total, CAST(grouping(n_regionkey) + grouping(n_nationkey) AS BIGINT) AS level
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey, n_nationkey), (n_regionkey), ())""",
)
def rollup_levels(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    held = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), "c_acctbal")
    out = regional.roll_up(held, ["region", "nation"], [], [F.count("*").alias("n"), r(F.sum("c_acctbal"), 2).alias("total")])
    return out.withColumn("level", F.col("level").cast("long"))


@query(
    "q_weighted_moments",
    f"""WITH {DEMAND}, p AS (SELECT c_nationkey AS nation, count(*) AS pop FROM customer GROUP BY 1)
        SELECT CAST(week AS VARCHAR) AS week, round(sum(v * pop) / sum(pop), 3) AS mean, round(sqrt(greatest(sum(v * v * pop) / sum(pop) - (sum(v * pop) / sum(pop)) ** 2, 0)), 2) AS std FROM demand JOIN p USING (nation) GROUP BY week""",
)
def weighted_moments(spark, sf_dir):
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("pop"))
    held = demand(spark, sf_dir).join(people, "nation")
    return held.groupBy(week_text()).agg(r(regional.weighted_mean(F.col("v"), F.col("pop")), 3).alias("mean"), r(regional.weighted_std(F.col("v"), F.col("pop")), 2).alias("std"))


@query(
    "q_weekly_zscore",
    f"WITH {WEEKLY}, m AS (SELECT week, avg(v) AS v FROM weekly GROUP BY week) SELECT CAST(week AS VARCHAR) AS week, round((v - avg(v) OVER ()) / coalesce(nullif(stddev_pop(v) OVER (), 0), 1), 6) + 0.0 AS z FROM m",
)
def zscore(spark, sf_dir):
    m = weekly(spark, sf_dir).groupBy("week").agg(F.avg("v").alias("v"))
    all_ = m.agg(F.avg("v").alias("a"), F.coalesce(F.nullif(F.stddev_pop("v"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return m.join(F.broadcast(all_)).select(week_text(), r((F.col("v") - F.col("a")) / F.col("s")).alias("z"))


@query(
    "q_order_velocity",
    "WITH w AS (SELECT isoyear(o_orderdate) AS year, weekofyear(o_orderdate) AS week, sum(o_totalprice) AS v FROM orders GROUP BY ALL), l AS (SELECT *, lag(v) OVER (ORDER BY year, week) AS b FROM w) SELECT year, week, round((v - b) / b, 6) + 0.0 AS velocity, CASE WHEN (v - b) / b >= 0.5 THEN 'surge' WHEN (v - b) / b >= 0.2 THEN 'rise' WHEN (v - b) / b <= -0.2 THEN 'fall' ELSE 'steady' END AS band FROM l",
)
def velocity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = o.groupBy(F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("long").alias("year"), F.weekofyear("o_orderdate").cast("long").alias("week")).agg(F.sum("o_totalprice").alias("v"))
    b = F.lag("v").over(Window.partitionBy(F.lit(0)).orderBy("year", "week"))
    g = w.withColumn("g", ratio(F.col("v") - b, b))
    return g.select("year", "week", r(F.col("g")).alias("velocity"), F.when(F.col("g") >= 0.5, "surge").when(F.col("g") >= 0.2, "rise").when(F.col("g") <= -0.2, "fall").otherwise("steady").alias("band"))


@query(
    "q_momentum_alerts",
    f"""WITH {DEMAND}, m AS (SELECT max(week) AS w FROM demand), a AS (SELECT nation, avg(v) FILTER (week > m.w - 21) AS late, avg(v) FILTER (week <= m.w - 21 AND week > m.w - 42) AS early FROM demand, m GROUP BY nation)
        SELECT nation, round(late, 3) AS late, round(early, 3) AS early, round((late - early) / early, 6) + 0.0 AS momentum, CASE WHEN (late - early) / early >= 0.3 THEN 'high' WHEN (late - early) / early >= 0.1 THEN 'medium' ELSE 'low' END AS severity FROM a""",
)
def momentum(spark, sf_dir):
    d = demand(spark, sf_dir)
    last = F.broadcast(d.agg(F.max("week").alias("w")))
    late, early = F.col("week") > F.date_sub("w", 21), (F.col("week") <= F.date_sub("w", 21)) & (F.col("week") > F.date_sub("w", 42))
    a = d.join(last).groupBy("nation").agg(F.avg(F.when(late, F.col("v"))).alias("late"), F.avg(F.when(early, F.col("v"))).alias("early")).withColumn("m", ratio(F.col("late") - F.col("early"), F.col("early")))
    return a.select("nation", r(F.col("late"), 3).alias("late"), r(F.col("early"), 3).alias("early"), r(F.col("m")).alias("momentum"), F.when(F.col("m") >= 0.3, "high").when(F.col("m") >= 0.1, "medium").otherwise("low").alias("severity"))


@query(
    "q_history_rank",
    f"WITH {WEEKLY}, x AS (SELECT a.flag, a.week, count(*) FILTER (b.v <= a.v) AS k, count(b.v) AS n FROM weekly a JOIN weekly b ON a.flag = b.flag AND weekofyear(a.week) = weekofyear(b.week) AND b.week < a.week GROUP BY ALL) SELECT flag, CAST(week AS VARCHAR) AS week, round(k / n, 6) AS rank FROM x WHERE n >= 3",
)
def history_rank(spark, sf_dir):
    w = weekly(spark, sf_dir).withColumn("woy", F.weekofyear("week"))
    old = w.select("flag", "woy", F.col("week").alias("then"), F.col("v").alias("old"))
    x = w.join(old, ["flag", "woy"]).where("then < week").groupBy("flag", "week").agg(F.sum((F.col("old") <= F.col("v")).cast("long")).alias("k"), F.count("*").alias("n"))
    return x.where("n >= 3").select("flag", week_text(), r(F.col("k") / F.col("n")).alias("rank"))


@query("q_rest_gap", f"WITH {DEMAND}, x AS (SELECT *, (sum(v) OVER (PARTITION BY week) - v) / nullif(count(*) OVER (PARTITION BY week) - 1, 0) AS rest FROM demand) SELECT nation, CAST(week AS VARCHAR) AS week, round(v - rest, 6) + 0.0 AS rest_gap, round(v / rest, 5) AS rest_ratio FROM x")
def rest_gap(spark, sf_dir):
    return regional.rest_gap(demand(spark, sf_dir), ["week"], "v").select("nation", week_text(), r(F.col("rest_gap")).alias("rest_gap"), r(F.col("rest_ratio"), 5).alias("rest_ratio"))


@query("q_pct_rank_ties", f"WITH {DEMAND}, x AS (SELECT nation, week, n, rank() OVER w + (count(*) OVER (PARTITION BY week, n) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY week) AS m FROM demand WINDOW w AS (PARTITION BY week ORDER BY n)) SELECT nation, CAST(week AS VARCHAR) AS week, round(k / m, 6) AS pct_rank FROM x")
def pct_rank(spark, sf_dir):
    return regional.percent_rank_mean(demand(spark, sf_dir), ["week"], "n").select("nation", week_text(), r(F.col("pct_rank")).alias("pct_rank"))


@query(
    "q_neighbour_pressure",
    f"""WITH {DEMAND}, e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1.0 AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 24) % 25, 0.5 FROM nation),
        m AS (SELECT e.dst AS nation, d.week, sum(d.v * e.w) / sum(e.w) AS nb FROM demand d JOIN e ON d.nation = e.src GROUP BY ALL)
        SELECT d.nation, CAST(d.week AS VARCHAR) AS week, round(nb, 3) AS neighbour_mean, round(ln((nb + 1) / (v + 1)), 6) + 0.0 AS pressure FROM demand d LEFT JOIN m ON d.nation = m.nation AND d.week = m.week""",
)
def pressure(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    edges = n.select("src", ((F.col("src") + 1) % 25).alias("dst"), F.lit(1.0).alias("weight")).unionByName(n.select("src", ((F.col("src") + 24) % 25).alias("dst"), F.lit(0.5).alias("weight")))
    out = regional.neighbour_mean(demand(spark, sf_dir), edges, "nation", ["week"], "v")
    return out.select("nation", week_text(), r(F.col("neighbour_mean"), 3).alias("neighbour_mean"), r(F.col("pressure")).alias("pressure"))


@query(
    "q_reconcile",
    f"""WITH {DEMAND}, y AS (SELECT n_regionkey AS region, nation, avg(v) AS v, var_pop(v) + 1 AS s FROM demand JOIN nation ON nation = n_nationkey GROUP BY ALL),
        t AS (SELECT region, sum(v) * 1.05 AS v, sum(s) * 0.5 AS s FROM y GROUP BY 1), g AS (SELECT t.region, (t.v - sum(y.v)) / (sum(y.s) + t.s) AS g, t.v, t.s FROM y JOIN t USING (region) GROUP BY t.region, t.v, t.s)
        SELECT 'n' || y.nation AS node, round(y.v + y.s * g.g, 2) AS reconciled FROM y JOIN g USING (region) UNION ALL SELECT 'r' || region, round(v - s * g, 2) FROM g""",
)
def reconcile(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    leaves = demand(spark, sf_dir).join(n, F.col("nation") == F.col("n_nationkey")).groupBy("n_regionkey", "nation").agg(F.avg("v").alias("v"), (F.var_pop("v") + 1).alias("s"))
    tops = leaves.groupBy("n_regionkey").agg((F.sum("v") * 1.05).alias("v"), (F.sum("s") * 0.5).alias("s"))
    low = leaves.select(F.lit(1).alias("g"), F.concat(F.lit("n"), "nation").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), "v", "s")
    high = tops.select(F.lit(1).alias("g"), F.concat(F.lit("r"), "n_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), "v", "s")
    return regional.reconcile(low.unionByName(high), ["g"], "node", "parent", "v", "s").select("node", r(F.col("reconciled"), 2).alias("reconciled"))


@query(
    "q_event_label",
    f"""WITH {WEEKLY}, x AS (SELECT flag, week, v, lead(v) OVER o AS t, quantile_cont(v, 0.5) OVER h AS b FROM weekly WINDOW o AS (PARTITION BY flag ORDER BY week), h AS (PARTITION BY flag ORDER BY week ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
        SELECT flag, CAST(week AS VARCHAR) AS week, CASE WHEN t IS NOT NULL THEN CAST(ln(1 + t) - ln(1 + v) >= 0.1 AND t >= greatest(10.0, b + 1.0 * 5) AS INTEGER) END AS label FROM x WHERE b IS NOT NULL""",
)
def event_label(spark, sf_dir):
    w = Window.partitionBy("flag").orderBy("week")
    x = weekly(spark, sf_dir).withColumn("t", F.lead("v").over(w)).withColumn("b", F.percentile("v", F.lit(0.5)).over(w.rowsBetween(-12, -1))).where("b IS NOT NULL")
    return x.select("flag", week_text(), splits.event_label(F.col("v"), F.col("t"), F.col("b"), F.lit(5.0), 0.1, 1.0, 10.0).alias("label"))


_FOLDS = f"{WEEKLY}, d AS (SELECT week, row_number() OVER (ORDER BY week) AS n FROM (SELECT DISTINCT week FROM weekly)), s AS (SELECT CAST((n - 105) / 26 AS BIGINT) AS fold, n AS s FROM d WHERE n > 104 AND (n - 105) % 26 = 0 AND (n - 105) / 26 < 5), f AS (SELECT fold, max(week) FILTER (n < s) AS a, min(week) FILTER (n >= s) AS b, max(week) FILTER (n >= s) AS c FROM s JOIN d ON n >= s - 1 AND n < s + 26 GROUP BY fold)"


@query("q_walk_forward_folds", f"WITH {_FOLDS} SELECT fold, CAST(a AS VARCHAR) AS train_end, CAST(b AS VARCHAR) AS test_start, CAST(c AS VARCHAR) AS test_end FROM f")
def walk_forward(spark, sf_dir):
    return splits.folds(weekly(spark, sf_dir), "week", 104, 26, 5).select("fold", *(F.col(c).cast("string").alias(c) for c in ("train_end", "test_start", "test_end")))


@query("q_fold_roles", f"WITH {_FOLDS} SELECT fold, flag, CASE WHEN week BETWEEN b AND c THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(v), 4) AS mean FROM weekly JOIN f ON week <= a OR week BETWEEN b AND c GROUP BY ALL")
def fold_roles(spark, sf_dir):
    w = weekly(spark, sf_dir)
    return splits.assign_folds(w, "week", splits.folds(w, "week", 104, 26, 5)).groupBy("fold", "flag", "role").agg(F.count("*").alias("n"), r(F.avg("v"), 4).alias("mean"))


@query("q_completeness_by_age", "SELECT o_orderpriority AS source, count(*) AS n, " + ", ".join(f"round(avg(CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) <= {a} AS INTEGER)), 6) AS within_{a}" for a in (7, 30, 60)) + " FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def completeness(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    held = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_orderpriority").alias("source"), "o_orderdate", "l_shipdate")
    out = splits.completeness_by_age(held, ["source"], "o_orderdate", "l_shipdate", [7, 30, 60])
    return out.select("source", "n", *(r(F.col(f"within_{a}")).alias(f"within_{a}") for a in (7, 30, 60)))


@query("q_nowcast", f"WITH {DAILY} SELECT region, source, CAST(day AS VARCHAR) AS day, round(n / CASE WHEN DATE '2024-01-30' - day <= 1 THEN 0.4 WHEN DATE '2024-01-30' - day <= 3 THEN 0.7 WHEN DATE '2024-01-30' - day <= 7 THEN 0.9 ELSE 1.0 END, 6) AS adjusted FROM daily")
def nowcast(spark, sf_dir):
    age = F.datediff(F.lit("2024-01-30"), "day")
    return daily(spark, sf_dir).select("region", "source", F.col("day").cast("string").alias("day"), r(splits.nowcast(F.col("n"), age, [(1, 0.4), (3, 0.7), (7, 0.9)])).alias("adjusted"))


@query("q_pivot_sources", f"WITH {DAILY} SELECT region, CAST(day AS VARCHAR) AS day, round(max(v) FILTER (source = 'click'), 6) AS click, round(max(v) FILTER (source = 'purchase'), 6) AS purchase FROM daily GROUP BY ALL")
def pivot_sources(spark, sf_dir):
    out = daily(spark, sf_dir).groupBy("region", F.col("day").cast("string").alias("day")).pivot("source", ["click", "purchase"]).agg(r(F.max("v")))
    return out


@query("q_issue_calendar", f"WITH {WEEKLY}, m AS (SELECT CAST(min(week) AS TIMESTAMP) AS a, CAST(max(week) AS TIMESTAMP) AS b FROM weekly), c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 7 DAYS)) AS DATE) AS week, CAST(b AS DATE) AS b FROM m) SELECT CAST(week AS VARCHAR) AS week, CAST(least(week + 6, b) AS VARCHAR) AS cutoff, CAST(CAST(date_trunc('week', least(week + 6, b) + 7) AS DATE) AS VARCHAR) AS target FROM c")
def issue_calendar(spark, sf_dir):
    span = weekly(spark, sf_dir).agg(F.min("week").alias("a"), F.max("week").alias("b"))
    c = span.select("b", F.explode(F.sequence("a", "b", F.make_interval(days=F.lit(7)))).alias("week")).withColumn("cutoff", F.least(F.date_add("week", 6), F.col("b")))
    return c.select(week_text(), F.col("cutoff").cast("string").alias("cutoff"), F.date_trunc("week", F.date_add("cutoff", 7)).cast("date").cast("string").alias("target"))



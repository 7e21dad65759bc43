"""Walk-forward queries: boosted quantiles, nested event forecasts, and a training set per row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r
from ..operators import aligned, boosting, forecasting, joint, learning, metrics, nested, ranking, rowwise, splits
from ..registry import query
from .inputs import DEMAND, demand, table
from .learning import LAGS, lagged

LEVELS = (0.1, 0.5, 0.9)


@query("q_quantile_boosting")
def quantile_boosting(spark, sf_dir):
    """Per fold the pinball loss of boosted and of linear quantiles of next week's demand, and what lies inside 80 per cent."""
    w = Window.partitionBy("nation").orderBy("week")
    log, names = F.log1p("v"), ["now", "before", "mean", "season"]
    x = demand(spark, sf_dir).withColumns({"now": log, "before": F.lag(log, 1).over(w), "mean": F.avg(log).over(w.rowsBetween(-8, -1)), "season": F.weekofyear("week").cast("double"), "next": F.lead(log).over(w)}).where("before IS NOT NULL AND next IS NOT NULL")
    folds = splits.folds(x, "week", 104, 104, 2)
    both = splits.assign_folds(x, "week", folds)
    train = both.where("role = 'train'")
    edges = boosting.bin_edges(train.where("fold = 0"), names, 32)
    forest = boosting.quantile_boosting(train, names, "next", LEVELS, by="fold", trees=12, depth=3, rate=0.3, edges=edges)
    out = boosting.boosted_quantiles(both.where("role = 'test'").drop("role"), forest, LEVELS, "fold")
    lines = forecasting.quantile_walk_forward(x, "week", names, "next", LEVELS, 104, 104, 2)

    def losses(df, prefix):
        q, y = F.col("quantiles"), F.col("next")
        inside = F.avg(y.between(q[0], q[2]).cast("double")).alias(f"{prefix}_inside")
        return df.groupBy("fold").agg(F.count("*").alias(f"{prefix}_n"), *[r(F.avg(metrics.pinball(y, q[k], p)), 3).alias(f"{prefix}_{round(100 * p)}") for k, p in enumerate(LEVELS)], r(inside, 3).alias(f"{prefix}_inside"))

    return losses(out, "boosted").join(losses(lines, "linear"), "fold").drop("linear_n")


@query("q_nested_walk_forward")
def nested_walk_forward(spark, sf_dir):
    """Per fold, and over all: how calibrated probabilities of a rise fare on dates after all that they learned from."""
    x = lagged(spark, sf_dir).drop("test")
    folds = nested.panel_folds(x, "week", 3, 156, 26)
    oof = nested.nested_walk_forward(x, "week", ["v", *LAGS], "label", ["nation"], folds, trees=8, depth=2, rate=0.3, half_life=400)
    out = nested.fold_report(oof, "label")
    return out.select("fold", "n", "events", *(r(F.col(c), 3).alias(c) for c in ("brier", "ece", "auc", "ap", "precision", "recall", "false_alarm_rate")))


@query(
    "q_rowwise_walk_forward",
    f"""WITH {DEMAND}, x AS (SELECT nation, week, v / 1000 AS y, lag(v) OVER w / 1000 AS a, avg(v) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING) / 1000 AS b, week + CAST(7 + 7 * (nation % 3) AS INTEGER) AS known FROM demand WINDOW w AS (PARTITION BY nation ORDER BY week)),
        t AS (SELECT i.nation, i.week, i.y, i.a, i.b, count(j.y) AS n, coalesce(avg(j.y), 0) AS my, avg(j.a) AS ma, avg(j.b) AS mb, max(j.y) AS top, var_pop(j.a) AS vaa, var_pop(j.b) AS vbb, covar_pop(j.a, j.b) AS vab, covar_pop(j.a, j.y) AS vay, covar_pop(j.b, j.y) AS vby, var_pop(j.y) AS vyy
            FROM x i LEFT JOIN x j ON j.nation = i.nation AND j.known <= i.week - 14 AND j.a IS NOT NULL AND j.b IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, CASE WHEN vaa > 0 THEN sqrt(vaa) ELSE 1 END AS sa, CASE WHEN vbb > 0 THEN sqrt(vbb) ELSE 1 END AS sb FROM t),
        m AS (SELECT *, n * vaa / (sa * sa) + 1 AS p, n * vbb / (sb * sb) + 1 AS q, n * vab / (sa * sb) AS o, n * vay / sa AS u, n * vby / sb AS w FROM s WHERE n >= 10 AND a IS NOT NULL AND b IS NOT NULL),
        c AS (SELECT *, (q * u - o * w) / (p * q - o * o) AS ca, (p * w - o * u) / (p * q - o * o) AS cb FROM m),
        f AS (SELECT *, least(greatest(my + ca * (a - ma) / sa + cb * (b - mb) / sb, 0), 2.5 * top) AS forecast, sqrt(greatest(n * vyy - 2 * (ca * u + cb * w) + ca * ca * (p - 1) + cb * cb * (q - 1) + 2 * ca * cb * o, 0) / n) AS sigma FROM c)
        SELECT t.nation, CAST(t.week AS VARCHAR) AS week, t.n AS n_train, round(f.forecast, 3) AS forecast, round(f.sigma, 3) AS sigma, CASE WHEN f.forecast IS NOT NULL THEN round(greatest(f.forecast - 1.28 * f.sigma, 0), 3) END AS low_80, round(f.forecast + 1.96 * f.sigma, 3) AS high_95 FROM t LEFT JOIN f ON f.nation = t.nation AND f.week = t.week""",
)
def rowwise_walk_forward(spark, sf_dir):
    """Each nation and week with a forecast from the weeks published a fortnight before."""
    w = Window.partitionBy("nation").orderBy("week")
    x = demand(spark, sf_dir).select("nation", "week", (F.col("v") / 1000).alias("y"), (F.lag("v").over(w) / 1000).alias("a"), (F.avg("v").over(w.rowsBetween(-8, -2)) / 1000).alias("b"), F.date_add("week", (7 + 7 * (F.col("nation") % 3)).cast("int")).alias("known"))
    out = rowwise.rowwise_walk_forward(x, ["nation"], "week", "known", ["a", "b"], "y", 14, least=10)
    return out.select("nation", F.col("week").cast("string").alias("week"), "n_train", *(r(F.col(c), 3).alias(c) for c in ("forecast", "sigma", "low_80", "high_95")))


@query("q_joint_fit")
def joint_fit(spark, sf_dir):
    """The log demand of every nation and week as two sources tell it, order values and what is shipped nine weeks later, with
    neighbours and weeks held together. Growth is of the fitted state."""
    weeks = demand(spark, sf_dir).select(F.col("nation").alias("node"), F.floor(F.datediff("week", F.lit("1995-01-02")) / 7).cast("int").alias("t"), "v")
    o, c, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    shipped = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("node"), F.floor(F.datediff("l_shipdate", F.lit("1995-01-02")) / 7).cast("int").alias("t")).agg(F.sum("l_extendedprice").alias("v"))
    tell = lambda df, name, var: df.select("node", "t", F.lit(name).alias("source"), F.log1p("v").alias("z"), F.lit(var).alias("variance"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    edges = n.select("src", ((F.col("src") + 1) % 25).alias("dst"), F.lit(0.5).alias("weight"))
    days = (weeks.agg(F.max("t")).first()[0] or 0) + 1
    out, _ = joint.joint_fit(tell(weeks, "orders", 0.2).unionByName(tell(shipped, "shipped", 0.3)), edges, "node", "t", "source", "z", "variance", {"orders": 0, "shipped": 9}, 0, days, sweeps=5)
    return out.select("node", "t", *(r(F.col(c), 2).alias(c) for c in ("x", "q")))


@query("q_rank_boosting")
def rank_boosting(spark, sf_dir):
    """Nations ranked each week by next week's growth: NDCG of the first five for trees of ranking gradients, for trees that
    forecast the event, and for the last value, on weeks after those learned from."""
    x = lagged(spark, sf_dir).drop("test").withColumn("grade", F.when(F.col("next") > 1.5 * F.col("v"), 2).when(F.col("next") > 1.1 * F.col("v"), 1).otherwise(0)).withColumn("all", F.lit("all"))
    train, test, names = x.where("week < '2000-01-01'"), x.where("week >= '2000-01-01'"), ["v", *LAGS]
    edges = boosting.bin_edges(train, names, 32)
    more = dict(trees=8, depth=3, rate=0.3, edges=edges)
    ranker = boosting.fit(train, names, "grade", ranking.lambda_loss(["week"], "nation", 5), "all", ("week", "nation"), **more)
    events = boosting.fit(train, names, "label", boosting.log_loss(), "all", **more)
    out = boosting.score(boosting.score(test, ranker, "all", "ranking"), events, "all", "event").withColumn("last", -F.col("v"))
    each = [ranking.ndcg(out, ["week"], "nation", c, "grade", 5).select(F.lit(c).alias("by"), "groups", r(F.col("ndcg"), 3).alias("ndcg")) for c in ("ranking", "event", "last")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("q_aligned_clusters")
def aligned_clusters(spark, sf_dir):
    """Nations clustered quarter by quarter on their demand, under labels that stay, and how many change theirs."""
    quarter = F.date_trunc("quarter", "week").cast("date")
    x = demand(spark, sf_dir).groupBy(quarter.alias("quarter"), "nation").agg(F.avg("v").alias("m"), F.avg("n").alias("n"), F.count("*").cast("double").alias("weeks"))
    held = aligned.aligned(learning.clusters_by_date(x, "quarter", "nation", ["m", "n", "weeks"], 3), "quarter", "nation", "cluster", 3)
    out = aligned.reassignment(held, "quarter", "nation")
    return out.select(F.col("quarter").cast("string").alias("quarter"), "n", r(F.col("reassigned"), 4).alias("reassigned"))

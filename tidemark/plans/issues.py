"""Panels at every issue date, and forecasts from what each issue knew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import r, week_start
from ..operators import issues as op
from ..registry import query
from .inputs import table


def sales(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", (F.col("c_nationkey") % 5).alias("region"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 997).alias("price"))


def revisions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Daily value per region, published early from three orders of four and revised ten days after; weekly counts,
    from two orders of three after a week and from all after three. Orders are read once for each and summed; what reads revisions again
    and again reads the sums."""
    s = sales(spark, sf_dir)

    def told(df: DataFrame, by: str, early, lag, late: int, size: bool) -> DataFrame:
        sums = lambda c: [F.sum(F.when(c, F.col("price"))), F.sum(c.cast("long"))]
        both = df.groupBy("region", by).agg(*[x.alias(f"{n}{k}") for k, c in enumerate((early, F.lit(True))) for n, x in zip("vn", sums(c), strict=True)])
        each = F.array(*[F.struct((F.col(f"v{k}") if size else F.col(f"n{k}").cast("double")).alias("v"), F.col(f"n{k}").alias("n"), F.date_add(by, d).alias("published")) for k, d in ((0, lag), (1, F.lit(late)))])
        return scratch.cut(both.select("region", by, F.explode(each).alias("x")).select("region", by, "x.*").where("n > 0"))

    signal = told(s, "day", F.col("o_orderkey") % 4 != 0, (F.col("region") % 3 + 1).cast("int"), 10, True)
    weeks = s.withColumn("week", week_start(F.col("day")))
    return signal, told(weeks, "week", F.col("o_orderkey") % 3 != 0, F.lit(7), 21, False).drop("n")


def ring(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("src")).distinct()
    return n.select("src", ((F.col("src") + 1) % 5).alias("dst")).unionByName(n.select("src", ((F.col("src") + 4) % 5).alias("dst")))


REVISIONS = """sales AS (SELECT o_orderkey, c_nationkey % 5 AS region, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_totalprice / 997 AS price FROM orders JOIN customer ON o_custkey = c_custkey),
        sig AS (SELECT region, day, sum(price) AS v, count(*) AS n, day + CAST(region % 3 + 1 AS INTEGER) AS published FROM sales WHERE o_orderkey % 4 <> 0 GROUP BY ALL
                UNION ALL SELECT region, day, sum(price), count(*), day + 10 FROM sales GROUP BY ALL),
        tru AS (SELECT region, week, CAST(count(*) AS DOUBLE) AS v, week + 7 AS published FROM sales WHERE o_orderkey % 3 <> 0 GROUP BY ALL UNION ALL SELECT region, week, count(*), week + 21 FROM sales GROUP BY ALL),
        span AS (SELECT min(day) AS a, max(day) AS b FROM sig),
        iss AS (SELECT issue, least(issue + 6, b) AS cutoff, CAST(date_trunc('week', least(issue + 6, b) + 7) AS DATE) AS target FROM (SELECT CAST(unnest(generate_series(date_trunc('week', a), date_trunc('week', b), INTERVAL 7 DAYS)) AS DATE) AS issue, b FROM span))"""

_RATE = "({0} - {1}) / greatest(abs({1}), 1.0)".format
_DAY = lambda c, n: f"coalesce(max_by({c}, day) FILTER (day <= cutoff - {n}), 0)"

SHOWN = {
    "level": 4, "lag_4": 4, "lag_7": 4, "lag_14": 4, "slope_7": 6, "acceleration_7": 6, "mean_7": 4, "std_7": 4, "level_vs_28d": 4, "sources_ratio_7": 6, "coverage_28": 6, "neighbour_level": 4, "neighbour_slope_7": 6,
    "national_level": 4, "national_slope_7": 6, "national_acceleration_7": 6, "vs_neighbours": 4, "vs_national": 4, "share_of_national": 6, "momentum_2w": 6, "momentum_4w": 6, "baseline": 4, "mad": 4, "baseline_gap": 4, "baseline_z": 6,
}
AS_IS = ["region", "n_days", "sources", "missing_7", "missing_14", "age_days", "n_weeks", "current", "lag_1w", "lag_2w", "lag_4w", "lag_8w", "truth_age_days", "next", "target_week_iso"]

PANEL = f"""WITH {REVISIONS},
        vis AS (SELECT region, cutoff, day, max_by(v, published) AS v, max_by(n, published) AS n FROM sig JOIN iss ON day BETWEEN cutoff - 56 AND cutoff AND published <= cutoff GROUP BY ALL),
        f0 AS (SELECT region, cutoff, count(*) AS n_days, {_DAY("v", 0)} AS level, {_DAY("v", 4)} AS lag_4, {_DAY("v", 7)} AS lag_7, {_DAY("v", 14)} AS lag_14, coalesce(avg(v) FILTER (day >= cutoff - 7), 0) AS mean_7, coalesce(stddev_pop(v) FILTER (day >= cutoff - 7), 0) AS std_7,
                coalesce(quantile_cont(v, 0.5) FILTER (day >= cutoff - 28), 0) AS med, CAST({_DAY("n", 0)} AS DOUBLE) AS sources, {_DAY("n", 7)} AS sources_7, coalesce(quantile_cont(n, 0.5) FILTER (day >= cutoff - 28), 0) AS n_med,
                7 - count(*) FILTER (day > cutoff - 7) AS missing_7, 14 - count(*) FILTER (day > cutoff - 14) AS missing_14, max(cutoff) - max(day) AS age_days FROM vis GROUP BY ALL HAVING count(*) >= 4),
        f AS (SELECT *, {_RATE("level", "lag_7")} AS slope_7, {_RATE("level", "lag_7")} - {_RATE("lag_7", "lag_14")} AS acceleration_7, level - med AS level_vs_28d, sources / greatest(n_med, 1.0) AS coverage_28, {_RATE("sources", "sources_7")} AS sources_ratio_7 FROM f0),
        g AS (SELECT DISTINCT n_nationkey % 5 AS src FROM nation), e AS (SELECT src, (src + 1) % 5 AS dst FROM g UNION ALL SELECT src, (src + 4) % 5 FROM g),
        nb AS (SELECT dst AS region, cutoff, avg(level) AS neighbour_level, avg(slope_7) AS neighbour_slope_7 FROM e JOIN f ON f.region = e.src GROUP BY ALL),
        nat AS (SELECT cutoff, avg(level) AS national_level, avg(slope_7) AS national_slope_7, avg(acceleration_7) AS national_acceleration_7 FROM f GROUP BY ALL),
        tv AS (SELECT region, cutoff, week, max_by(v, published) AS v FROM tru JOIN iss ON week BETWEEN cutoff - 182 AND cutoff AND published <= cutoff GROUP BY ALL),
        t AS (SELECT region, cutoff, count(*) AS n_weeks, list(v ORDER BY week DESC) AS vs, max(cutoff) - max(week) AS truth_age_days FROM tv GROUP BY ALL HAVING count(*) >= 4),
        sv AS (SELECT region, cutoff, week, max_by(v, published) AS v FROM tru JOIN iss ON week < target AND week <= cutoff AND published <= cutoff AND least(abs(least(weekofyear(week), 52) - least(weekofyear(target), 52)), 52 - abs(least(weekofyear(week), 52) - least(weekofyear(target), 52))) <= 1 GROUP BY ALL),
        s AS (SELECT region, cutoff, list(v) AS seasonal FROM sv GROUP BY ALL),
        b AS (SELECT t.*, CASE WHEN len(seasonal) >= 5 THEN seasonal ELSE vs[1:12] END AS own FROM t LEFT JOIN s ON t.region = s.region AND t.cutoff = s.cutoff),
        c AS (SELECT *, list_aggregate(own, 'median') AS baseline FROM b),
        d AS (SELECT *, greatest(list_aggregate(list_transform(own, lambda x: abs(x - baseline)), 'median'), 1.0) AS mad, vs[1] AS current, coalesce(vs[2], 0) AS lag_1w, coalesce(vs[3], 0) AS lag_2w, coalesce(vs[5], 0) AS lag_4w, coalesce(vs[9], 0) AS lag_8w FROM c),
        last_ AS (SELECT region, week, max_by(v, published) AS next FROM tru GROUP BY ALL),
        p AS (SELECT f.*, issue, target, coalesce(neighbour_level, 0) AS neighbour_level, coalesce(neighbour_slope_7, 0) AS neighbour_slope_7, national_level, national_slope_7, national_acceleration_7, n_weeks, current, lag_1w, lag_2w, lag_4w, lag_8w, truth_age_days, baseline, mad, next,
                level - coalesce(neighbour_level, 0) AS vs_neighbours, level - national_level AS vs_national, level / greatest(abs(national_level), 1.0) AS share_of_national, {_RATE("lag_1w", "lag_2w")} AS momentum_2w, {_RATE("lag_1w", "lag_4w")} AS momentum_4w, current - baseline AS baseline_gap, (current - baseline) / mad AS baseline_z, CAST(weekofyear(target) AS INTEGER) AS target_week_iso
            FROM f JOIN d ON f.region = d.region AND f.cutoff = d.cutoff JOIN iss ON iss.cutoff = f.cutoff JOIN nat ON nat.cutoff = f.cutoff LEFT JOIN nb ON nb.region = f.region AND nb.cutoff = f.cutoff LEFT JOIN last_ ON last_.region = f.region AND last_.week = target)
        SELECT CAST(issue AS VARCHAR) AS issue, CAST(cutoff AS VARCHAR) AS cutoff, CAST(target AS VARCHAR) AS target, {", ".join(AS_IS)}, coverage_28 < 0.75 AS coverage_break, {", ".join(f"round({c}, {k}) + 0.0 AS {c}" for c, k in SHOWN.items())} FROM p"""


@query("q_issue_panel", PANEL)
def issue_panel(spark, sf_dir):
    """Every issue week and region: features from the revisions known at its cutoff, and the value of the week to forecast."""
    signal, truth = revisions(spark, sf_dir)
    out = op.issue_panel(signal, truth, ring(spark, sf_dir), "region", 7, least=4)
    kinds = {"sources": "double", "age_days": "long", "n_weeks": "long", "truth_age_days": "long"}
    whole = [F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in AS_IS]
    return out.select(*(F.col(c).cast("string").alias(c) for c in ("issue", "cutoff", "target")), *whole, "coverage_break", *(r(F.col(c), k).alias(c) for c, k in SHOWN.items()))


_CANDIDATES = {
    "last": "max_by(v, week)", "mean_4": "avg(v) FILTER (age <= 34)", "median_12": "quantile_cont(v, 0.5) FILTER (age <= 90)", "drift": "max_by(v, week) + CASE WHEN count(*) > 1 THEN regr_slope(v, age) * -14 ELSE 0 END",
}


@query(
    "q_vintage_benchmark",
    f"""WITH {REVISIONS}, h AS (SELECT region, cutoff, target, week, max_by(v, published) AS v, cutoff - week AS age FROM tru JOIN iss ON week BETWEEN cutoff - 182 AND cutoff AND published <= cutoff GROUP BY ALL),
        last_ AS (SELECT region, week, max_by(v, published) AS actual FROM tru GROUP BY ALL),
        m AS (SELECT region, cutoff, target, {", ".join(f"{sql} AS {name}" for name, sql in _CANDIDATES.items())} FROM h GROUP BY ALL),
        e AS (SELECT c.candidate, CASE c.candidate {" ".join(f"WHEN '{n}' THEN {n}" for n in _CANDIDATES)} END AS forecast, actual FROM m JOIN last_ l ON l.region = m.region AND l.week = m.target, (SELECT unnest([{", ".join(f"'{n}'" for n in _CANDIDATES)}]) AS candidate) c),
        b AS (SELECT candidate, count(*) AS n, avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) ** 2)) AS rmse, avg(forecast - actual) AS bias, sum(abs(forecast - actual)) / sum(abs(actual)) AS wape FROM e WHERE forecast IS NOT NULL GROUP BY 1)
        SELECT candidate, n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(bias, 5) + 0.0 AS bias, round(wape, 5) AS wape, row_number() OVER (ORDER BY mae, candidate) = 1 AS champion FROM b""",
)
def vintage_benchmark(spark, sf_dir):
    """Simple forecasters compared over all issues, each from the history its issue knew."""
    signal, truth = revisions(spark, sf_dir)
    v, age = F.col("v"), F.col("age")
    made = {
        "last": F.max_by("v", "week"), "mean_4": F.avg(F.when(age <= 34, v)), "median_12": F.percentile(F.when(age <= 90, v), F.lit(0.5)),
        "drift": F.max_by("v", "week") + F.when(F.count("*") > 1, F.regr_slope(v, age) * -14).otherwise(0.0),
    }
    last = truth.groupBy("region", F.col("week").alias("target")).agg(F.max_by("v", "published").alias("actual"))
    out = op.vintage_benchmark(truth, op.calendar(signal, "day", 7), last, made, ["region"], "week", "v", "published", 182)
    return out.select("candidate", "n", *(r(F.col(c), 5).alias(c) for c in ("mae", "rmse", "bias", "wape")), "champion")

"""Forecast evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r
from ..operators import metrics as op
from ..registry import query
from .inputs import SCORES, WEEKLY, scores, table, weekly

LEVELS = {0.025: 0.7, 0.1: 0.8, 0.25: 0.9, 0.5: 1.0, 0.75: 1.1, 0.9: 1.2, 0.975: 1.3}


def forecasts(spark, sf_dir):
    """Persistence forecasts of the weekly series with fixed quantile factors."""
    w = Window.partitionBy("flag").orderBy("week")
    return weekly(spark, sf_dir).withColumn("p", F.lag("v").over(w)).where("p IS NOT NULL").select("flag", "week", F.col("v").alias("y"), "p", *((F.col("p") * f).alias(f"q{int(k * 1000)}") for k, f in LEVELS.items()))


FORECASTS = WEEKLY + ", fc AS (SELECT flag, week, v AS y, p, " + ", ".join(f"p * {f} AS q{int(k * 1000)}" for k, f in LEVELS.items()) + " FROM (SELECT *, lag(v) OVER (PARTITION BY flag ORDER BY week) AS p FROM weekly) WHERE p IS NOT NULL)"
_PIN = lambda q, k: f"greatest({k} * (y - {q}), ({k} - 1) * (y - {q}))"
_WINK = lambda lo, hi, a: f"(({hi} - {lo}) + CASE WHEN y < {lo} THEN (2 / {a}) * ({lo} - y) ELSE 0 END + CASE WHEN y > {hi} THEN (2 / {a}) * (y - {hi}) ELSE 0 END)"
_IV = [(0.05, "q25", "q975"), (0.2, "q100", "q900"), (0.5, "q250", "q750")]


@query("q_pinball", f"WITH {FORECASTS} SELECT flag, " + ", ".join(f"round(avg({_PIN(f'q{int(k * 1000)}', k)}), 5) AS pinball_{int(k * 1000)}" for k in LEVELS) + " FROM fc GROUP BY flag")
def pinball(spark, sf_dir):
    return forecasts(spark, sf_dir).groupBy("flag").agg(*(r(F.avg(op.pinball(F.col("y"), F.col(f"q{int(k * 1000)}"), k)), 5).alias(f"pinball_{int(k * 1000)}") for k in LEVELS))


@query("q_wis_crps", f"WITH {FORECASTS} SELECT flag, round(avg((0.5 * abs(y - q500) + {' + '.join(f'({a} / 2) * {_WINK(lo, hi, a)}' for a, lo, hi in _IV)}) / 3.5), 5) AS wis, round(avg(2 * ({' + '.join(_PIN(f'q{int(k * 1000)}', k) for k in LEVELS)}) / 7), 5) AS crps FROM fc GROUP BY flag")
def wis(spark, sf_dir):
    score = op.weighted_interval_score(F.col("y"), F.col("q500"), [(a, F.col(lo), F.col(hi)) for a, lo, hi in _IV])
    crps = op.quantile_crps(F.col("y"), [(k, F.col(f"q{int(k * 1000)}")) for k in LEVELS])
    return forecasts(spark, sf_dir).groupBy("flag").agg(r(F.avg(score), 5).alias("wis"), r(F.avg(crps), 5).alias("crps"))


@query("q_winkler_coverage", f"WITH {FORECASTS} SELECT flag, round(avg({_WINK('q100', 'q900', 0.2)}), 5) AS winkler_80, round(avg(CAST(y BETWEEN q100 AND q900 AS INTEGER)), 6) AS coverage_80, round(avg(CAST(y BETWEEN q25 AND q975 AS INTEGER)), 6) AS coverage_95 FROM fc GROUP BY flag")
def winkler(spark, sf_dir):
    y = F.col("y")
    return forecasts(spark, sf_dir).groupBy("flag").agg(
        r(F.avg(op.interval_score(y, F.col("q100"), F.col("q900"), 0.2)), 5).alias("winkler_80"), r(F.avg(y.between(F.col("q100"), F.col("q900")).cast("int"))).alias("coverage_80"), r(F.avg(y.between(F.col("q25"), F.col("q975")).cast("int"))).alias("coverage_95")
    )


@query(
    "q_monotone_quantiles",
    f"WITH {FORECASTS}, x AS (SELECT flag, week, q250 * (1 + 0.3 * CAST(week >= DATE '1998-01-01' AS INTEGER)) AS a, q500 AS b, q750 * 0.9 AS c FROM fc) SELECT flag, CAST(week AS VARCHAR) AS week, round(a, 5) AS low, round(greatest(a, b), 5) AS mid, round(greatest(a, b, c), 5) AS high FROM x",
)
def monotone(spark, sf_dir):
    x = forecasts(spark, sf_dir)
    low, mid, high = op.monotone([F.col("q250") * (1 + 0.3 * (F.col("week") >= "1998-01-01").cast("int")), F.col("q500"), F.col("q750") * 0.9])
    return x.select("flag", F.col("week").cast("string").alias("week"), r(low, 5).alias("low"), r(mid, 5).alias("mid"), r(high, 5).alias("high"))


@query(
    "q_regression_metrics",
    f"""WITH {FORECASTS} SELECT flag, count(*) AS n, round(avg(abs(p - y)), 5) AS mae, round(sqrt(avg((p - y) ** 2)), 5) AS rmse, round(avg(abs(p - y) / nullif(y, 0)), 6) AS mape, round(avg(CASE WHEN abs(p) + abs(y) = 0 THEN 0 ELSE 2 * abs(p - y) / (abs(p) + abs(y)) END), 6) AS smape,
        round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) + 0.0 AS r2, round(covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)), 6) + 0.0 AS corr FROM fc GROUP BY flag""",
)
def regression(spark, sf_dir):
    out = op.regression(forecasts(spark, sf_dir), ["flag"], "y", "p")
    return out.select("flag", "n", *(r(F.col(c), 5).alias(c) for c in ("mae", "rmse")), *(r(F.col(c)).alias(c) for c in ("mape", "smape", "r2", "corr")))


@query(
    "q_classification",
    f"""WITH {SCORES}, c AS (SELECT source, count(*) FILTER (score >= 0.3 AND label = 1) AS tp, count(*) FILTER (score >= 0.3 AND label = 0) AS fp, count(*) FILTER (score < 0.3 AND label = 1) AS fn, count(*) FILTER (score < 0.3 AND label = 0) AS tn, avg((score - label) ** 2) AS b FROM scores GROUP BY source)
        SELECT source, tp, fp, fn, tn, round(b, 6) AS brier, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_alarm_rate FROM c""",
)
def classification(spark, sf_dir):
    out = op.classification(scores(spark, sf_dir), ["source"], "score", "label", 0.3)
    return out.select("source", "tp", "fp", "fn", "tn", *(r(F.col(c)).alias(c) for c in ("brier", "precision", "recall", "false_alarm_rate")))


@query("q_ece", f"WITH {SCORES}, b AS (SELECT source, least(floor(score * 10), 9) AS k, count(*) AS n, avg(score) AS p, avg(label) AS y FROM scores GROUP BY ALL) SELECT source, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b GROUP BY source")
def ece(spark, sf_dir):
    return op.calibration_error(scores(spark, sf_dir), ["source"], "score", "label").select("source", r(F.col("ece")).alias("ece"))


@query(
    "q_brier_parts",
    f"""WITH {SCORES}, b AS (SELECT source, least(floor(score * 10), 9) AS k, count(*) AS n, avg(score) AS p, avg(label) AS y FROM scores GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS m, sum(n * y) OVER (PARTITION BY source) / sum(n) OVER (PARTITION BY source) AS base FROM b)
        SELECT source, round(sum(n * (p - y) ** 2 / m), 6) AS reliability, round(sum(n * (y - base) ** 2 / m), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM t GROUP BY source""",
)
def brier_parts(spark, sf_dir):
    out = op.brier_parts(scores(spark, sf_dir), ["source"], "score", "label")
    return out.select("source", *(r(F.col(c)).alias(c) for c in ("reliability", "resolution", "uncertainty")))


_CURVE = f"{SCORES}, g AS (SELECT source, floor(score * 100) AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY ALL), h AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY source) AS pa, sum(neg) OVER (PARTITION BY source) AS na FROM g WINDOW d AS (PARTITION BY source ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"


def tied(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("s", F.floor(F.col("score") * 100))


@query("q_average_precision", f"WITH {_CURVE} SELECT source, round(sum(pos / pa * tp / (tp + fp)), 6) AS ap FROM h GROUP BY source")
def average_precision(spark, sf_dir):
    return op.average_precision(tied(spark, sf_dir), ["source"], "s", "label").select("source", r(F.col("ap")).alias("ap"))


@query("q_roc_auc", f"WITH {_CURVE} SELECT source, round(sum(pos * (na - fp + neg / 2) / (pa * na)), 6) AS auc FROM h GROUP BY source")
def roc_auc(spark, sf_dir):
    return op.roc_auc(tied(spark, sf_dir), ["source"], "s", "label").select("source", r(F.col("auc")).alias("auc"))


@query(
    "q_quality_auc",
    "WITH x AS (SELECT quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM x GROUP BY s), h AS (SELECT *, sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM g) SELECT round(sum(pos * (na - fp + neg / 2) / (pa * na)), 6) AS auc FROM h",
)
def quality_auc(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("s")).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("all", F.lit(1))
    return op.roc_auc(x, ["all"], "s", "quality").select(r(F.col("auc")).alias("auc"))


@query(
    "q_precision_at_k",
    f"""WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, event_id) AS i FROM scores), d AS (SELECT day, sum(label) FILTER (i <= 3) AS hits, sum(label) AS pos, least(count(*), 3) AS k FROM k GROUP BY day HAVING sum(label) > 0)
        SELECT count(*) AS groups, round(avg(hits / k), 6) AS precision, round(avg(hits / pos), 6) AS recall, round(avg(hits / least(3, pos)), 6) AS top_recall FROM d""",
)
def precision_at_k(spark, sf_dir):
    out = op.at_top_k(scores(spark, sf_dir), ["day"], "score", "label", ["event_id"], 3)
    return out.select("groups", *(r(F.col(c)).alias(c) for c in ("precision", "recall", "top_recall")))


_GRID = [round(0.05 * k, 2) for k in range(1, 19)]
_GRIDQ = f"{SCORES}, g AS (SELECT unnest({_GRID}) AS threshold), a AS (SELECT source, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold) AS flagged, count(*) FILTER (label = 1) AS p FROM scores, g GROUP BY ALL), m AS (SELECT source, threshold, tp / nullif(flagged, 0) AS precision, tp / nullif(p, 0) AS recall, flagged FROM a)"


@query("q_threshold_grid", f"WITH {_GRIDQ} SELECT source, CAST(threshold AS DOUBLE) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, flagged FROM m")
def threshold_grid(spark, sf_dir):
    out = op.threshold_grid(scores(spark, sf_dir), ["source"], "score", "label", _GRID)
    return out.select("source", "threshold", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"), "flagged")


@query("q_action_threshold", f"WITH {_GRIDQ}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY precision DESC, recall DESC, threshold) AS i FROM m WHERE recall >= 0.35 AND precision IS NOT NULL) SELECT source, CAST(threshold AS DOUBLE) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM k WHERE i = 1")
def action_threshold(spark, sf_dir):
    out = op.best_threshold(op.threshold_grid(scores(spark, sf_dir), ["source"], "score", "label", _GRID), ["source"], 0.35)
    return out.select("source", "threshold", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"))


@query("q_reliability_bins", f"WITH {SCORES}, b AS (SELECT ntile(10) OVER (ORDER BY score, event_id) AS bin, score, label FROM scores) SELECT bin, count(*) AS n, round(avg(score), 6) AS p, round(avg(label), 6) AS y FROM b GROUP BY bin")
def reliability(spark, sf_dir):
    return op.reliability_bins(scores(spark, sf_dir), "score", "label", ["event_id"]).select("bin", "n", r(F.col("p")).alias("p"), r(F.col("y")).alias("y"))


@query(
    "q_phase_f1",
    f"""WITH {SCORES}, x AS (SELECT CASE WHEN score < 0.1 THEN 'low' WHEN score < 0.3 THEN 'mid' ELSE 'high' END AS g, CASE WHEN label = 1 THEN 'high' WHEN event_id % 3 = 0 THEN 'mid' ELSE 'low' END AS t FROM scores),
        l AS (SELECT DISTINCT unnest([g, t]) AS l FROM x), c AS (SELECT l, count(*) FILTER (t = l AND g = l) AS tp, count(*) FILTER (t = l) AS n, count(*) FILTER (g = l) AS m FROM x, l GROUP BY l)
        SELECT round(avg(2.0 * tp / (n + m)) FILTER (n > 0), 6) AS macro_f1, round(sum(tp) / sum(n), 6) AS accuracy FROM c""",
)
def phase_f1(spark, sf_dir):
    x = scores(spark, sf_dir).select(F.when(F.col("score") < 0.1, "low").when(F.col("score") < 0.3, "mid").otherwise("high").alias("g"), F.when(F.col("label") == 1, "high").when(F.col("event_id") % 3 == 0, "mid").otherwise("low").alias("t"))
    return op.macro_f1(x, "t", "g").select(r(F.col("macro_f1")).alias("macro_f1"), r(F.col("accuracy")).alias("accuracy"))


@query(
    "q_leaderboard",
    f"""WITH {WEEKLY}, x AS (SELECT flag, week, v, lag(v) OVER w AS persistence, lag(v, 52) OVER w AS season, avg(v) OVER (PARTITION BY flag ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mean4 FROM weekly WINDOW w AS (PARTITION BY flag ORDER BY week)),
        u AS (SELECT flag, 'persistence' AS candidate, v, persistence AS p FROM x UNION ALL SELECT flag, 'season', v, season FROM x UNION ALL SELECT flag, 'mean4', v, mean4 FROM x), m AS (SELECT flag, candidate, avg(abs(p - v)) AS mae, count(*) AS n FROM u WHERE p IS NOT NULL GROUP BY ALL)
        SELECT flag, candidate, n, round(mae, 5) AS mae, row_number() OVER (PARTITION BY flag ORDER BY mae, candidate) AS rank FROM m""",
)
def leaderboard(spark, sf_dir):
    w = Window.partitionBy("flag").orderBy("week")
    x = weekly(spark, sf_dir).withColumns({"persistence": F.lag("v").over(w), "season": F.lag("v", 52).over(w), "mean4": F.avg("v").over(w.rowsBetween(-4, -1))})
    u = x.unpivot(["flag", "v"], ["persistence", "season", "mean4"], "candidate", "p").where("p IS NOT NULL")
    m = u.groupBy("flag", "candidate").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("v"))).alias("mae"))
    return m.select("flag", "candidate", "n", r(F.col("mae"), 5).alias("mae"), F.row_number().over(Window.partitionBy("flag").orderBy("mae", "candidate")).cast("long").alias("rank"))


@query("q_season_split", f"WITH {FORECASTS} SELECT flag, CASE WHEN weekofyear(week) >= 40 OR weekofyear(week) <= 10 THEN 'peak' ELSE 'post' END AS season, count(*) AS n, round(avg(abs(p - y)), 5) AS mae FROM fc GROUP BY ALL")
def season_split(spark, sf_dir):
    woy = F.weekofyear("week")
    out = op.regression(forecasts(spark, sf_dir).withColumn("season", F.when((woy >= 40) | (woy <= 10), "peak").otherwise("post")), ["flag", "season"], "y", "p")
    return out.select("flag", "season", "n", r(F.col("mae"), 5).alias("mae"))


@query(
    "q_random_hit_chance",
    f"WITH {SCORES}, d AS (SELECT day, count(*) AS n, sum(label) AS m FROM scores GROUP BY day) SELECT CAST(day AS VARCHAR) AS day, round(1 - (greatest(n - m, 0) / n) * (greatest(n - m - 1, 0) / greatest(n - 1, 1)) * (greatest(n - m - 2, 0) / greatest(n - 2, 1)), 6) AS chance FROM d WHERE n >= 3",
)
def random_hit(spark, sf_dir):
    d = scores(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), F.sum("label").alias("m")).where("n >= 3")
    return d.select(F.col("day").cast("string").alias("day"), r(op.chance_of_a_hit(F.col("n"), F.col("m"), F.lit(3))).alias("chance"))


@query(
    "q_climatology",
    f"""WITH {WEEKLY}, a AS (SELECT flag, weekofyear(week) AS w, quantile_cont(v, 0.5) AS m FROM weekly WHERE week < DATE '1999-01-01' GROUP BY ALL), b AS (SELECT flag, quantile_cont(v, 0.5) AS m FROM weekly WHERE week < DATE '1999-01-01' GROUP BY flag)
        SELECT x.flag, CAST(x.week AS VARCHAR) AS week, round(coalesce(a.m, b.m), 5) AS prediction FROM weekly x LEFT JOIN a ON a.flag = x.flag AND a.w = weekofyear(x.week) LEFT JOIN b ON b.flag = x.flag WHERE x.week >= DATE '1999-01-01'""",
)
def climatology(spark, sf_dir):
    w = weekly(spark, sf_dir).withColumn("w", F.weekofyear("week"))
    past, half = w.where("week < date'1999-01-01'"), F.percentile("v", F.lit(0.5))
    out = w.where("week >= date'1999-01-01'").join(past.groupBy("flag", "w").agg(half.alias("a")), ["flag", "w"], "left").join(past.groupBy("flag").agg(half.alias("b")), "flag", "left")
    return out.select("flag", F.col("week").cast("string").alias("week"), r(F.coalesce("a", "b"), 5).alias("prediction"))

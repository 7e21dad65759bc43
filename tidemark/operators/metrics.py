"""Forecast evaluation as aggregates. Each takes a table and grouping keys and returns a row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def pinball(y: Column, q: Column, level: float) -> Column:
    e = y - q
    return F.greatest(level * e, (level - 1) * e)


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    """Width plus 2 / alpha times what lies outside (Winkler)."""
    return (high - low) + F.when(y < low, (2 / alpha) * (low - y)).otherwise(0.0) + F.when(y > high, (2 / alpha) * (y - high)).otherwise(0.0)


def weighted_interval_score(y: Column, median: Column, intervals: list[tuple[float, Column, Column]]) -> Column:
    """Half the median's error and alpha / 2 times each interval score, over the number of intervals and a half."""
    total = 0.5 * F.abs(y - median)
    for alpha, low, high in intervals:
        total += (alpha / 2) * interval_score(y, low, high, alpha)
    return total / (len(intervals) + 0.5)


def monotone(quantiles: list[Column]) -> list[Column]:
    """Running greatest, so that no quantile lies under the one before."""
    out = [quantiles[0]]
    for q in quantiles[1:]:
        out.append(F.greatest(out[-1], q))
    return out


def quantile_crps(y: Column, quantiles: list[tuple[float, Column]]) -> Column:
    """Twice the mean pinball loss over the levels."""
    return 2 * sum(pinball(y, q, level) for level, q in quantiles) / len(quantiles)


def regression(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """n, MAE, RMSE, MAPE (of nonzero truths), sMAPE (0 where both are 0), R2 and correlation."""
    e = F.col(p) - F.col(y)
    both = F.abs(y) + F.abs(p)
    m = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))).alias("mape"),
        F.avg(F.when(both == 0, 0.0).otherwise(F.try_divide(2 * F.abs(e), both))).alias("smape"),
        F.sum(e * e).alias("__sse"), F.var_pop(y).alias("__v"), F.stddev_pop(y).alias("__sy"), F.stddev_pop(p).alias("__sp"), F.covar_pop(y, p).alias("__c"),
    )
    corr = F.when((F.col("__sy") > 1e-12) & (F.col("__sp") > 1e-12), ratio(F.col("__c"), F.col("__sy") * F.col("__sp")))
    return m.select(*keys, "n", "mae", "rmse", "mape", "smape", (1 - ratio(F.col("__sse"), F.col("__v") * F.col("n"))).alias("r2"), corr.alias("corr"))


def classification(df: DataFrame, keys: list[str], score: str, label: str, threshold: float) -> DataFrame:
    """Counts, precision, recall, share of false alarms among negatives, and Brier score at a threshold."""
    hit, yes = F.col(score) >= threshold, F.col(label) == 1
    m = df.groupBy(*keys).agg(
        F.sum((hit & yes).cast("long")).alias("tp"), F.sum((hit & ~yes).cast("long")).alias("fp"), F.sum((~hit & yes).cast("long")).alias("fn"), F.sum((~hit & ~yes).cast("long")).alias("tn"),
        F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"),
    )
    return m.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_rate"))


def calibration_error(df: DataFrame, keys: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width, the last one closed."""
    parts = df.withColumn("__b", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).groupBy(*keys, "__b").agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("y"))
    return parts.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def brier_parts(df: DataFrame, keys: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty of the Brier score over bins of equal width."""
    w = Window.partitionBy(*keys)
    parts = df.withColumn("__b", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).groupBy(*keys, "__b").agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("y"))
    parts = parts.withColumn("all", F.sum("n").over(w)).withColumn("base", F.sum(F.col("n") * F.col("y")).over(w) / F.col("all"))
    return parts.groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("p") - F.col("y")) ** 2 / F.col("all")).alias("reliability"), F.sum(F.col("n") * (F.col("y") - F.col("base")) ** 2 / F.col("all")).alias("resolution"), F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty")
    )


def _by_score(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score, with those of this and all higher scores. Scores are counted
    in steps of a 1024th first; a step's offset comes from the counts of the steps, so that a window only ever
    runs over the scores of one step, or over the steps."""
    count = lambda v: F.sum((F.col(label) == v).cast("long"))
    each = df.groupBy(*keys, score).agg(count(1).alias("pos"), count(0).alias("neg")).withColumn("__step", F.floor(F.col(score) * 1024))
    w, above = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = each.groupBy(*keys, "__step").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    none = lambda c: F.coalesce(c, F.lit(0))
    steps = steps.select(*keys, "__step", none(F.sum("__p").over(above)).alias("__tp"), none(F.sum("__n").over(above)).alias("__fp"), F.sum("__p").over(w).alias("p_all"), F.sum("__n").over(w).alias("n_all"))
    down = Window.partitionBy(*keys, "__step").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return each.join(steps, [*keys, "__step"]).withColumns({"tp": F.col("__tp") + F.sum("pos").over(down), "fp": F.col("__fp") + F.sum("neg").over(down)}).drop("__tp", "__fp", "__step")


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Average precision with tied scores taken together; 0 where a class is missing."""
    g = _by_score(df, keys, score, label)
    return g.groupBy(*keys).agg(F.coalesce(F.when(F.max("n_all") > 0, F.sum(ratio(F.col("pos"), F.col("p_all")) * F.col("tp") / (F.col("tp") + F.col("fp")))), F.lit(0.0)).alias("ap"))


def roc_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve, tied scores counting half; null where a class is missing."""
    g = _by_score(df, keys, score, label)
    below = F.col("n_all") - F.col("fp")
    return g.groupBy(*keys).agg(F.sum(ratio(F.col("pos") * (below + F.col("neg") / 2), F.col("p_all") * F.col("n_all"))).alias("auc"))


def at_top_k(df: DataFrame, group: list[str], score: str, label: str, ties: list[str], k: int) -> DataFrame:
    """Over groups that have a positive: mean precision and recall of the k best, and recall over min(k, positives)."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__n", F.row_number().over(w.orderBy(F.desc(score), *ties)))
    each = ranked.groupBy(*group).agg(F.sum(F.when(F.col("__n") <= k, F.col(label))).alias("hits"), F.sum(label).alias("pos"), F.least(F.count("*"), F.lit(k)).alias("k")).where("pos > 0")
    return each.agg(F.count("*").alias("groups"), F.avg(F.col("hits") / F.col("k")).alias("precision"), F.avg(F.col("hits") / F.col("pos")).alias("recall"), F.avg(F.col("hits") / F.least(F.lit(k), F.col("pos"))).alias("top_recall"))


def threshold_grid(df: DataFrame, keys: list[str], score: str, label: str, grid: list[float]) -> DataFrame:
    """Precision and recall at every threshold: each row counts at the highest threshold it reaches, and
    running sums do the rest, so rows are not multiplied by the grid."""
    steps = F.array(*[F.lit(g) for g in grid])
    reached = F.size(F.filter(steps, lambda g: g <= F.col(score)))
    each = df.groupBy(*keys, reached.alias("__r")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    all_ = each.groupBy(*keys).agg(F.sum("pos").alias("p_all"))
    grid_rows = all_.select(*keys, "p_all", F.posexplode(steps).alias("__i", "threshold"))
    met = grid_rows.join(each, keys).where("__r > __i").groupBy(*keys, "threshold", "p_all").agg(F.sum("pos").alias("tp"), F.sum("n").alias("flagged"))
    full = grid_rows.select(*keys, "threshold", "p_all").join(met.drop("p_all"), [*keys, "threshold"], "left").fillna(0, ["tp", "flagged"])
    return full.select(*keys, "threshold", ratio(F.col("tp"), F.col("flagged")).alias("precision"), ratio(F.col("tp"), F.col("p_all")).alias("recall"), F.col("flagged"))


def best_threshold(grid: DataFrame, keys: list[str], recall: float) -> DataFrame:
    """The threshold of most precision at a least recall; then of most recall; then the lowest."""
    return grid.where((F.col("recall") >= recall) & F.col("precision").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("threshold", "precision", "recall"), F.struct("precision", "recall", -F.col("threshold"))).alias("b")).select(*keys, "b.*")


def reliability_bins(df: DataFrame, score: str, label: str, ties: list[str], bins: int = 10) -> DataFrame:
    """Bins of equal count by score. Ranks are offsets of score steps (a 1024th each), offsets within a step of
    its scores and stretches of the first tie column, and places in such a stretch, so that no task sorts all
    rows, nor all rows of one score where the first tie column is a number."""
    numeric = df.schema[ties[0]].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
    low, high = df.agg(F.min(ties[0]), F.max(ties[0])).first() if numeric else (None, None)
    width = max((high - low) / 1024, 1e-9) if low is not None else 1.0
    stretch = F.floor((F.col(ties[0]) - low) / width) if low is not None else F.lit(0).cast("long")
    rows = df.withColumn("__b", F.floor(F.col(score) * 1024)).withColumn("__t", stretch)
    cell = ["__b", score, "__t"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("__n"))
    steps = cells.groupBy("__b").agg(F.sum("__n").alias("__m"))
    all_ = Window.partitionBy(F.lit(0))
    starts = steps.select("__b", (F.sum("__m").over(all_.orderBy("__b")) - F.col("__m")).alias("__start"), F.sum("__m").over(all_).alias("__all"))  # a row for each step
    inside = F.sum("__n").over(Window.partitionBy("__b").orderBy(score, "__t")) - F.col("__n")
    placed = cells.select(*cell, inside.alias("__in")).join(starts, "__b")
    rank = F.col("__start") + F.col("__in") + F.row_number().over(Window.partitionBy(*cell).orderBy(*ties))
    base, more = F.floor(F.col("__all") / bins), F.col("__all") % bins
    edge = more * (base + 1)
    number = F.when(F.col("__rank") <= edge, F.ceil(F.col("__rank") / (base + 1))).otherwise(more + F.ceil(F.try_divide(F.col("__rank") - edge, base)))
    return rows.join(placed, cell).withColumn("__rank", rank).withColumn("bin", number.cast("long")).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("y"))


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy and the mean F1 over the labels that occur in the truth."""
    each = df.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("label"), truth, guess).groupBy("label").agg(
        F.sum(((F.col(truth) == F.col("label")) & (F.col(guess) == F.col("label"))).cast("long")).alias("tp"), F.sum((F.col(truth) == F.col("label")).cast("long")).alias("t"), F.sum((F.col(guess) == F.col("label")).cast("long")).alias("g")
    )
    return each.agg(F.avg(F.when(F.col("t") > 0, F.coalesce(ratio(2 * F.col("tp"), F.col("t") + F.col("g")), F.lit(0.0)))).alias("macro_f1"), ratio(F.sum("tp"), F.sum("t")).alias("accuracy"))


def chance_of_a_hit(n: Column, positives: Column, k: Column) -> Column:
    """1 - C(n - m, k) / C(n, k): that k drawn at random meet one of m positives."""
    miss = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), F.lit(1.0), lambda acc, i: acc * F.greatest(n - positives - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.when(k > 0, 1 - miss).otherwise(0.0)


def lead_time(df: DataFrame, keys: list[str], issued: str, target: str, score: str, label: str, threshold: float) -> DataFrame:
    """Median and mean days from issue to target over hits, and how many hits there are."""
    days = F.when((F.col(score) >= threshold) & (F.col(label) == 1), F.datediff(target, issued))
    return df.groupBy(*keys).agg(F.percentile(days, F.lit(0.5)).alias("median_days"), F.avg(days).alias("mean_days"), F.count(days).alias("hits"))


def vintage_errors(df: DataFrame, keys: list[str], issued: str, target: str, y: str, p: str) -> DataFrame:
    """Per issue horizon: rows, median and 90th percentile of the absolute error, bias."""
    e = F.col(p) - F.col(y)
    return df.withColumn("horizon", F.datediff(target, issued)).groupBy(*keys, "horizon").agg(F.count("*").alias("n"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_error"), F.percentile(F.abs(e), F.lit(0.9)).alias("p90_error"), F.avg(e).alias("bias"))


def decisions(df: DataFrame, keys: list[str], order: str, y: str, p: str, rise: float, width: int) -> DataFrame:
    """Alerts (forecast) against events (truth), both as growth over the median of the rows before: hits,
    false alarms, misses, and a readiness of 0.4 hit rate, 0.35 precision and 0.25 nearness."""
    base = F.percentile(y, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-width, -1))
    x = df.withColumn("__b", base).where("__b IS NOT NULL")
    grown = lambda c: (F.col(c) - F.col("__b")) / F.greatest(F.abs("__b"), F.lit(1.0)) >= rise
    x = x.withColumn("alert", grown(p)).withColumn("event", grown(y))
    near = F.greatest(1 - F.abs(F.col(p) - F.col(y)) / F.greatest(F.abs(y), F.lit(1.0)), F.lit(0.0))
    m = x.groupBy(*keys).agg(
        F.sum((F.col("alert") & F.col("event")).cast("long")).alias("hits"), F.sum((F.col("alert") & ~F.col("event")).cast("long")).alias("false_alarms"), F.sum((~F.col("alert") & F.col("event")).cast("long")).alias("misses"), F.avg(near).alias("__near")
    )
    rate = lambda b: F.coalesce(ratio(F.col("hits"), F.col("hits") + F.col(b)), F.lit(0.0))
    return m.withColumn("readiness", 0.4 * rate("misses") + 0.35 * rate("false_alarms") + 0.25 * F.col("__near")).drop("__near")


def bootstrap(folds: DataFrame, fold: str, value: str, rounds: int = 500, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean over folds with a percentile interval from resampled folds. Draws are hashes of round and place,
    so a rerun gives the same interval. Folds are few; rounds times folds rows are made."""
    numbered = folds.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(fold)).alias("i"), F.col(value).alias("v"))
    n = numbered.agg(F.count("*").alias("n"))
    draws = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b")).select("b", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).select("b", (F.pmod(F.xxhash64("b", "k"), "n") + 1).cast("int").alias("i"))
    means = draws.join(F.broadcast(numbered), "i").groupBy("b").agg(F.avg("v").alias("m"))
    return means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high")).join(F.broadcast(numbered.agg(F.avg("v").alias("mean"), F.count("*").alias("folds"))))


def overlap(df: DataFrame, group: list[str], y: str, p: str, ties: list[str], k: int = 3) -> DataFrame:
    """Per group: MAPE with a floor, correlation, and the share of the k largest truths among the k largest
    forecasts."""
    w = Window.partitionBy(*group)
    x = df.withColumn("__a", F.row_number().over(w.orderBy(F.desc(y), *ties)) <= k).withColumn("__f", F.row_number().over(w.orderBy(F.desc(p), *ties)) <= k)
    m = x.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(p) - F.col(y)) / F.greatest(F.abs(y), F.lit(1e-6))).alias("mape"), F.stddev_pop(y).alias("__sy"), F.stddev_pop(p).alias("__sp"), F.covar_pop(y, p).alias("__c"), (F.sum((F.col("__a") & F.col("__f")).cast("int")) / F.least(F.count("*"), F.lit(k))).alias("top_overlap"))
    corr = F.when((F.col("__sy") > 1e-12) & (F.col("__sp") > 1e-12), ratio(F.col("__c"), F.col("__sy") * F.col("__sp")))
    return m.select(*group, "n", "mape", corr.alias("corr"), "top_overlap")


def merge_small_bins(bins: DataFrame, least: int) -> DataFrame:
    """Bins with fewer than `least` rows join the neighbour whose mean score is nearer, smallest first. There
    are as many rows as bins, so the loop runs in one group."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("bin")[["n", "p", "y"]].values.tolist()
        while len(rows) > 1 and min(x[0] for x in rows) < least:
            i = min(range(len(rows)), key=lambda k: (rows[k][0], k))
            near = [k for k in (i - 1, i + 1) if 0 <= k < len(rows)]
            j = min(near, key=lambda k: (abs(rows[k][1] - rows[i][1]), k))
            (n, p, y), (m, q, z) = rows[i], rows[j]
            rows[min(i, j)] = [n + m, (n * p + m * q) / (n + m), (n * y + m * z) / (n + m)]
            rows.pop(max(i, j))
        return pd.DataFrame([(k + 1, int(n), p, y) for k, (n, p, y) in enumerate(rows)], columns=["bin", "n", "p", "y"])

    return bins.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(run, "bin long, n long, p double, y double")

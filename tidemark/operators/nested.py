"""Nested walk-forward evaluation of event forecasts.

Each expanding fold has four parts by date: rows to fit the model, a tail to fit calibrations, a guard that chooses among them
and sets the threshold, and the test after all of these. The models of all folds are fitted side by side (see `boosting`),
calibrations too, and they are applied to rows by joins on the fold; a row is copied to the folds it has a part
in, at most `splits` of them. Nothing of a fold rests on rows after it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..scratch import cut
from . import boosting, metrics

LOWEST, HIGHEST = 0.001, 0.999
GRID = [round(0.05 * k, 2) for k in range(1, 19)]


def panel_folds(df: DataFrame, day: str, splits: int = 5, least_train: int = 90, least_test: int = 21, holdout: float = 0.2, guard: float = 0.35, least_calibration: int = 14, least_guard: int = 7, least_fit: int = 20) -> DataFrame:
    """Folds over the distinct dates: fold, `fit_end`, `calibration_end`, `guard_end` and `test_end`, each the last date of
    its part. Dates are a calendar; they are numbered in one small task. Too few dates give no folds."""
    dates = df.select(F.col(day).alias("d")).where("d IS NOT NULL").distinct().withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d")))
    count = dates.count()
    size, spans = max(least_test, (count - least_train) // max(splits, 1)), []
    for k in range(splits):
        train = least_train + k * size
        test = min(train + size, count)
        if test - train < least_test:
            break
        tail = min(max(least_calibration, int(train * holdout)), train - least_fit)
        held = min(max(least_guard, int(tail * guard)), tail - least_guard)
        if tail > 0 and held > 0:
            spans.append((k, train - tail, train - held, train, test))
    table = df.sparkSession.createDataFrame(spans, "fold int, n0 int, n1 int, n2 int, n3 int")
    for k, name in enumerate(("fit_end", "calibration_end", "guard_end", "test_end")):
        table = table.join(dates.select(F.col("n").alias(f"n{k}"), F.col("d").alias(name)), f"n{k}")
    return table.select("fold", "fit_end", "calibration_end", "guard_end", "test_end")


def with_roles(df: DataFrame, day: str, folds: DataFrame) -> DataFrame:
    """Rows in each fold they have a part in, with `fold` and `role`: fit, calibration, guard or test."""
    d = F.col(day)
    role = F.when(d <= F.col("fit_end"), "fit").when(d <= F.col("calibration_end"), "calibration").when(d <= F.col("guard_end"), "guard").otherwise("test")
    return df.join(F.broadcast(folds), d <= F.col("test_end")).withColumn("role", role).drop("fit_end", "calibration_end", "guard_end", "test_end")


def event_weights(fit: DataFrame, day: str, label: str, half_life: float | None = None) -> DataFrame:
    """`weight` of each row of a fold: negatives over positives for an event, times a half for each half-life before the
    fold's last date (within .05 and 2)."""
    y = F.col(label) == 1
    sums = fit.groupBy("fold").agg(F.max(day).alias("__last"), ratio(F.sum((~y).cast("int")), F.sum(y.cast("int"))).alias("__pos"))
    old = F.pow(F.lit(0.5), F.datediff("__last", day) / half_life) if half_life else F.lit(1.0)
    return fit.join(F.broadcast(sums), "fold").withColumn("weight", F.when(y, F.coalesce("__pos", F.lit(1.0))).otherwise(1.0) * F.least(F.greatest(old, F.lit(0.05)), F.lit(2.0))).drop("__last", "__pos")


def platt_fits(df: DataFrame, by: str, score: str, label: str, rounds: int = 12, ridge: float = 1e-3) -> DataFrame:
    """Per group the logistic line of a score: by, a, b. All groups together, an aggregate a round."""
    spark, kind = df.sparkSession, dict(df.dtypes)[by]
    x, y = F.col(score), F.col(label).cast("double")
    lines = {r[0]: (1.0, 0.0) for r in df.groupBy(by).agg(F.count_distinct(label).alias("n")).where("n = 2").collect()}
    for _ in range(rounds if lines else 0):
        now = spark.createDataFrame([(k, *v) for k, v in lines.items()], f"`{by}` {kind}, __a double, __b double")
        p = 1 / (1 + F.exp(-(F.col("__a") * x + F.col("__b"))))
        w, off = p * (1 - p), y - p
        sums = df.join(F.broadcast(now), by).groupBy(by).agg(F.array(*[F.sum(c) for c in (w * x * x, w * x, w, off * x, off)]).alias("__s"))
        moved = 0.0
        for r in sums.collect():
            (a, b), (xx, x1, one, gx, g) = lines[r[by]], r["__s"]
            step = np.linalg.solve([[xx + ridge, x1], [x1, one + ridge]], [gx - ridge * a, g - ridge * b])
            step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
            lines[r[by]], moved = (a + float(step[0]), b + float(step[1])), max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return spark.createDataFrame([(k, *v) for k, v in lines.items()], f"`{by}` {kind}, a double, b double")


def isotonic_fits(df: DataFrame, by: str, score: str, label: str, digits: int = 3) -> DataFrame:
    """Per group the ends of the pools of a rising fit: by, xs, ys. Scores (0 to 1) are rounded first, so a group has at
    most 10^digits + 1 points, whatever its rows are."""
    points = df.groupBy(by, F.round(score, digits).alias("x")).agg(F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))

    def pool(group: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []  # mean, weight, first x, last x
        for x, y, w in group.sort_values("x")[["x", "y", "w"]].itertuples(index=False):
            blocks.append([y, w, x, x])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, n, _, end = blocks.pop()
                last = blocks[-1]
                blocks[-1] = [(last[0] * last[1] + m * n) / (last[1] + n), last[1] + n, last[2], end]
        ends = [(x, b[0]) for b in blocks for x in ((b[2], b[3]) if b[2] != b[3] else (b[2],))]
        return pd.DataFrame({by: [group[by].iloc[0]], "xs": [[e[0] for e in ends]], "ys": [[e[1] for e in ends]]})

    return points.groupBy(by).applyInPandas(pool, f"`{by}` {dict(df.dtypes)[by]}, xs array<double>, ys array<double>")


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """The value of a line through points at x; beyond them the nearest point's."""
    k = F.size(F.filter(xs, lambda p: p <= x))
    n = F.size(xs)
    x0, x1, y0, y1 = (F.get(a, F.greatest(F.least(b, n - 1), F.lit(0))) for a, b in ((xs, k - 1), (xs, k), (ys, k - 1), (ys, k)))
    return F.when(n > 0, F.when((k == 0) | (x1 == x0), F.when(k == 0, y1).otherwise(y0)).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0)))


def with_candidates(df: DataFrame, by: str, margin: str, probability: str, platt: DataFrame, isotonic: DataFrame) -> DataFrame:
    """Rows once for each calibration that their group has: `mode` (raw, isotonic, platt) and `p`, within .001 and .999."""
    held = df.join(F.broadcast(platt.toDF(by, "__a", "__b")), by, "left").join(F.broadcast(isotonic.toDF(by, "__xs", "__ys")), by, "left")
    made = F.array(
        F.struct(F.lit("raw").alias("mode"), F.col(probability).alias("p")), F.struct(F.lit("isotonic").alias("mode"), interpolated(F.col(probability), F.col("__xs"), F.col("__ys")).alias("p")),
        F.struct(F.lit("platt").alias("mode"), (1 / (1 + F.exp(-(F.col("__a") * F.col(margin) + F.col("__b"))))).alias("p")),
    )
    each = held.withColumn("__c", F.explode(made)).where("__c.p IS NOT NULL")
    return each.withColumns({"mode": F.col("__c.mode"), "p": F.least(F.greatest(F.col("__c.p"), F.lit(LOWEST)), F.lit(HIGHEST))}).drop("__c", "__a", "__b", "__xs", "__ys")


def action_thresholds(df: DataFrame, by: list[str], score: str, label: str, recall: float = 0.35) -> DataFrame:
    """Per group the threshold of most precision at a least recall, then of most recall, then the lowest; where none has that
    recall with any precision, among all; where no threshold meets an event, one half."""
    grid = metrics.threshold_grid(df, by, score, label, GRID).withColumn("precision", F.coalesce("precision", F.lit(0.0))).withColumn("recall", F.coalesce("recall", F.lit(0.0)))
    best = F.max_by(F.struct("threshold", "precision", "recall"), F.struct(F.col("recall") >= recall, F.round("precision", 9), F.round("recall", 9), -F.col("threshold"))).alias("b")
    found = grid.where("precision > 0").groupBy(*by).agg(best).select(*by, "b.*")
    return df.select(*by).distinct().join(found, by, "left").fillna({"threshold": 0.5, "precision": 0.0, "recall": 0.0})


def guard_scores(df: DataFrame, by: list[str], day: str, label: str, threshold: str, ties: list[str], k: int = 3, bins: int = 10) -> DataFrame:
    """Per group: Brier score, calibration error, mean precision of the k best of each date with an event, and the share of
    other rows at or above the row's threshold."""
    y, hit = F.col(label), F.col("p") >= F.col(threshold)
    one = df.groupBy(*by).agg(F.avg((F.col("p") - y) ** 2).alias("brier"), F.coalesce(ratio(F.sum((hit & (y == 0)).cast("int")), F.sum((y == 0).cast("int"))), F.lit(0.0)).alias("false_alarm_rate"))
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by, day).orderBy(F.desc("p"), *ties)))
    dates = ranked.groupBy(*by, day).agg(F.sum(y).alias("__y"), (F.sum(F.when(F.col("__n") <= k, y)) / F.least(F.count("*"), F.lit(k))).alias("__top")).where("__y > 0")
    top = dates.groupBy(*by).agg(F.avg("__top").alias("top_precision"))
    return one.join(metrics.calibration_error(df, by, "p", label, bins), by).join(top, by, "left").fillna(0.0, ["top_precision"])


def chosen_modes(scores: DataFrame, by: str, slack: float = 1e-9) -> DataFrame:
    """Per group the calibration that is no worse than raw in all four scores and has the least calibration error, then Brier
    score; raw if there is none."""
    raw = scores.where("mode = 'raw'").select(by, *[F.col(c).alias(f"__{c}") for c in ("brier", "ece", "top_precision", "false_alarm_rate")])
    fair = (F.col("mode") != "raw") & (F.col("brier") <= F.col("__brier") + slack) & (F.col("ece") <= F.col("__ece") + slack) & (F.col("top_precision") + slack >= F.col("__top_precision")) & (F.col("false_alarm_rate") <= F.col("__false_alarm_rate") + slack)
    key = F.struct(F.round("ece", 12), F.round("brier", 12), -F.col("top_precision"), "false_alarm_rate", "mode")
    best = F.min_by(F.when(fair, F.col("mode")), F.when(fair, key))
    return scores.join(raw, by).groupBy(by).agg(F.coalesce(best, F.lit("raw")).alias("mode"))


def nested_walk_forward(df: DataFrame, day: str, features: list[str], label: str, ties: list[str], folds: DataFrame, trees: int = 40, depth: int = 3, rate: float = 0.1, least: int = 20, bins: int = 32, half_life: float | None = None, recall: float = 0.35) -> DataFrame:
    """The test rows of every fold: `raw`, `p` (calibrated), `mode`, `threshold` (set on the guard) and `flagged`.

    Rows without a date or a label are left out. A fold whose part to fit has one class only has no rows. ties: columns that order
    rows of a date with equal scores.
    """
    both = cut(with_roles(df.where(F.col(day).isNotNull() & F.col(label).isNotNull()), day, folds))
    fit = both.where("role = 'fit'")
    two = fit.groupBy("fold").agg(F.count_distinct(label).alias("n")).where("n = 2").select("fold")
    fit = event_weights(fit.join(F.broadcast(two), "fold"), day, label, half_life)
    # bins are cut on the part that all folds share, the first one's, so later rows don't move them
    edges = boosting.bin_edges(fit.where(F.col("fold") == (fit.agg(F.min("fold")).first()[0] or 0)), features, bins) if two.head(1) else [[] for _ in features]
    forest = boosting.fit(fit, features, label, boosting.log_loss("weight"), "fold", ("weight",), trees, depth, bins, rate, least, edges=edges)
    scored = boosting.score(both.where("role <> 'fit'"), forest, "fold", "__margin").where("__margin IS NOT NULL")
    scored = cut(scored.withColumn("raw", 1 / (1 + F.exp(-F.col("__margin")))))
    tail = scored.where("role = 'calibration'")
    platt, isotonic = platt_fits(tail, "fold", "__margin", label), isotonic_fits(tail, "fold", "raw", label)
    each = cut(with_candidates(scored.where("role <> 'calibration'"), "fold", "__margin", "raw", platt, isotonic))
    guard = each.where("role = 'guard'")
    first = action_thresholds(guard.where("mode = 'raw'"), ["fold"], "p", label, recall).select("fold", F.col("threshold").alias("__t"))
    scores = guard_scores(guard.join(F.broadcast(first), "fold"), ["fold", "mode"], day, label, "__t", ties)
    modes = cut(chosen_modes(scores, "fold"))
    kept = each.join(F.broadcast(modes), ["fold", "mode"])
    final = action_thresholds(kept.where("role = 'guard'"), ["fold"], "p", label, recall).select("fold", "threshold")
    return kept.where("role = 'test'").join(F.broadcast(final), "fold").withColumn("flagged", F.col("p") >= F.col("threshold")).drop("role", "__margin")


def fold_report(oof: DataFrame, label: str) -> DataFrame:
    """Per fold, and over all (fold null): rows, events, Brier score, calibration error, area under the ROC curve, average
    precision, and precision, recall and false alarms of the flags."""
    both = oof.withColumn("__f", F.explode(F.array(F.col("fold").cast("int"), F.lit(-1)))).withColumn("y", F.col(label).cast("int"))
    hit, yes = F.col("flagged"), F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    m = both.groupBy("__f").agg(F.count("*").alias("n"), n(yes).alias("events"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), ratio(n(hit & yes), n(hit)).alias("precision"), ratio(n(hit & yes), n(yes)).alias("recall"), ratio(n(hit & ~yes), n(~yes)).alias("false_alarm_rate"))
    for more in (metrics.calibration_error(both, ["__f"], "p", "y"), metrics.roc_auc(both, ["__f"], "p", "y"), metrics.average_precision(both, ["__f"], "p", "y")):
        m = m.join(more, "__f", "left")
    return m.withColumn("fold", F.when(F.col("__f") >= 0, F.col("__f"))).drop("__f")

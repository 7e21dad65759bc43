"""Readiness of forecasts: panel weeks, scores, gates and cards; quality of a signal; matches of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, ratio
from .metrics import chance_of_a_hit

# What a forecast must reach, and the phases of a wave by kind.
GATES = {"precision": 0.70, "false_alarm_rate": 0.25, "pr_auc_lift": 1.15, "brier_ratio": 0.90, "ece": 0.05}
CARD = {"weeks": 12, "hit_rate": 0.60, "pr_auc_lift": 1.05, "ece": 0.05, "hit_lift": 0.05}
GROWING, QUIET = ("early_growth", "acceleration"), ("pre_wave", "post_wave", "unknown")


def _mean_of(parts: list[Column]) -> Column:
    """Mean of the parts that aren't null."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def reliability_score(brier: Column, ece: Column, log_loss: Column, covered_80: Column, covered_95: Column, n: Column, positives: Column, negatives: Column) -> Column:
    """Mean of how far each known measure stays below its limit, lessened where there are few rows or few of a class."""
    below = lambda x, limit: clamp(1 - x / limit)
    parts = [below(brier, 0.25), below(ece, 0.20), below(log_loss, 1.20), below(F.abs(covered_80 - 0.80), 0.30), below(F.abs(covered_95 - 0.95), 0.20)]
    support = F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.greatest(n / 40, F.least(positives, negatives) / 10)))
    return F.round(_mean_of(parts) * support, 4)


def truth_score(hit_rate: Column, lift: Column, precision_gain: Column, ece: Column, passed: Column, most_ece: float = CARD["ece"]) -> Column:
    """0 to 100: hits 35, lift over persistence 25, precision gained 20, calibration 10, gates 10 (4 if not passed)."""
    part = lambda x, weight: F.coalesce(clamp(x), F.lit(0.0)) * weight
    return F.round(part(hit_rate, 35) + part((lift - 1) / 2, 25) + part((precision_gain + 0.05) / 0.25, 20) + part((2 * most_ece - ece) / (2 * most_ece), 10) + F.when(passed, 10.0).otherwise(4.0), 1)


def quality_gates(precision: Column, false_alarm_rate: Column, pr_auc: Column, base_pr_auc: Column, brier: Column, climatology: Column, ece: Column, limits: dict[str, float] = GATES) -> Column:
    """Names of the gates that aren't passed; an unknown measure doesn't pass."""
    passed = {
        "precision": precision >= limits["precision"], "false_alarm_rate": false_alarm_rate <= limits["false_alarm_rate"], "pr_auc_lift": pr_auc >= limits["pr_auc_lift"] * base_pr_auc,
        "brier_ratio": brier <= limits["brier_ratio"] * climatology, "ece": ece <= limits["ece"],
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in passed.items()]))


def panel_weeks(df: DataFrame, keys: list[str], region: str, score: str, label: str, known: str, least: int = 14, k: int = 3) -> DataFrame:
    """One row per panel (keys): how many regions are scored and had an event, whether the k regions of the
    highest score met one, whether the k of the highest known value would have (null unless all scored regions
    have one), the chance of k drawn at random, and whether the panel can be judged: enough regions and an event."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    rows = rows.withColumn("__s", F.row_number().over(w.orderBy(F.desc(score), region))).withColumn("__k", F.row_number().over(w.orderBy(F.desc_nulls_last(known), region)))
    event = F.col(label) == 1
    m = rows.groupBy(*keys).agg(
        F.count("*").alias("scored"), F.sum(event.cast("long")).alias("events"), F.max(event & (F.col("__s") <= k)).alias("hit"), F.when(F.count(known) == F.count("*"), F.max(event & (F.col("__k") <= k))).alias("persistence_hit")
    )
    chance = F.when(F.col("events") > 0, chance_of_a_hit(F.col("scored"), F.col("events"), F.least(F.lit(k).cast("long"), F.col("scored"))))
    return m.withColumn("random_hit", chance).withColumn("evaluable", (F.col("scored") >= least) & (F.col("events") > 0))


def truth_card(weeks: DataFrame, measures: DataFrame, keys: list[str], limits: dict[str, float] = CARD) -> DataFrame:
    """One row per key: hit rates over the weeks that can be judged, what blocks, what warns, and a score.

    weeks: as `panel_weeks`. measures: keys, pr_auc, base_pr_auc, precision, base_precision, ece, passed. The
    score is at most 49 where something blocks, at most 79 where something warns, and 80 at least otherwise.
    """
    good = F.col("evaluable")
    m = weeks.groupBy(*keys).agg(
        F.sum(good.cast("long")).alias("weeks"), F.avg(F.when(good, F.col("hit").cast("double"))).alias("hit_rate"), F.avg(F.when(good, F.col("persistence_hit").cast("double"))).alias("persistence_rate"),
        F.avg(F.when(good, F.col("random_hit"))).alias("random_rate"), F.sum((~good & (F.col("events") > 0)).cast("long")).alias("rejected"),
    ).join(measures, keys, "left")
    hit, lift, gain, ece = F.col("hit_rate"), ratio(F.col("pr_auc"), F.col("base_pr_auc")), F.col("precision") - F.col("base_precision"), F.col("ece")
    over_persistence, over_random = hit - F.col("persistence_rate"), hit - F.col("random_rate")
    passed = F.coalesce("passed", F.lit(False))
    codes = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()]))
    blockers = codes({
        "too_few_weeks": F.col("weeks") < limits["weeks"], "no_weeks": hit.isNull(), "hit_rate_low": hit < limits["hit_rate"], "not_better_than_persistence": over_persistence < limits["hit_lift"],
        "pr_auc_not_better": lift < limits["pr_auc_lift"], "precision_below_persistence": gain < 0, "gates_not_passed": ~passed,
    })
    warnings = codes({
        "persistence_unknown": hit.isNotNull() & F.col("persistence_rate").isNull(), "not_better_than_random": over_random < limits["hit_lift"], "weeks_rejected": F.col("rejected") > 0, "pr_auc_unknown": lift.isNull(),
        "precision_unknown": gain.isNull(), "ece_unknown": ece.isNull(), "ece_high": ece > limits["ece"],
    })
    raw = truth_score(hit, lift, gain, ece, passed, limits["ece"])
    m = m.withColumns({"blockers": blockers, "warnings": warnings, "__raw": raw})
    blocked, warned = F.size("blockers") > 0, F.size("warnings") > 0
    readiness = F.when(blocked, "blocked").when(warned, "candidate").otherwise("go")
    score = F.when(blocked, F.least("__raw", F.lit(49.0))).when(warned, F.least("__raw", F.lit(79.0))).otherwise(F.greatest("__raw", F.lit(80.0)))
    return m.select(*keys, "weeks", "hit_rate", "persistence_rate", "random_rate", "blockers", "warnings", readiness.alias("readiness"), score.alias("score"))


def drift(n: Column, mape: Column, limit: float = 35.0, least: int = 5) -> Column:
    """Whether a model has drifted by its MAPE in per cent; null with too few rows to say."""
    return F.when(n >= least, mape > limit)


def false_triggers(df: DataFrame, keys: list[str], state: str, onset: str, spending: tuple[str, ...] = ("limited", "approved", "shadow_only")) -> DataFrame:
    """How often a budget state would have spent without an observed onset."""
    return df.groupBy(*keys).agg(F.sum((F.col(state).isin(*spending) & ~F.coalesce(onset, F.lit(False))).cast("long")).alias("false_triggers"))


def phase_match(a: Column, b: Column) -> Column:
    """How well the phase of a leading signal (b) fits that of the cases (a)."""
    return (
        F.when(a == b, 1.0).when(a.isin(*GROWING) & b.isin(*GROWING), 0.85).when(a.isin(*QUIET) & b.isin(*QUIET), 0.70)
        .when((a == "early_growth") & (b == "peak_plateau"), 0.65).when((a == "decline") & (b == "peak_plateau"), 0.55).otherwise(0.35)
    )


def signal_quality(df: DataFrame, day: Column, seen: Column, available: Column, covered: Column, sites: Column, value: Column, low: Column, high: Column, below_limit: Column) -> DataFrame:
    """Rows with six scores of a measured signal, the multiplier made of them and the flags raised."""
    fresh_days = F.greatest(F.datediff(day, F.coalesce(available, seen)), F.lit(0))
    width = F.when(low.isNotNull() & high.isNotNull() & value.isNotNull(), F.greatest(high - low, F.lit(0.0)) / F.greatest(F.abs(value), F.lit(1e-6)))
    no_sites = F.coalesce(sites <= 0, F.lit(True))
    parts = {
        "freshness": clamp(1 - fresh_days / 28), "coverage": F.coalesce(clamp(covered / 0.25), F.lit(0.55)), "site_score": F.when(no_sites, 0.50).otherwise(clamp(sites / 40)),
        "certainty": F.coalesce(clamp(1 - width / 3), F.lit(0.65)), "detection": F.when(below_limit.isNull(), 0.80).when(below_limit, 0.25).otherwise(1.0),
    }
    out = df.withColumns(parts)
    out = out.withColumn("consistency", F.when(no_sites, 0.55).otherwise(clamp(0.5 * F.col("site_score") + 0.5 * F.col("certainty"))))
    weights = {"freshness": 0.24, "coverage": 0.20, "site_score": 0.16, "certainty": 0.18, "detection": 0.10, "consistency": 0.12}
    rules = {
        "available_time_missing": available.isNull(), "stale": fresh_days > 21, "coverage_missing": covered.isNull(), "low_coverage": covered < 0.05, "sites_missing": no_sites, "few_sites": ~no_sites & (sites < 8),
        "interval_missing": low.isNull() | high.isNull(), "wide_interval": width > 1.5, "below_detection": below_limit, "detection_missing": below_limit.isNull(),
    }
    flags = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(code)) for code, on in rules.items()]))
    return out.withColumn("quality", clamp(sum(w * F.col(c) for c, w in weights.items()))).withColumn("flags", flags)


def greedy_match(df: DataFrame, keys: list[str], order: str, alert: str, spike: str, ahead: int = 4) -> DataFrame:
    """Per series: alerts matched one to one with spikes of the same or the next `ahead` steps, each alert in
    turn with the first spike that is still free; hits, false alarms, misses and the median lead in steps.

    Matches move forward only, so a fold over the alerts that keeps the last matched spike does it. A series is
    held as arrays of step numbers: it has a calendar's length.
    """
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    lists = df.withColumn("__i", step).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col(alert), F.col("__i")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col(spike), F.col("__i")))).alias("s"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("leads"))

    def take(held, i):
        free = F.array_min(F.filter("s", lambda x: (x >= i) & (x > held["last"]) & (x <= i + ahead)))
        return F.struct(F.coalesce(free, held["last"]).alias("last"), F.when(free.isNotNull(), F.array_append(held["leads"], free - i)).otherwise(held["leads"]).alias("leads"))

    m = lists.withColumn("leads", F.aggregate("a", start, take)["leads"])
    hits = F.size("leads").cast("long")
    ranked = F.sort_array("leads")
    middle = (F.element_at(ranked, F.ceil(hits / 2).cast("int")) + F.element_at(ranked, (F.floor(hits / 2) + 1).cast("int"))) / 2.0
    return m.select(*keys, hits.alias("hits"), (F.size("a") - hits).alias("false_alarms"), (F.size("s") - hits).alias("misses"), F.when(hits > 0, middle).alias("median_lead"))


def vintage_coverage(panel: DataFrame, runs: DataFrame, issued: str, target: str, run_target: str, known: str, run_at: str) -> DataFrame:
    """Each issue date with its first target and whether a run for that target was known by then. Runs are reduced
    to the earliest time of each target first, so the join is one row to one."""
    dates = panel.groupBy(issued).agg(F.min(target).alias(target))
    first = runs.where(F.col(known).isNotNull() & F.col(run_at).isNotNull()).groupBy(F.col(run_target).alias(target)).agg(F.min(F.greatest(known, run_at)).alias("__first"))
    return dates.join(first, target, "left").select(issued, target, F.coalesce(F.col("__first") <= F.col(issued), F.lit(False)).alias("covered"))


def phase_transform(df: DataFrame, keys: list[str], age: str, weight: str, q: float, c: float = 0.0) -> DataFrame:
    """Per key the logarithm of the kernel sum of weight * exp(-age q + age (age - 1) c / 2), over positive weights."""
    term = F.when(F.col(weight) > 0, F.log(weight) - F.col(age) * q + 0.5 * F.col(age) * (F.col(age) - 1) * c)
    top = df.withColumn("__t", term).groupBy(*keys).agg(F.max("__t").alias("__m"), F.collect_list("__t").alias("__all"))
    return top.select(*keys, (F.col("__m") + F.log(F.aggregate("__all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__m"))))).alias("log_phase"))


def laplacian(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """Cells (i, j, value) of the degree matrix less the symmetrised weights of a directed graph."""
    half = edges.select(F.col(src).alias("i"), F.col(dst).alias("j"), (F.col(weight) / 2).alias("w")).unionByName(edges.select(F.col(dst).alias("i"), F.col(src).alias("j"), (F.col(weight) / 2).alias("w")))
    both = half.groupBy("i", "j").agg(F.sum("w").alias("w"))
    degree = both.groupBy("i").agg(F.sum("w").alias("w")).select("i", F.col("i").alias("j"), "w")
    return degree.unionByName(both.select("i", "j", (-F.col("w")).alias("w"))).groupBy("i", "j").agg(F.sum("w").alias("value"))


def map_rows(values: DataFrame, links: DataFrame, unit: str, region: str, weight: str, value: str) -> DataFrame:
    """Latent values of regions as observed by units: weights of each unit's regions, made to sum to one."""
    met = links.join(values, region).groupBy(unit).agg(F.sum(F.col(weight) * F.col(value)).alias("__v"))
    total = links.groupBy(unit).agg(F.sum(weight).alias("__w"))
    return total.join(met, unit).select(unit, (F.col("__v") / F.when(F.col("__w") > 0, F.col("__w")).otherwise(1.0)).alias("mapped"))


def stable_hash(columns: list[str]) -> Column:
    """Sixteen hexadecimal digits of the SHA-256 of a row's JSON, its names sorted."""
    return F.left(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), F.lit(16))

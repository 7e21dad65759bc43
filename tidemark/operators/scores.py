"""Rule scores, quantile blends, distributions and calibration helpers as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, ratio


def weighted_available(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the parts that are known; null where none is."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in parts), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(c, F.lit(0.0)) * w for w, c in parts), F.lit(0.0)) / total)


def agreement(signals: list[Column], band: float) -> Column:
    """Share of the signals outside the neutral band that point the way most of them do; null if all are in it."""
    ups = sum(((s > band).cast("int") for s in signals), F.lit(0))
    downs = sum(((s < -band).cast("int") for s in signals), F.lit(0))
    return ratio(F.greatest(ups, downs), ups + downs)


def confidence(parts: list[Column]) -> Column:
    """1 - 2 deviations of the parts, within 0 and 1."""
    values = F.array(*parts)
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return clamp(1 - 2 * F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n))


def stage(probability: Column, trend: Column, agreed: Column) -> Column:
    """What a signal asks for."""
    return F.when((probability >= 0.6) & (trend > 0) & (agreed >= 0.6), "activate").when((probability >= 0.4) | (trend > 0.1), "prepare").otherwise("watch")


def alignment(short: Column, long: Column, high: float = 0.5) -> Column:
    """Whether two horizons agree."""
    return F.when((short >= high) & (long >= high), "sustained").when(short >= high, "fading").when(long >= high, "building").otherwise("quiet")


def blend(a: Column, b: Column, weight: float) -> Column:
    return a * weight + b * (1 - weight)


def performance_weights(df: DataFrame, keys: list[str], loss: str) -> DataFrame:
    """Weights of candidates in inverse proportion to their loss."""
    inverse = ratio(F.lit(1.0), F.greatest(F.col(loss), F.lit(1e-9)))
    return df.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(*keys)))


def shifted_negative_binomial(days: int, shift: int, mean: float, size: float) -> list[float]:
    """Delay kernel: a negative binomial moved by a shift, cut at `days` and scaled to one."""
    p = size / (size + mean)
    raw = [0.0 if k < shift else math.exp(math.lgamma(k - shift + size) - math.lgamma(size) - math.lgamma(k - shift + 1) + size * math.log(p) + (k - shift) * math.log1p(-p)) for k in range(days)]
    return [x / sum(raw) for x in raw]


def growth_rate(value: Column, before: Column, days: int) -> Column:
    """Log growth per day with one added to both."""
    return (F.log1p(value) - F.log1p(before)) / days


def sample_crps(y: Column, samples: Column) -> Column:
    """Mean distance to the samples less half their mean distance from each other."""
    n = F.size(samples)
    near = F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / n
    apart = F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.aggregate(samples, F.lit(0.0), lambda b, z: b + F.abs(x - z))) / (n * n)
    return near - apart / 2


def rank_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Dense rank scaled to 0 and 1; one half where all are equal."""
    w = Window.partitionBy(*keys)
    d = F.dense_rank().over(w.orderBy(value))
    top = F.size(F.collect_set(value).over(w))
    return df.where(F.col(value).isNotNull()).withColumn("rank_score", F.coalesce(ratio(d - 1, top - 1), F.lit(0.5)))


def regret(df: DataFrame, issue: list[str], share: str, gain: str) -> DataFrame:
    """Of each issue's allocation: the gain it captures, the best single region's gain and the regret."""
    return df.groupBy(*issue).agg(F.sum(F.col(share) * F.col(gain)).alias("captured"), F.max(gain).alias("best")).withColumn("regret", F.col("best") - F.col("captured"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive x: Stirling's series after eight steps up, in doubles, since
    their product passes 64 bits from counts of a few hundred on."""
    x = x.cast("double")
    z = x + 8
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def negative_binomial_log_p(k: Column, mean: Column, size: Column) -> Column:
    """Log probability of a count with a mean and a dispersion size."""
    return log_gamma(k + size) - log_gamma(size) - log_gamma(k + 1) + size * F.log(size / (size + mean)) + k * F.log(mean / (size + mean))


def student_log_p(x: Column, centre: Column, scale: Column, df: float) -> Column:
    """Log density of Student's t with a centre and a scale; null where the scale is zero."""
    z = ratio(x - centre, scale)
    nu = F.lit(float(df))
    return log_gamma((nu + 1) / 2) - log_gamma(nu / 2) - 0.5 * F.log(nu * math.pi) - F.log(scale) - (nu + 1) / 2 * F.log1p(z * z / nu)


def first_category(text: Column, words: list[tuple[str, list[str]]], other: str) -> Column:
    """The first category, in the order given, one of whose words the text has; case doesn't count."""
    out = None
    for name, keys in words:
        hit = F.lit(False)
        for key in keys:
            hit |= F.contains(F.lower(text), F.lit(key.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def scale_fit(df: DataFrame, keys: list[str], y: str, p: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Slope and intercept of truth on forecast, the slope held within bounds; kept only where the error falls."""
    m = df.groupBy(*keys).agg(F.avg(y).alias("my"), F.avg(p).alias("mp"), F.covar_pop(y, p).alias("c"), F.var_pop(p).alias("v"), F.var_pop(y).alias("vy"), F.avg((F.col(p) - F.col(y)) ** 2).alias("before"))
    b = F.greatest(F.least(ratio(F.col("c"), F.nullif(F.col("v"), F.lit(0.0))), F.lit(high)), F.lit(low))
    m = m.withColumn("slope", b).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mp"))
    after = F.col("vy") - 2 * F.col("slope") * F.col("c") + F.col("slope") ** 2 * F.col("v")
    better = F.coalesce(after < F.col("before"), F.lit(False))
    return m.select(*keys, F.when(better, F.col("slope")).otherwise(1.0).alias("slope"), F.when(better, F.col("intercept")).otherwise(0.0).alias("intercept"), better.alias("improves"))


def dirichlet_counts(df: DataFrame, keys: list[str], count: str, share: str, kappa: float) -> DataFrame:
    """Log-probability of each key's counts under a Dirichlet-multinomial of the shares and a concentration."""
    a, n = kappa * F.col(share), F.col(count)
    total = F.sum(n)
    parts = F.sum(log_gamma(n + a) - log_gamma(a)) - F.sum(log_gamma(n + 1))
    m = df.groupBy(*keys).agg(total.alias("__n"), parts.alias("__p"))
    return m.select(*keys, (log_gamma(F.col("__n") + 1) + F.lit(math.lgamma(kappa)) - log_gamma(F.col("__n") + kappa) + F.col("__p")).alias("log_p"))


def persistence_quantiles(df: DataFrame, keys: list[str], order: str, value: str, levels: tuple[float, ...]) -> DataFrame:
    """Per key the last value moved by the quantiles of all steps seen, not below zero."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    m = df.withColumn("__s", step).groupBy(*keys).agg(F.max_by(value, order).alias("__v"), F.percentile("__s", F.array(*[F.lit(p) for p in levels])).alias("__q"))
    return m.select(*keys, F.transform("__q", lambda q: F.greatest(F.col("__v") + q, F.lit(0.0))).alias("quantiles"))


#: Budget rules that a model's allocation is held against; fixed names of the reports.
STRATEGIES = ("model", "static", "population", "current", "growth", "persistence")


def strategy_metrics(df: DataFrame, issue: list[str], region: str, known: str, expected: str, actual: str, population: str, probability: str, top: int = 3) -> DataFrame:
    """Per issue and strategy, the oracle's included: `capture`, the share of all rises that its weights meet, `regret`, what the
    oracle captures more, and `hits`, the share of rising regions among its first `top`.

    A rise is the actual value's over the known one, if any. Weights are scores over their sum, or all alike where that is
    zero: model (probability times expected rise), static, population, current and persistence (both the known value) and
    growth (the expected rise). Issues with less than two regions or without any rise are left out; nulls count as zero,
    a null population as one.
    """
    none = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rise, growth = F.greatest(none(actual) - none(known), F.lit(0.0)), F.greatest(none(expected) - none(known), F.lit(0.0))
    scores = {"model": none(probability) * (growth + 1e-6), "static": F.lit(1.0), "population": F.coalesce(F.col(population).cast("double"), F.lit(1.0)), "current": none(known), "growth": growth, "persistence": none(known), "oracle": rise}
    own = Window.partitionBy(*issue)
    rows = df.withColumn("__rise", rise).withColumns({"__total": F.sum("__rise").over(own), "__n": F.count("*").over(own)}).where("__total > 0 AND __n > 1")
    each = rows.select(*issue, region, "__rise", "__total", "__n", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.greatest(c, F.lit(0.0)).alias("score"), c.alias("order")) for s, c in scores.items()])).alias("x")).select("*", "x.*")
    w = Window.partitionBy(*issue, "strategy")
    held = each.withColumns({"__sum": F.sum("score").over(w), "__rank": F.row_number().over(w.orderBy(F.desc("order"), region))})
    weight = F.when(F.col("__sum") > 0, F.col("score") / F.col("__sum")).otherwise(1 / F.col("__n"))
    out = held.groupBy(*issue, "strategy").agg((F.sum(weight * F.col("__rise")) / F.first("__total")).alias("capture"), F.avg(F.when(F.col("__rank") <= top, (F.col("__rise") > 0).cast("double"))).alias("__hits"))
    best = F.max(F.when(F.col("strategy") == "oracle", F.col("capture"))).over(own)
    out = out.withColumn("regret", F.greatest(best - F.col("capture"), F.lit(0.0)))
    return out.select(*issue, "strategy", "capture", "regret", F.when(F.col("strategy") == "oracle", 1.0).otherwise(F.col("__hits")).alias("hits"))


def strategy_report(metrics: DataFrame, issue: list[str]) -> DataFrame:
    """Strategies over all issues: means, `reduction` (a strategy's regret less the model's) and `rank` by regret among all but
    the oracle, the model first of equals."""
    means = metrics.groupBy("strategy").agg(F.count("*").alias("issues"), *[F.round(F.avg(c), 6).alias(c) for c in ("capture", "regret", "hits")])
    all_ = Window.partitionBy(F.lit(0))  # a row per strategy
    model = F.max(F.when(F.col("strategy") == "model", F.col("regret"))).over(all_)
    rank = F.row_number().over(all_.orderBy(F.col("strategy") == "oracle", "regret", F.col("strategy") != "model", "strategy"))
    return means.withColumn("reduction", F.round(F.col("regret") - model, 6)).withColumn("rank", F.when(F.col("strategy") != "oracle", rank))


def signal_stage(decision: Column, probability: Column, confidence: Column, freshness: Column, revision_risk: Column, trend: Column, support: Column, signals: Column, direction: Column, limits: dict[str, float], least_signals: int = 2, early: float = 0.06) -> Column:
    """activate, prepare, prepare_early or watch, by eight inputs and the direction of what agrees.

    limits: activate_ and prepare_ score, probability, confidence, freshness, revision_risk (at most), trend and agreement.
    With less than `least_signals` signals agreement is not asked for; an early preparation, whose score may be lower by
    `early` and which asks for no probability, then needs them to point up. A null input fails its rule.
    """
    few = signals < least_signals

    def passes(level: str, score: float, with_probability: bool, agreed: Column) -> Column:
        rule = (decision >= score) & (confidence >= limits[f"{level}_confidence"]) & (freshness >= limits[f"{level}_freshness"]) & (revision_risk <= limits[f"{level}_revision_risk"]) & (trend >= limits[f"{level}_trend"]) & agreed
        return F.coalesce(rule & (probability >= limits[f"{level}_probability"]) if with_probability else rule, F.lit(False))

    agreed = {level: few | (support >= limits[f"{level}_agreement"]) for level in ("activate", "prepare")}
    lower = (few & (F.lower(direction) == "up")) | (~few & agreed["prepare"])
    return (
        F.when(passes("activate", limits["activate_score"], True, agreed["activate"]), "activate").when(passes("prepare", limits["prepare_score"], True, agreed["prepare"]), "prepare")
        .when(passes("prepare", max(0.0, limits["prepare_score"] - early), False, lower), "prepare_early").otherwise("watch")
    )

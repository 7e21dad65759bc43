"""A training set of its own for every row to forecast, without refitting and without pairs.

What is known at a row's forecast time is a prefix of all rows in the order in which they become available. So the sums that a
ridge regression needs are running sums along that order: rows to learn from and rows to forecast are laid on one
time line per key, cut into stretches; sums run inside a stretch, and what earlier stretches add comes from their
totals. A row's fit is then a look-up in the sums and a small solve in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stretch(at: Column, days: int) -> Column:
    return F.floor(F.datediff(at, F.lit("1970-01-01")) / days)


def with_running(ask: DataFrame, learn: DataFrame, keys: list[str], at: str, sums: list[str], largest: list[str] = (), days: int = 28) -> DataFrame:
    """Rows of `ask` with the sums (and greatest values) of the columns of all rows of `learn` of their key at or before their
    day `at`. Rows without a day are left out on either side. No task holds more than a key's stretch of so many days."""
    learn = learn.where(F.col(at).isNotNull()).select(*keys, at, *sums, *largest)
    ask = ask.where(F.col(at).isNotNull()).drop(*sums, *largest)
    one = lambda df, asked: df.withColumn("__asked", F.lit(asked)).withColumn("__s", _stretch(F.col(at), days))
    line = one(ask, 1).unionByName(one(learn, 0), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__s").orderBy(at, "__asked").rowsBetween(Window.unboundedPreceding, 0)
    held = line.withColumns({f"__in_{c}": F.sum(c).over(inside) for c in sums} | {f"__in_{c}": F.max(c).over(inside) for c in largest}).where("__asked = 1")
    totals = one(learn, 0).groupBy(*keys, "__s").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums], *[F.max(c).alias(f"__t_{c}") for c in largest])
    # a row for each stretch of a key that either side has
    spans = held.select(*keys, "__s").distinct().join(totals, [*keys, "__s"], "full")
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "__s", *[F.sum(f"__t_{c}").over(before).alias(f"__b_{c}") for c in sums], *[F.max(f"__t_{c}").over(before).alias(f"__b_{c}") for c in largest])
    both = held.join(carried, [*keys, "__s"])
    add = lambda c: F.coalesce(f"__in_{c}", F.lit(0)) + F.coalesce(f"__b_{c}", F.lit(0))
    return both.select(*ask.columns, *[add(c).alias(c) for c in sums], *[F.greatest(f"__in_{c}", f"__b_{c}").alias(c) for c in largest])


def solved(a: list[list[Column]], b: list[Column]) -> Column:
    """x of a x = b as an array, for a symmetric positive definite a: each row is cleared by each pivot in turn."""
    n = len(b)
    matrix = F.array(*[F.array(*[c.cast("double") for c in (*row, y)]) for row, y in zip(a, b, strict=True)])

    def clear(m: Column, p: Column) -> Column:
        top = F.get(m, p)
        pivot = F.get(top, p)
        unit = F.transform(top, lambda v: F.try_divide(v, pivot))
        return F.transform(m, lambda row, i: F.when(i == p, unit).otherwise(F.zip_with(row, unit, lambda v, u: v - u * F.get(row, p))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, clear)
    return F.transform(done, lambda row: F.get(row, F.lit(n)))


def rowwise_walk_forward(df: DataFrame, keys: list[str], day: str, available: str, features: list[str], y: str, horizon: int, least: int = 20, strength: float = 1.0, most: float = 2.5, days: int = 28) -> DataFrame:
    """Each row with a forecast of its y from a ridge regression on the rows of its key whose y was available `horizon` days
    before its own day: `n_train`, `forecast`, `sigma`, bands of 80 and 95 per cent, and `mean`, the plain mean of what was known.

    Features are standardised by the rows known, and the ridge is `strength` on that scale. Forecasts lie within zero and
    `most` times the greatest y known. Rows to learn from need all features, y and `available`; a row with fewer than
    `least` of them, or with a null feature, has null forecasts. Every row with a day is returned.
    """
    k = len(features)
    x = [F.col(c).cast("double") for c in features]
    t = F.col(y).cast("double")
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    learn = df.dropna(subset=[*features, y, available]).withColumns(
        {"__at": F.to_date(available), "__n": F.lit(1.0), "__y": t, "__yy": t * t, "__top": t} | {f"__x{i}": x[i] for i in range(k)} | {f"__xy{i}": x[i] * t for i in range(k)} | {f"__xx{i}_{j}": x[i] * x[j] for i, j in cells}
    )
    names = ["__n", "__y", "__yy", *(f"__x{i}" for i in range(k)), *(f"__xy{i}" for i in range(k)), *(f"__xx{i}_{j}" for i, j in cells)]
    held = with_running(df.withColumn("__at", F.date_sub(F.to_date(day), horizon)), learn, keys, "__at", names, ["__top"], days)
    n, c = F.col("__n"), lambda name: F.col(f"__{name}")
    over = lambda a: F.try_divide(a, n)
    held = held.withColumns({f"__m{i}": over(c(f"x{i}")) for i in range(k)} | {"mean": over(c("y"))})
    # sums of squares about the means, and a feature's scale (1 where it doesn't vary)
    held = held.withColumns({f"__c{i}_{j}": c(f"xx{i}_{j}") - n * c(f"m{i}") * c(f"m{j}") for i, j in cells} | {f"__b{i}": c(f"xy{i}") - n * c(f"m{i}") * F.col("mean") for i in range(k)} | {"__cyy": F.greatest(c("yy") - n * F.col("mean") * F.col("mean"), F.lit(0.0))})
    held = held.withColumns({f"__s{i}": F.when(c(f"c{i}_{i}") > 1e-9 * F.greatest(c(f"xx{i}_{i}"), F.lit(1e-12)), F.sqrt(over(c(f"c{i}_{i}")))).otherwise(1.0) for i in range(k)})
    cell = lambda i, j: c(f"c{min(i, j)}_{max(i, j)}") / (c(f"s{i}") * c(f"s{j}"))
    a = [[cell(i, j) + (strength if i == j else 0.0) for j in range(k)] for i in range(k)]
    b = [c(f"b{i}") / c(f"s{i}") for i in range(k)]
    held = held.withColumn("__beta", F.when(n >= least, solved(a, b)))
    beta = [F.get("__beta", F.lit(i)) for i in range(k)]
    guess = sum((beta[i] * (x[i] - c(f"m{i}")) / c(f"s{i}") for i in range(k)), F.col("mean"))
    lost = c("cyy") - 2 * sum((beta[i] * b[i] for i in range(k)), F.lit(0.0)) + sum((beta[i] * beta[j] * cell(i, j) for i in range(k) for j in range(k)), F.lit(0.0))
    out = held.withColumn("forecast", F.when(guess.isNotNull(), F.least(F.greatest(guess, F.lit(0.0)), most * F.greatest(c("top"), F.lit(0.0)))))
    out = out.withColumn("sigma", F.when(F.col("forecast").isNotNull(), F.sqrt(over(F.greatest(lost, F.lit(0.0))))))
    band = {f"{side}_{p}": F.when(F.col("forecast").isNotNull(), F.greatest(F.col("forecast") + s * z * F.col("sigma"), F.lit(0.0))) for p, z in ((80, 1.28), (95, 1.96)) for side, s in (("low", -1), ("high", 1))}
    return out.withColumns(band).select(*df.columns, n.cast("long").alias("n_train"), "mean", "forecast", "sigma", *band)

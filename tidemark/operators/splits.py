"""Walk-forward folds, event labels, nowcasts and training frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, ratio


def folds(df: DataFrame, day: str, least_train: int, test: int, most: int) -> DataFrame:
    """Expanding folds over the distinct dates: fold, last training date, first and last test date.

    The dates are a calendar, so numbering them takes one small task.
    """
    dates = df.select(day).distinct()
    numbered = dates.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)))
    ends = numbered.select(F.col("n"), F.col(day).alias("d"))
    starts = ends.where((F.col("n") > least_train) & ((F.col("n") - least_train - 1) % test == 0)).select(((F.col("n") - least_train - 1) / test).cast("long").alias("fold"), F.col("n").alias("s")).where(F.col("fold") < most)
    held = starts.join(ends, (F.col("n") >= F.col("s") - 1) & (F.col("n") < F.col("s") + test))
    return held.groupBy("fold").agg(F.max(F.when(F.col("n") < F.col("s"), F.col("d"))).alias("train_end"), F.min(F.when(F.col("n") >= F.col("s"), F.col("d"))).alias("test_start"), F.max(F.when(F.col("n") >= F.col("s"), F.col("d"))).alias("test_end"))


def assign_folds(df: DataFrame, day: str, spans: DataFrame) -> DataFrame:
    """Every row in each fold it has a part in: `role` train or test. Folds are few and bounded by `most`."""
    in_test = F.col(day).between(F.col("test_start"), F.col("test_end"))
    return df.join(F.broadcast(spans), F.col(day) <= F.col("test_end")).where((F.col(day) <= F.col("train_end")) | in_test).withColumn("role", F.when(in_test, "test").otherwise("train")).drop("train_end", "test_start", "test_end")


def event_label(now: Column, then: Column, baseline: Column, mad: Column, tau: float, kappa: float, floor: float) -> Column:
    """1 where the value jumps by tau on the log scale and clears the baseline by kappa deviations and a floor."""
    jump = F.log1p(F.greatest(then, F.lit(0.0))) - F.log1p(F.greatest(now, F.lit(0.0)))
    return F.when(then.isNotNull() & now.isNotNull(), ((jump >= tau) & (then >= F.greatest(F.lit(floor), baseline + kappa * mad))).cast("int"))


def nowcast(value: Column, age_days: Column, completeness: list[tuple[int, float]]) -> Column:
    """The value over the completeness of its age's bucket (largest age first that still holds it)."""
    share = F.lit(1.0)
    for most_age, part in sorted(completeness, reverse=True):
        share = F.when(age_days <= most_age, F.lit(part)).otherwise(share)
    return value / share


def completeness_by_age(df: DataFrame, keys: list[str], event: str, published: str, ages: list[int]) -> DataFrame:
    """Share of rows published within each age in days; the late part is what a nowcast must add."""
    late = F.datediff(published, event)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[clamp(ratio(F.sum((late <= a).cast("long")), F.count("*"))).alias(f"within_{a}") for a in ages])

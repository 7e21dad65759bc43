"""Places in one global order, from the totals of its range partitions and never from a single task over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Columns that `placed` adds to its rows.
RUN, TIE, POS, BEFORE, ALL = "__run", "__tie", "__pos", "__before", "__all"


def sorted_runs(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows dealt out by ranges of their order and written, with the number of their run. Rows that tie have a
    number of their own, so that any count of equal rows is split over runs too. `rows` should be narrow and read
    from a table: finding the ranges reads them once more."""
    numbered = rows.withColumn(TIE, F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*order, F.col(TIE))
    return cut(dealt.withColumn(RUN, F.spark_partition_id()))


def placed(rows: DataFrame, order: list[Column], groups: tuple[str, ...] = (), size: str | None = None) -> DataFrame:
    """Each row with `__pos`, the rows of its group before it, `__all`, the rows of its group, and, given a size,
    `__before`, the sum of the sizes before it.

    Each run of the order is summed by itself. What stands before a run comes from the totals of the runs, a row for
    each run and group in it. Groups must not be null; the order must begin with them.
    """
    runs = sorted_runs(rows, order)
    mine, measure = [*groups, RUN], F.col(size) if size else F.lit(0)
    earlier = Window.partitionBy(*groups).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy(*mine).agg(F.count("*").alias("__n"), F.sum(measure).cast("long").alias("__size"))
    zero = F.lit(0).cast("long")
    starts = totals.select(*mine, F.coalesce(F.sum("__n").over(earlier), zero).alias("__n0"), F.coalesce(F.sum("__size").over(earlier), zero).alias("__size0"), F.sum("__n").over(Window.partitionBy(*groups)).alias(ALL))
    inside = Window.partitionBy(*mine).orderBy(*order, TIE)
    held = runs.withColumn("__row", F.row_number().over(inside))
    if size:
        held = held.withColumn("__sum", F.coalesce(F.sum(measure).over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero))
    out = held.join(starts, mine).withColumn(POS, F.col("__n0") + F.col("__row") - 1)
    if size:
        out = out.withColumn(BEFORE, F.col("__size0") + F.col("__sum")).drop("__sum")
    return out.drop("__row", "__n0", "__size0", RUN, TIE)

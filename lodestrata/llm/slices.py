"""Cuts groups too large for one task into slices by quantiles of their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a group is cut.
HOT_ROWS = 200_000
#: Slices of such a group.
SLICES = 256


def with_slices(df: DataFrame, group: list[str], order: str, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """``df`` with ``_slice`` (int): 0 in ordinary groups, else the place of ``order`` (double) among quantiles.

    Equal values share a slice. Whether any group is that large is counted
    with partial aggregation; only then the quantile sketches are made.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows"))
    if not sizes.where(F.col("_rows") > hot_rows).take(1):
        return df.withColumn("_slice", F.lit(0))
    cuts = df.groupBy(*group).agg(
        F.when(F.count("*") > hot_rows, F.percentile_approx(order, [i / slices for i in range(1, slices)], 10_000)).otherwise(F.array().cast("array<double>")).alias("_cuts")
    )
    return df.join(cuts, group).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")


def running_before(df: DataFrame, group: list[str], order: str, amount: str, name: str, descending: bool = False) -> DataFrame:
    """``df`` (with ``_slice``) with ``name``: the sum of ``amount`` over rows before each in its group.

    Rows must differ in ``order`` within a group. Slices are summed apart and
    the totals of the slices before are added.
    """
    by = F.col(order).desc() if descending else F.col(order)
    across = F.col("_slice").desc() if descending else F.col("_slice")
    inside = Window.partitionBy(*group, "_slice").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(across).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_slice").agg(F.sum(amount).alias("_total"))
    offsets = totals.select(*group, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return (
        df.withColumn("_within", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(offsets, [*group, "_slice"])
        .withColumn(name, F.col("_within") + F.col("_offset"))
        .drop("_within", "_offset")
    )

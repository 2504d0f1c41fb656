"""Last-writer-wins reduction that moves small results instead of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, key: str, order: str, *values: str | Column) -> DataFrame:
    """For each ``key`` the ``values`` of the row with the largest ``order``.

    Rows whose ``order`` is null lose against all others; among equal orders
    any one row counts. Callers evaluate per-row work *before* this reduction,
    so that only its (small) result is shuffled, with partial aggregation on
    the map side.
    """
    packed = F.struct(*values)
    return (
        df.groupBy(F.col(key))
        .agg(F.max_by(packed, F.coalesce(F.col(order), F.lit(-(2**63)).cast("long"))).alias("_latest"))
        .select(key, "_latest.*")
    )

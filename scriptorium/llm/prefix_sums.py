"""Running totals within groups of which one may hold most rows.

Rows are dealt into buckets by the leading part of their order key, so that bucket order is row order. Each bucket is
totalled on its own, then the (few) bucket totals of a group, then both are added: no task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_start(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before, by (bucket, order).

    ``group`` and ``bucket`` hold no nulls. Rows that tie in ``order`` follow each other in any order, so ties should
    only be between rows that are equal in all that matters."""
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("__total"))
    starts = totals.select(group, bucket, F.coalesce(F.sum("__total").over(outer), F.lit(0)).alias("__base"))
    within = df.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(starts, [group, bucket]).withColumn(out, F.col("__base") + F.col("__inner")).drop("__base", "__inner")

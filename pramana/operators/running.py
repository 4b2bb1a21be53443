"""Running sums and order statistics of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of a group's range of values that are sorted apart.
BUCKETS = 1024


def running_start(df: DataFrame, group: str, order: list[str], value: str, bucket: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group before the row, by (bucket, order).

    ``bucket`` is a column whose order agrees with ``order`` and of which none holds many rows: its sums are added up first,
    then the rows within each bucket, so that no task sees a whole group.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(before, [group, bucket]).withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__before")


def counted(df: DataFrame, group: str, value: str, *more) -> DataFrame:
    """``group, value, c, before`` and the aggregates ``more``: how many rows have each value, and how many a smaller one. Nulls are left out.

    Rows are counted by value first; different values are sorted in parts of the group's range.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"), *more)
    ends = c.groupBy(group).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    wide = F.col("__high") - F.col("__low")
    part = F.when(wide > 0, F.floor((F.col(value) - F.col("__low")) / F.greatest(wide.cast("double"), F.lit(1e-300)) * BUCKETS)).otherwise(0)
    return running_start(c.join(ends, group).withColumn("__part", part), group, [value], "c", "__part", "before").drop("__low", "__high", "__part")


def medians(df: DataFrame, group: str, value: str, out: str = "median") -> DataFrame:
    """``group, out``: the mean of the two middle values of each group."""
    c = counted(df, group, value)
    n = c.groupBy(group).agg(F.sum("c").alias("n"))
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("c")), F.col(value)))
    mid = c.join(n, group).groupBy(group).agg(at(F.floor((F.col("n") - 1) / 2)).alias("a"), at(F.floor(F.col("n") / 2)).alias("b"))
    return mid.select(group, ((F.col("a") + F.col("b")) / 2).alias(out))

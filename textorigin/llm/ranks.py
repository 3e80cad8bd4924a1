"""Running sums along a hash order, for groups of any size: a group is cut into ranges of the hash, never put into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def bits_for(rows: int, per_bucket: int = 20_000) -> int:
    """Ranges as a power of two, so that one holds about ``per_bucket`` of ``rows``; at least 64."""
    return min(24, max(6, (max(rows, 1) // per_bucket).bit_length() + 3))


def running(df: DataFrame, groups: Sequence[str], order: str, value: str, out: str, bits: int, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come earlier by ``order`` (a 64-bit hash), then ``ties``.

    ``groups`` are columns without nulls. Rows that agree in ``order`` and ``ties`` are interchangeable.
    """
    marked = df.withColumn("_range", F.shiftrightunsigned(F.col(order), 64 - bits).cast("int"))
    sums = marked.groupBy(*groups, "_range").agg(F.sum(value).alias("_sum"))
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*groups, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = marked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(offsets, [*groups, "_range"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")

"""Ranks, running sums and quantiles that do not put a whole group into one task.

A label, a source or an experiment cell may hold a third of all rows, so a plain window over it would
end in a single task. Here every group, of any size, is cut into ordered buckets; windows run inside buckets and the
sums of the earlier buckets are added afterwards. The results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import md5_order
from ..session import cut_lineage
from .selection import exact_quantiles


def _group(groups: Sequence[str]) -> Column:
    """Groups as one null-safe key."""
    return F.struct(*[F.col(g) for g in groups]) if groups else F.lit(0)


def hash_rank(df: DataFrame, groups: Sequence[str], key: str = "id", seed: int = 42, buckets: int = 1024) -> DataFrame:
    """Add ``rank`` (1-based, seeded shuffle order) and ``group_rows`` within each group.

    Pass narrow rows: everything in ``df`` is shuffled once by (group, hash bucket).
    """
    marked = df.withColumns({"_g": _group(groups), "_h": md5_order(F.col(key), seed)}).withColumn(
        "_b", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * F.lit(buckets) / F.lit(65536)).cast("int")
    )
    sizes = marked.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    in_group = Window.partitionBy("_g")
    offsets = sizes.select(
        "_g",
        "_b",
        (F.sum("_n").over(in_group.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(in_group).alias("group_rows"),
    )
    within = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", key))
    return marked.join(offsets, ["_g", "_b"]).withColumn("rank", F.col("_before") + within).drop("_g", "_b", "_h", "_before")


def _bucketed(df: DataFrame, order: str, buckets: int | None) -> DataFrame:
    """Add an order-preserving bucket ``_b`` within each group: about as many as the session has shuffle partitions.

    Cut points come from one sketch per group and are written before use, so that every task and every re-run sees the same buckets.
    """
    n = buckets or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = cut_lineage(df.groupBy("_g").agg(F.array_distinct(F.percentile_approx(order, probs, 10 * n)).alias("_cuts")))
    at = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    return df.join(cuts, "_g").withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(at)).drop("_cuts")


def prefix_sums(
    df: DataFrame, groups: Sequence[str], order: str, sums: dict[str, str], descending: bool = False, buckets: int | None = None
) -> DataFrame:
    """Running sums (inclusive) of ``sums`` = {new column: source column} along ``order`` in each group.

    ``df`` has at most one row per (group, order).
    """
    marked = _bucketed(df.withColumn("_g", _group(groups)), order, buckets)
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    within = Window.partitionBy("_g", "_b").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    running = {new: F.sum(src).over(within) for new, src in sums.items()}
    totals = marked.groupBy("_g", "_b").agg(*[F.sum(src).alias(f"_t_{new}") for new, src in sums.items()])
    earlier = Window.partitionBy("_g").orderBy(direction("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_g", "_b", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = marked.withColumns(running).join(offsets, ["_g", "_b"])
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_g", "_b", *[f"_o_{n}" for n in sums])


def unpivot(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]))
    return df.select(*keep, pairs.alias("_p")).select(*keep, f"_p.{name}", f"_p.{value}")


def long_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], buckets: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group as array ``quantiles``, by counting ranks over sorted distinct values."""
    # several passes follow: sort keys are written once, as counts of distinct values
    counted = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c")))
    running = prefix_sums(counted, groups, value, {"_upto": "_c"}, buckets=buckets)
    totals = counted.groupBy(*groups).agg(F.sum("_c").alias("_n")) if groups else counted.agg(F.sum("_c").alias("_n"))
    totals = totals.withColumn("_g", _group(groups)).select("_g", "_n")
    ranked = running.withColumn("_g", _group(groups)).join(totals, "_g").drop("_g")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_upto") > position) & (F.col("_upto") - F.col("_c") <= position), F.col(value)))

    cols = []
    for p in probs:
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        cols.append(lo + (hi - lo) * (F.max(h) - F.floor(F.max(h))))
    return ranked.groupBy(*groups).agg(F.array(*cols).alias("quantiles"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles as rows (groups..., feature, quantiles): by radix selection without groups, by counted ranks within any number of them."""
    if not groups:
        found = exact_quantiles(df, cols, probs)
        return df.sparkSession.createDataFrame([(c, found["", c]) for c in cols if found["", c] is not None], "feature string, quantiles array<double>")
    return long_quantiles(unpivot(df, groups, cols), [*groups, "feature"], "value", probs)


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Column medians on the driver: one number per column, 0 where a column has no value."""
    found = exact_quantiles(df, cols, [0.5])
    return {c: (found["", c] or [0.0])[0] for c in cols}


def medians_by(df: DataFrame, cols: Sequence[str], group: str, groups: Sequence[str]) -> dict[str, dict[str, float]]:
    """Column medians of a few named groups, in the same passes."""
    found = exact_quantiles(df, cols, [0.5], group, groups)
    return {g: {c: (found[g, c] or [0.0])[0] for c in cols} for g in groups}


def lagged(df: DataFrame, groups: Sequence[str], order: str, col: str, out: str, buckets: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Previous value of ``col`` along ``order`` (a number or a time) and then ``ties``, together unique, for groups of any length.

    A group is cut into segments; the first row of a segment takes the last value of the segment before.
    """
    marked = _bucketed(df.withColumn("_g", _group(groups)), order, buckets)
    within = Window.partitionBy("_g", "_b").orderBy(order, *ties)
    ends = marked.groupBy("_g", "_b").agg(F.max_by(F.struct(F.col(col).alias("v")), F.struct(order, *ties)).alias("_end"))
    before = ends.select("_g", "_b", F.lag("_end").over(Window.partitionBy("_g").orderBy("_b")).alias("_prev"))
    at = F.row_number().over(within)
    joined = marked.withColumns({"_at": at, "_lag": F.lag(col).over(within)}).join(before, ["_g", "_b"])
    return joined.withColumn(out, F.when(F.col("_at") == 1, F.col("_prev.v")).otherwise(F.col("_lag"))).drop("_g", "_b", "_at", "_lag", "_prev")

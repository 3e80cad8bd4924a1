"""Feature tables that grow: rows already computed stay, only new and changed ones are built.

A table at ``path`` is a set of folders ``generation=<n>``, each written once. Beside it, ``path.marks`` holds for every row its key and
a mark of what the row was made from, and ``path.log`` the generations that are complete. A generation counts from the moment it is
in the log, so a run that breaks off leaves nothing that is read; the next run writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import corpus as C, features as E
from ..session import cut_lineage

#: generations of a table before they are written as one
COMPACT_AFTER = 16
LOG = "generation int, whole boolean"


def row_mark(inputs: Sequence[str], context: str) -> Column:
    """What a row was made from: its ``inputs`` and the ``context`` (rules, version, model). Compared under the row's key only."""
    return F.xxhash64(F.lit(context), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}))


def generations(spark: SparkSession, path: str) -> list[int]:
    """The complete generations that make up the table, from the last that holds a whole table on."""
    try:
        found = spark.read.schema(LOG).parquet(f"{path}.log").collect()  # a row for each generation ever made
    except AnalysisException:
        return []
    start = max(r["generation"] for r in found if r["whole"])
    return sorted({r["generation"] for r in found if r["generation"] >= start})


def _read(spark: SparkSession, path: str, numbers: Sequence[int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/generation={n}" for n in numbers])


def _commit(path: str, number: int, table: DataFrame, marks: DataFrame, whole: bool) -> None:
    table.write.mode("overwrite").parquet(f"{path}/generation={number}")
    marks.write.mode("overwrite").parquet(f"{path}.marks/generation={number}")
    marks.sparkSession.createDataFrame([(number, whole)], LOG).coalesce(1).write.mode("append").parquet(f"{path}.log")


def _drop_before(spark: SparkSession, path: str, first: int) -> None:
    for root in (path, f"{path}.marks"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("generation=") and int(name.partition("=")[2]) < first:
                files.delete(status.getPath(), True)


def grown(
    rows: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], context: str = "", inputs: Sequence[str] = ("text",), key: str = "id",
    larger: DataFrame | None = None, compact_after: int = COMPACT_AFTER,
) -> DataFrame:
    """The feature table of ``rows`` at ``path``, after ``build`` has made what it lacks.

    ``build`` takes the rows without a valid result and returns one feature row for each, by ``key``; ``key`` is unique and not null. A row
    is made again when one of its ``inputs`` or the ``context`` changes; results of rows that are gone or changed are not returned.
    If ``larger``, another feature table, covers the missing keys, its rows are taken instead. Keys and 64-bit marks are shuffled
    once; texts are read only where something is missing, and the table itself is joined only while it holds rows that do not count.
    Beyond ``compact_after`` generations, or when more than half of the stored rows do not count, the table is written as one.
    """
    spark = rows.sparkSession
    numbers = generations(spark, path)
    wanted = rows.select(key, row_mark(inputs, context).alias("_mark"), F.lit(True).alias("_wanted"))
    if numbers:
        marks = _read(spark, f"{path}.marks", numbers)
        state = wanted.join(marks, [key, "_mark"], "full_outer")
    else:
        state = wanted.withColumn("generation", F.lit(None).cast("int"))
    state = cut_lineage(state)
    n = state.agg(F.count_if(F.col("generation").isNull()).alias("missing"), F.count_if(F.col("_wanted").isNull()).alias("dead"), F.count(F.lit(1)).alias("all")).first()
    number = max(numbers, default=-1) + 1
    if n["missing"] or not numbers:
        missing = state.filter("generation is null").select(key, "_mark")
        ids = missing.select(key)
        given = rows.join(ids, key, "left_semi") if numbers else rows
        covered = larger is not None and C.coverage(ids, larger)
        _commit(path, number, E.subset(larger, ids) if covered else build(given), missing, whole=not numbers)
        numbers.append(number)
    table = _read(spark, path, numbers)
    if n["dead"]:
        live = state.filter("_wanted").select(key, F.coalesce("generation", F.lit(number)).alias("generation"))
        table = table.join(live, [key, "generation"], "left_semi")
    if len(numbers) > compact_after or 2 * n["dead"] > n["all"]:
        whole = numbers[-1] + 1
        _commit(path, whole, table.drop("generation"), state.filter("_wanted").select(key, "_mark"), whole=True)
        # what this compaction replaces stays for those who read it now, until the next one
        _drop_before(spark, path, numbers[0])
        table = _read(spark, path, [whole])
    return table.drop("generation")

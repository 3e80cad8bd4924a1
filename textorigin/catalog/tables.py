"""How the registered queries read the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-bound work enough tasks where the scan has fewer than the session has cores, as with one small file.

    A big corpus has far more splits than cores and is left alone, so its text is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


_STAGES: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], written: bool = False) -> DataFrame:
    """A table that several queries share, written once per session and state of its input files; ``build`` may have ``written`` it already.

    The files' names, sizes and times belong to the key, so a changed input is computed anew.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")])
    stamp = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
    key = (spark.sparkContext.applicationId, name, sf_dir, stamp["n"], stamp["s"])
    if key not in _STAGES:
        _STAGES[key] = build() if written else cut_lineage(build())
    return _STAGES[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ``id``, ``text`` and corpus metadata."""
    df = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("source_dataset"), F.col("source").alias("domain"), "doc_id"
    )
    return spread(df, "id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("label"), "toxic")

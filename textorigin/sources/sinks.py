"""Tables and small JSON documents written by jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.corpus import leaking_ids, removal_counters, split_label_table


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One small JSON document (a manifest, a parameter set)."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def corpus_manifest(corpus: DataFrame, reasons: DataFrame, rules: dict) -> dict:
    """Filter rules, rows per source and rows removed by reason."""
    per_source = {r["source_dataset"]: r["count"] for r in corpus.groupBy("source_dataset").count().collect()}
    return {"filter_rules": rules, "final_rows": sum(per_source.values()), "samples_per_source_dataset": per_source, "quality": removal_counters(reasons).first().asDict()}


def split_manifest(splits: DataFrame, leaks_path: str | None = None) -> dict:
    """Labels by split and the number of ids that occur in more than one split; all those ids go to ``leaks_path`` as a table."""
    leaks = leaking_ids(splits)
    if leaks_path is not None:
        write_table(leaks, leaks_path)
    return {
        "labels_by_split": {r["split"]: {"0": r["label_0"], "1": r["label_1"]} for r in split_label_table(splits).collect()},
        "leaking_id_count": leaks.count(),
    }

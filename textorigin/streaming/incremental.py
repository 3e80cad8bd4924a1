"""Streams over arriving documents and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed_values import TextRules
from ..operators.features import document_features
from ..operators.models import Detector
from ..plans.scoring import score_texts


def document_stream(spark: SparkSession, path: str, schema: str = "id string, text string", fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def incremental_features(documents: DataFrame, out: str, checkpoint: str, families: Sequence[str] = ("burst", "struct"),
                         rules: TextRules = TextRules(), once: bool = True) -> StreamingQuery:
    """Append the features of documents not seen before.

    The ids seen so far are the stream's state, kept by key in the checkpoint: no batch reads what earlier ones have written. The file
    sink commits each batch once.
    """
    first = document_features(documents.dropDuplicates(["id"]), families, rules)
    writer = first.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_scores(documents: DataFrame, detector: Detector, out: str, checkpoint: str, rules: TextRules = TextRules(), once: bool = True) -> StreamingQuery:
    """Score arriving texts; features and model are narrow, so no state is kept."""
    scored = score_texts(detector, documents, rules=rules)
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_windows(predictions: DataFrame, train_mean: float, train_std: float, ts: str = "ts", score: str = "ai_probability",
                  width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Score level per event-time window against the training statistics; works on a table and on a stream."""
    rows = predictions.withWatermark(ts, lateness) if predictions.isStreaming else predictions
    agg = rows.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.percentile_approx(score, F.lit(0.9), F.lit(10000)).alias("q90_score"))
    shift = F.abs(F.col("mean_score") - F.lit(train_mean)) / F.lit(train_std if train_std else 1.0)
    return agg.select(F.col("w.start").alias("window_start"), "n", "mean_score", "q90_score", shift.alias("standardized_shift"))


def monitor(predictions: DataFrame, train_mean: float, train_std: float, out: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Keep the window table at ``out`` up to date: each batch writes the windows that it has changed to a folder of its own.

    Windows older than the watermark leave the state. A batch that is run again replaces its folder; :func:`monitored` reads the table.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = score_windows(predictions, train_mean, train_std, **options).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def monitored(spark: SparkSession, out: str) -> DataFrame:
    """The latest state of every window."""
    rows = spark.read.parquet(out)
    names = [c for c in rows.columns if c not in ("batch", "window_start")]
    last = rows.groupBy("window_start").agg(F.max_by(F.struct(*names), "batch").alias("w"))
    return last.select("window_start", *[f"w.{c}" for c in names])

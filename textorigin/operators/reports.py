"""Reports over predictions and over tables of metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.categories import error_type
from .metrics import best_by
from .ranking import quantiles


def with_errors(pred: DataFrame, label: str = "label", prediction: str = "prediction", prob: str = "ai_probability") -> DataFrame:
    """Add error type, correctness and, for wrong rows, the confidence of the wrong answer."""
    wrong = F.col(label) != F.col(prediction)
    confidence = F.when(F.col(prediction) == 1, F.col(prob)).otherwise(1 - F.col(prob))
    return pred.withColumns({
        "error_type": error_type(F.col(label), F.col(prediction)), "correct": ~wrong, "wrong_confidence": F.when(wrong, confidence)})


def joined_for_errors(pred: DataFrame, texts: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """Predictions with document data and features; a missing label is taken from the document side."""
    t = texts.withColumnRenamed("label", "label_test") if "label" in texts.columns else texts
    new = [c for c in t.columns if c == key or c not in pred.columns]
    out = pred.join(t.select(*new), key, "left").join(features, key, "left")
    return out.withColumn("label", F.coalesce("label", "label_test").cast("int")).drop("label_test") if "label_test" in out.columns else out


def error_summary(pred: DataFrame, cells: Sequence[str], length: str = "text_length", features: Sequence[str] = (), prob: str = "ai_probability") -> DataFrame:
    """Counts by error type, score quantiles by class, direction flag, and what wrong rows look like."""
    rows = with_errors(pred, prob=prob)
    wrong = ~F.col("correct")
    base = rows.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("error_type") == k).alias(k) for k in ("TP", "FP", "TN", "FN")],
        F.avg(F.when(F.col("label") == 0, F.col(prob))).alias("human_prob_mean"),
        F.avg(F.when(F.col("label") == 1, F.col(prob))).alias("ai_prob_mean"),
        F.avg(F.when(wrong, F.col(length))).alias("wrong_text_length_mean"),
        *[F.avg(F.when(wrong, F.col(f))).alias(f"_w_{f}") for f in features],
    )
    q = quantiles(rows.select(*cells, "label", prob), [prob], [0.5, 0.1, 0.9], [*cells, "label"])
    side = lambda k, name: [F.max(F.when(F.col("label") == k, F.col("quantiles")[i])).alias(f"{name}_prob_{s}") for i, s in enumerate(("median", "q10", "q90"))]
    per = q.groupBy(*cells).agg(*side(0, "human"), *side(1, "ai"))
    out = base.join(per, list(cells), "left").withColumn("prob_direction_reversed", F.coalesce(F.col("ai_prob_mean") < F.col("human_prob_mean"), F.lit(False)))
    if features:
        out = out.withColumn("wrong_probability_feature_mean", sum((F.col(f"_w_{f}") for f in features), F.lit(0.0)) / F.lit(float(len(features))))
    return out.drop(*[f"_w_{f}" for f in features])


def top_errors(pred: DataFrame, cells: Sequence[str], n: int = 30, key: str = "id") -> DataFrame:
    """The most confident wrong rows per cell. The rank filter is applied in every task before the shuffle."""
    order = Window.partitionBy(*cells).orderBy(F.desc("wrong_confidence"), key)
    return with_errors(pred).filter(~F.col("correct")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def error_rate_by_length(pred: DataFrame, length: str = "text_length", bins: int = 5) -> DataFrame:
    """Error rate in length quantile bins, (low, high] with the lowest value included; repeated cuts are merged."""
    rows = with_errors(pred)
    cuts = sorted(set(quantiles(rows, [length], [i / bins for i in range(bins + 1)]).first()["quantiles"]))
    inner = cuts[1:-1]
    at = sum(((F.col(length) > F.lit(c)).cast("int") for c in inner), F.lit(0))
    return rows.groupBy(at.alias("length_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg((~F.col("correct")).cast("int")).alias("error_rate"))


def pivot_matrix(table: DataFrame, metric: str, rows: str = "train_name", columns: str = "test_name") -> DataFrame:
    """Highest value of a metric per (row, column) as a matrix."""
    names = sorted(r[0] for r in table.select(columns).distinct().collect())
    return table.groupBy(rows).agg(*[F.max(F.when(F.col(columns) == n, F.col(metric))).alias(n) for n in names])


def external_drop(table: DataFrame, external: str, metrics: Sequence[str] = ("auroc", "auprc", "f1"), rows: str = "train_name", columns: str = "test_name") -> DataFrame:
    """Mean over the other test sets, the external value and the drop between them, per metric."""
    inside = F.col(columns) != external
    out = table.groupBy(rows).agg(*[
        e for m in metrics for e in (F.avg(F.when(inside, F.col(m))).alias(f"{m}_public_mean"), F.max(F.when(~inside, F.col(m))).alias(f"{m}_external"))])
    return out.withColumns({f"{m}_drop": F.col(f"{m}_public_mean") - F.col(f"{m}_external") for m in metrics})


def generalisation_gap(table: DataFrame, same: dict[str, str], external: str, groups: Sequence[str] = ("train_name", "method"), columns: str = "test_name", metric: str = "auroc") -> DataFrame:
    """Same-source value, mean over other sources, external value and the two gaps."""
    train, test, m = F.col(groups[0]), F.col(columns), F.col(metric)
    own = None
    for a, b in same.items():
        hit = (train == a) & (test == b)
        own = hit if own is None else own | hit
    outside = test == external
    agg = table.groupBy(*groups).agg(
        F.max(F.when(own, m)).alias("same_source"), F.avg(F.when(~own & ~outside, m)).alias("mean_cross_source"), F.max(F.when(outside, m)).alias("external"))
    return agg.withColumns({"same_to_external_gap": F.col("same_source") - F.col("external"), "cross_to_external_gap": F.col("mean_cross_source") - F.col("external")})


def best_method(table: DataFrame, cells: Sequence[str] = ("train_name", "test_name"), order: Sequence[str] = ("auroc", "auprc", "tpr_at_fpr_5pct", "f1"), tie: str = "method") -> DataFrame:
    return best_by(table, cells, order, tie)


def against_reference(best: DataFrame, reference: DataFrame, cells: Sequence[str] = ("train_name", "test_name"), metrics: Sequence[str] = ("auroc", "auprc", "f1")) -> DataFrame:
    ref = reference.select(*cells, *[F.col(m).alias(f"reference_{m}") for m in metrics])
    return best.join(ref, list(cells)).withColumns({f"delta_{m}": F.col(m) - F.col(f"reference_{m}") for m in metrics})


def distribution_json(df: DataFrame, groups: Sequence[str], field: str) -> DataFrame:
    """Counts of a field per group as a JSON object with sorted keys."""
    counts = df.groupBy(*groups, F.coalesce(F.col(field).cast("string"), F.lit("null")).alias("k")).count()
    entries = F.sort_array(F.collect_list(F.struct("k", F.col("count").alias("v"))))
    return counts.groupBy(*groups).agg(F.to_json(F.map_from_entries(entries)).alias(f"{field}_distribution"))


def melted(table: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return table.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keep), list(metrics), "metric", "value")


def collected(tables: dict[str, DataFrame], name: str = "experiment") -> DataFrame:
    """Metric tables of several experiments as one, missing columns null."""
    out = None
    for experiment, t in tables.items():
        one = t.withColumn(name, F.lit(experiment))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def ranked_results(table: DataFrame, order: Sequence[str] = ("f1", "auroc")) -> DataFrame:
    return table.orderBy(*[F.desc_nulls_last(c) for c in order])


def evidence(df: DataFrame, columns: Sequence[str], deviations: Column | None = None, most: int = 5) -> Column:
    """Short reasons for a score, in a fixed order, at most ``most``, never none."""
    has = lambda c: c in columns
    notes = []
    if has("struct_template_phrase_ratio"):
        notes.append(F.when(F.col("struct_template_phrase_ratio") > 0, F.lit(V.EVIDENCE_TEMPLATE)))
    if has("burst_std_sentence_length") and has("burst_sentence_count"):
        notes.append(F.when((F.col("burst_std_sentence_length") < 3) & (F.col("burst_sentence_count") >= 2), F.lit(V.EVIDENCE_SENTENCES)))
    stds = [c for c in columns if c.endswith("_loss_std")]
    if stds:
        flat = None
        for c in stds:
            hit = F.coalesce(F.col(c), F.lit(0.0)) < 1.5
            flat = hit if flat is None else flat | hit
        notes.append(F.when(flat, F.lit(V.EVIDENCE_LOSS)))
    if has("burst_compression_ratio_zlib"):
        notes.append(F.when(F.col("burst_compression_ratio_zlib") < 0.8, F.lit(V.EVIDENCE_COMPRESSION)))
    if any(c.endswith("_ppl_ratio") for c in columns):
        notes.append(F.lit(V.EVIDENCE_PAIR))
    every = F.array(*notes) if notes else F.array().cast("array<string>")
    if deviations is not None:
        every = F.concat(every, F.transform(F.slice(deviations, 1, 3), lambda e: F.concat(e["feature"], F.lit("="), F.format_string("%.4g", e["value"]), F.lit(V.EVIDENCE_FEATURE))))
    some = F.slice(F.filter(every, lambda m: m.isNotNull()), 1, most)
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(V.EVIDENCE_NONE)))

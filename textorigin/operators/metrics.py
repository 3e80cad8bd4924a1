"""Detector evaluation: metrics, curves, calibration, thresholds, bootstrap intervals, score fusion.

Every operator takes a prediction table and the columns that name a cell (train set, test set, model, ...)
and handles all cells in one job. Rows are first combined to counts per (cell, distinct score), so ties and
hot cells shrink before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .ranking import _group, prefix_sums

INF = float("inf")
LOG_FLOOR = 2.220446049250313e-16
TARGET_FPR = (0.01, 0.05, 0.10)
TARGET_TPR = (0.90, 0.95)
METRICS = (
    "positive_class_rate", "mean_ai_probability_human", "mean_ai_probability_ai", "auroc", "auprc", "accuracy",
    "balanced_accuracy", "precision", "recall", "tpr", "specificity", "tnr", "f1", "mcc", "fpr", "fnr",
    "tpr_at_fpr_1pct", "tpr_at_fpr_5pct", "tpr_at_fpr_10pct", "fpr_at_tpr_90pct", "fpr_at_tpr_95pct", "brier_score",
    "expected_calibration_error", "ECE", "log_loss",
)


def score_counts(
    pred: DataFrame, cells: Sequence[str], prob: str = "ai_probability", label: str = "label",
    prediction: str | None = None, threshold: float = 0.5, weight: Column | None = None,
) -> DataFrame:
    """Positives and negatives (and those predicted positive) per cell and distinct score in [0, 1]."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prob).cast("double")))
    w = F.lit(1) if weight is None else weight
    called = (s >= threshold) if prediction is None else (F.col(prediction) == 1)
    y = F.col(label)
    rows = pred.filter(y.isin(0, 1)).select(*cells, s.alias("score"), y.alias("_y"), called.alias("_hat"), w.alias("_w"))
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_w"))), F.lit(0))
    return rows.groupBy(*cells, "score").agg(
        add(F.col("_y") == 1).alias("pos"),
        add(F.col("_y") == 0).alias("neg"),
        add((F.col("_y") == 1) & F.col("_hat")).alias("hat_pos"),
        add((F.col("_y") == 0) & F.col("_hat")).alias("hat_neg"),
    )


def _ranked(counts: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Counts at or above each score, with the cell totals ``P`` and ``N``."""
    running = prefix_sums(counts, cells, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    totals = counts.groupBy(_group(cells).alias("_g")).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return running.withColumn("_g", _group(cells)).join(totals, "_g").drop("_g")


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def calibration_bins(counts: DataFrame, cells: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins of the score, the last one closed; empty bins are listed with null rates."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges[1:-1]]), lambda e: e <= F.col("score")))
    filled = counts.groupBy(*cells, at.alias("bin_index")).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("count"),
        F.sum(F.col("score") * (F.col("pos") + F.col("neg"))).alias("_s"),
        F.sum("pos").alias("_p"),
    )
    frame = counts.select(*cells).distinct() if cells else counts.sparkSession.range(1).select()
    frame = frame.select(*cells, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index"))
    same = (frame["bin_index"] == filled["bin_index"])
    for c in cells:
        same = same & frame[c].eqNullSafe(filled[c])
    mean, rate = _share(filled["_s"], filled["count"]), _share(filled["_p"], filled["count"])
    lefts = F.array(*[F.lit(e) for e in edges])
    return frame.join(filled, same, "left").select(
        *[frame[c] for c in cells],
        frame["bin_index"],
        F.get(lefts, frame["bin_index"]).alias("bin_left"),
        F.get(lefts, frame["bin_index"] + 1).alias("bin_right"),
        F.coalesce(filled["count"], F.lit(0)).alias("count"),
        mean.alias("mean_predicted_probability"),
        rate.alias("observed_positive_rate"),
        F.abs(mean - rate).alias("abs_calibration_gap"),
    )


def metrics_from_counts(counts: DataFrame, cells: Sequence[str]) -> DataFrame:
    """One row of 25 metrics per cell; ranking metrics are null where only one class occurs."""
    n_row = F.col("pos") + F.col("neg")
    s = F.col("score")
    clipped = F.greatest(F.lit(LOG_FLOOR), F.least(F.lit(1.0 - LOG_FLOOR), s))
    ranked = _ranked(counts, cells).withColumns({"_tpr": _share(F.col("tp"), F.col("P")), "_fpr": _share(F.col("fp"), F.col("N"))})
    tpr_at = lambda t: F.coalesce(F.max(F.when(F.col("_fpr") <= t + 1e-12, F.col("_tpr"))), F.lit(0.0))
    fpr_at = lambda t: F.min(F.when(F.col("_tpr") >= t - 1e-12, F.col("_fpr")))
    sums = ranked.groupBy(_group(cells).alias("_g"), *cells).agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        F.sum("hat_pos").alias("TP"),
        F.sum("hat_neg").alias("FP"),
        F.sum(s * F.col("pos")).alias("sp"),
        F.sum(s * F.col("neg")).alias("sn"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"),
        F.sum(F.col("pos") * _share(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum(F.col("pos") * (s - 1) * (s - 1) + F.col("neg") * s * s).alias("sq"),
        F.sum(-F.col("pos") * F.log(clipped) - F.col("neg") * F.log(F.lit(1.0) - clipped)).alias("ll"),
        *[tpr_at(t).alias(f"tpr_at_fpr_{round(t * 100)}pct") for t in TARGET_FPR],
        *[fpr_at(t).alias(f"fpr_at_tpr_{round(t * 100)}pct") for t in TARGET_TPR],
    )
    gaps = calibration_bins(counts, cells).groupBy(_group(cells).alias("_g")).agg(
        _share(F.sum(F.coalesce(F.col("abs_calibration_gap"), F.lit(0.0)) * F.col("count")), F.sum("count")).alias("ECE")
    )
    joined = sums.join(gaps, "_g")
    P, N, TP, FP = (F.col(c).cast("double") for c in ("P", "N", "TP", "FP"))
    FN, TN, n = P - TP, N - FP, P + N
    both = (P > 0) & (N > 0)
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    recall, spec = _share(TP, P), _share(TN, N)
    spread = F.sqrt((TP + FP) * (TP + FN) * (TN + FP) * (TN + FN))
    out = {
        "positive_class_rate": _share(P, n),
        "mean_ai_probability_human": _share(F.col("sn"), N),
        "mean_ai_probability_ai": _share(F.col("sp"), P),
        "auroc": _share(F.col("wins"), P * N),
        "auprc": F.when(both, _share(F.col("ap"), P)),
        "accuracy": _share(TP + TN, n),
        "balanced_accuracy": F.when(both, (recall + spec) / 2).otherwise(F.coalesce(recall, spec)),
        "precision": zero(_share(TP, TP + FP)),
        "recall": zero(recall),
        "tpr": zero(recall),
        "specificity": zero(spec),
        "tnr": zero(spec),
        "f1": zero(_share(2 * TP, 2 * TP + FP + FN)),
        "mcc": zero(_share(TP * TN - FP * FN, spread)),
        "fpr": zero(_share(FP, N)),
        "fnr": zero(_share(FN, P)),
        **{k: F.when(both, F.col(k)) for k in METRICS if "pct" in k},
        "brier_score": _share(F.col("sq"), n),
        "expected_calibration_error": F.col("ECE"),
        "ECE": F.col("ECE"),
        "log_loss": _share(F.col("ll"), n),
    }
    return joined.select(*cells, n.cast("long").alias("n"), *[out[m].alias(m) for m in METRICS])


def detector_metrics(
    pred: DataFrame, cells: Sequence[str] = (), prob: str = "ai_probability", label: str = "label",
    prediction: str | None = None, threshold: float = 0.5,
) -> DataFrame:
    return metrics_from_counts(cut_lineage(score_counts(pred, cells, prob, label, prediction, threshold)), cells)


def roc_curve(pred: DataFrame, cells: Sequence[str] = (), **names) -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score plus the origin; empty for one-class cells."""
    ranked = _ranked(cut_lineage(score_counts(pred, cells, **names)), cells).filter("P > 0 and N > 0")
    points = ranked.select(*cells, _share(F.col("fp"), F.col("N")).alias("fpr"), _share(F.col("tp"), F.col("P")).alias("tpr"), F.col("score").alias("threshold"))
    origin = ranked.select(*cells).distinct() if cells else ranked.limit(1).select()
    return points.unionByName(origin.select(*cells, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(INF).alias("threshold")))


def pr_curve(pred: DataFrame, cells: Sequence[str] = (), **names) -> DataFrame:
    """(recall, precision, threshold) at every distinct score plus the end point (0, 1)."""
    ranked = _ranked(cut_lineage(score_counts(pred, cells, **names)), cells).filter("P > 0 and N > 0")
    points = ranked.select(
        *cells, _share(F.col("tp"), F.col("P")).alias("recall"), _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.col("score").alias("threshold"))
    end = ranked.select(*cells).distinct() if cells else ranked.limit(1).select()
    return points.unionByName(end.select(*cells, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold")))


def choose_thresholds(pred: DataFrame, cells: Sequence[str] = (), **names) -> DataFrame:
    """(rule, threshold): 0.5, best F1 (lowest on ties), best TPR within each FPR budget (highest on ties)."""
    ranked = _ranked(cut_lineage(score_counts(pred, cells, **names)), cells)
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("P"))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    fpr = _share(F.col("fp"), F.col("N"))
    best = {f"target_fpr_{round(t * 100)}pct_threshold": F.max(F.when(fpr <= t + 1e-12, F.struct(r.alias("tpr"), F.col("score")))) for t in TARGET_FPR}
    agg = ranked.groupBy(*cells).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("m"))).alias("_f1"), *[v.alias(k) for k, v in best.items()])
    rules = [F.struct(F.lit("default_threshold").alias("rule"), F.lit(0.5).alias("threshold")),
             F.struct(F.lit("best_f1_threshold").alias("rule"), F.coalesce(-F.col("_f1.m"), F.lit(0.5)).alias("threshold"))]
    rules += [F.struct(F.lit(k).alias("rule"), F.when(F.col(f"{k}.tpr") > 0, F.col(f"{k}.score")).otherwise(F.lit(1.0)).alias("threshold")) for k in best]
    return agg.select(*cells, F.explode(F.array(*rules)).alias("_r")).select(*cells, "_r.rule", "_r.threshold")


def threshold_for_fpr(pred: DataFrame, target: float, cells: Sequence[str] = (), **names) -> DataFrame:
    """(threshold, tpr, fpr): the largest threshold with the highest TPR whose FPR stays within ``target``."""
    ranked = _ranked(cut_lineage(score_counts(pred, cells, **names)), cells)
    tpr, fpr = F.coalesce(_share(F.col("tp"), F.col("P")), F.lit(0.0)), F.coalesce(_share(F.col("fp"), F.col("N")), F.lit(0.0))
    best = F.max(F.when((fpr <= target + 1e-12) & (tpr > 0), F.struct(tpr.alias("tpr"), F.col("score"), fpr.alias("fpr"))))
    agg = ranked.groupBy(*cells).agg(best.alias("_b"))
    return agg.select(*cells, *[F.coalesce(F.col(f"_b.{c}"), F.lit(d)).alias(o) for c, d, o in (("score", 1.0, "threshold"), ("tpr", 0.0, "tpr"), ("fpr", 0.0, "fpr"))])


def apply_thresholds(pred: DataFrame, thresholds: DataFrame, cells: Sequence[str], prob: str = "ai_probability") -> DataFrame:
    """Predictions at the threshold of each row's cell (chosen on dev, applied to test)."""
    if cells:
        joined = pred.join(thresholds, list(cells))
    else:
        joined = pred.withColumn("threshold", F.lit(thresholds.first()["threshold"]))
    return joined.withColumn("prediction", (F.col(prob) >= F.col("threshold")).cast("int"))


def confusion(pred: DataFrame, cells: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(*cells, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_report(pred: DataFrame, cells: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    y, h = F.col(label), F.col(prediction)
    agg = pred.groupBy(*cells).agg(*[
        F.struct(F.lit(k).alias("class"), F.count_if((y == k) & (h == k)).alias("tp"), F.count_if(h == k).alias("called"), F.count_if(y == k).alias("support")).alias(f"_c{k}")
        for k in (0, 1)])
    rows = agg.select(*cells, F.explode(F.array("_c0", "_c1")).alias("_c"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return rows.select(
        *cells, "_c.class",
        zero(_share(F.col("_c.tp"), F.col("_c.called"))).alias("precision"),
        zero(_share(F.col("_c.tp"), F.col("_c.support"))).alias("recall"),
        zero(_share(2 * F.col("_c.tp"), F.col("_c.called") + F.col("_c.support"))).alias("f1"),
        F.col("_c.support").alias("support"),
    )


# Cumulative Poisson(1) probabilities and the multiplicative generator 48271 mod 2^31 - 1. A draw above ten, which has a
# probability of 1e-8, counts as ten: the generator's 31 bits tell hardly more apart.
POISSON = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
)
MODULUS, MULTIPLIER = 2147483647, 48271


def bootstrap_weights(pred: DataFrame, replicates: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Add ``replicate`` and ``weight``: each row is drawn Poisson(1) times per replicate.

    The draw depends on the row key and the replicate only, so a re-run task draws the same. Rows drawn
    zero times (37 %) are dropped before the shuffle.
    """
    start = (F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long") % (MODULUS - 1)) + 1
    steps = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(pow(MULTIPLIER, b + 1, MODULUS)).alias("m")) for b in range(replicates)])
    u = (F.col("_x") * F.col("_s.m")) % MODULUS / F.lit(float(MODULUS))
    weight = sum(((u >= F.lit(c)).cast("int") for c in POISSON), F.lit(0))
    drawn = pred.withColumn("_x", start).withColumn("_s", F.explode(steps)).withColumn("weight", weight)
    return drawn.filter("weight > 0").withColumn("replicate", F.col("_s.b")).drop("_x", "_s")


def bootstrap_metrics(pred: DataFrame, cells: Sequence[str] = (), replicates: int = 200, key: str = "id", seed: int = 42, **names) -> DataFrame:
    """AUROC, AUPRC and F1 of every bootstrap replicate."""
    drawn = bootstrap_weights(pred, replicates, key, seed)
    counts = cut_lineage(score_counts(drawn, [*cells, "replicate"], weight=F.col("weight"), **names))
    running = prefix_sums(counts, [*cells, "replicate"], "score", {"tp": "pos", "fp": "neg"}, descending=True)
    sums = running.groupBy(*cells, "replicate").agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum("hat_pos").alias("TP"), F.sum("hat_neg").alias("FP"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"),
        F.sum(F.col("pos") * _share(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return sums.select(
        *cells, "replicate",
        F.when(both, _share(F.col("wins"), F.col("P") * F.col("N"))).alias("auroc"),
        F.when(both, _share(F.col("ap"), F.col("P"))).alias("auprc"),
        F.coalesce(_share(2 * F.col("TP"), F.col("TP") + F.col("FP") + F.col("P")), F.lit(0.0)).alias("f1"))


def bootstrap_intervals(pred: DataFrame, cells: Sequence[str] = (), replicates: int = 200, **options) -> DataFrame:
    """2.5 and 97.5 percentiles over the replicates."""
    runs = bootstrap_metrics(pred, cells, replicates, **options)
    q = lambda m: [F.percentile(m, F.lit(0.025)).alias(f"{m}_ci_low"), F.percentile(m, F.lit(0.975)).alias(f"{m}_ci_high")]
    return runs.groupBy(*cells).agg(*q("auroc"), *q("auprc"), *q("f1"))


ALPHAS = tuple(i * 0.1 for i in range(10)) + (1.0,)


def joined_scores(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("id",), names: Sequence[str] = ("score_a", "score_b")) -> DataFrame:
    """Two prediction tables as one: the rows both have, labels from the first, each table's score under a name of its own."""
    a = first.withColumnRenamed("ai_probability", names[0])
    b = second.select(*keys, F.col("ai_probability").alias(names[1]))
    return a.join(b, list(keys))


def fused(pred: DataFrame, first: str, second: str) -> DataFrame:
    """Every row at every mixing weight: alpha * first + (1 - alpha) * second."""
    a = F.explode(F.array(*[F.lit(x) for x in ALPHAS]))
    return pred.withColumn("alpha", a).withColumn("ai_probability", F.col("alpha") * F.col(first) + (1 - F.col("alpha")) * F.col(second))


def fusion_table(pred: DataFrame, first: str, second: str, cells: Sequence[str] = ()) -> DataFrame:
    return detector_metrics(fused(pred, first, second), [*cells, "alpha"])


def best_by(table: DataFrame, cells: Sequence[str], order: Sequence[str], tie: str, largest_tie: bool = False) -> DataFrame:
    """Row with the highest ``order`` tuple per cell, nulls lowest; ties by ``tie``."""
    rank = [F.coalesce(F.col(c).cast("double"), F.lit(-INF)).alias(f"r{i}") for i, c in enumerate(order)]
    by_number = dict(table.dtypes)[tie] != "string"
    last = F.col(tie) if largest_tie or not by_number else -F.col(tie)
    key = F.struct(*rank, last.alias("t"))
    return table.groupBy(*cells).agg(F.max_by(F.struct(*table.columns), key).alias("_r")).select("_r.*")


def choose_alpha(table: DataFrame, cells: Sequence[str] = (), with_tpr: bool = False) -> DataFrame:
    """Best mixing weight per cell by auprc, auroc, (tpr at 5 % fpr,) f1; the smallest weight on ties."""
    order = ["auprc", "auroc", *(["tpr_at_fpr_5pct"] if with_tpr else []), "f1"]
    return best_by(table, cells, order, "alpha")


def averaged(pred: DataFrame, first: str, second: str) -> DataFrame:
    return pred.withColumn("ai_probability", 0.5 * F.col(first) + 0.5 * F.col(second))

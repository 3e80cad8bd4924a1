"""Scoring new texts with a saved detector, in batch, and evaluating it on an external set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.categories import risk_level
from ..functions.fixed_values import TextRules
from ..operators import drift, models as M, reports as R
from ..operators.features import document_features
from ..operators.metrics import detector_metrics


def score_features(detector: M.Detector, features: DataFrame, reference: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """Probability, Yes/No, risk level and reasons per row."""
    scored = detector.score(features, threshold)
    top = drift.top_deviations(scored, reference, detector.importance(), 3) if reference else None
    return scored.withColumns({
        "answer": F.when(F.col("prediction") == 1, F.lit("Yes")).otherwise(F.lit("No")),
        "risk_level": risk_level(F.col("ai_probability")),
        "top_evidence": R.evidence(scored, scored.columns, top),
    })


def score_texts(detector: M.Detector, corpus: DataFrame, reference: dict | None = None, rules: TextRules = TextRules(), threshold: float = 0.5) -> DataFrame:
    """Texts to answers in one narrow pass: features, imputation, model, reasons."""
    families = sorted({c.split("_")[0] for c in detector.columns} & {"burst", "struct", "pert"})
    features = document_features(corpus, families, rules)
    return score_features(detector, features, reference, threshold).select("id", "answer", "ai_probability", "risk_level", "top_evidence")


def evaluate_external(detector: M.Detector, features: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(predictions of all rows, metrics of the labelled ones)."""
    scored = detector.score(features, threshold)
    return scored, detector_metrics(scored.filter(F.col("label").isNotNull()), prediction="prediction")

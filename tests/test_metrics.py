import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textorigin.operators import drift as D, metrics as M


def brute(y, p):
    """Metrics by definition: every pair, every threshold."""
    y, p = np.asarray(y), np.asarray(p, dtype=float)
    pos, neg = p[y == 1], p[y == 0]
    wins = [(a > b) + 0.5 * (a == b) for a in pos for b in neg]
    points = [((neg >= t).mean(), (pos >= t).mean(), t) for t in sorted(set(p), reverse=True)]
    ap, last = 0.0, 0.0
    for _, tpr, t in points:
        ap += (tpr - last) * (y[p >= t] == 1).mean()
        last = tpr
    return {"auroc": np.mean(wins), "auprc": ap, "points": points, "brier_score": np.mean((p - y) ** 2),
            "tpr_at_fpr_5pct": max([tpr for fpr, tpr, _ in points if fpr <= 0.05] + [0.0]), "fpr_at_tpr_90pct": min(fpr for fpr, tpr, _ in points if tpr >= 0.9)}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 240)
    return y.tolist(), np.clip(np.round(0.5 * y + rng.normal(0.25, 0.3, 240), 2), 0, 1).tolist()


def test_metrics_against_definitions(spark, data):
    y, p = data
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.3), ("one", 1, 0.9)], "cell string, label int, ai_probability double")
    got = {r["cell"]: r for r in M.detector_metrics(df, ["cell"]).collect()}
    want = brute(y, p)
    for k in ("auroc", "auprc", "brier_score", "tpr_at_fpr_5pct", "fpr_at_tpr_90pct"):
        assert math.isclose(got["a"][k], want[k], abs_tol=1e-12), k
    assert got["one"]["auroc"] is None and got["one"]["auprc"] is None and got["one"]["tpr_at_fpr_1pct"] is None and got["one"]["recall"] == 0.5
    flipped = M.detector_metrics(df.filter("cell = 'a'").withColumn("ai_probability", 1 - F.col("ai_probability"))).first()
    assert math.isclose(flipped["auroc"], 1 - want["auroc"], abs_tol=1e-9)
    curve = sorted((r["fpr"], r["tpr"]) for r in M.roc_curve(df, ["cell"]).filter("cell = 'a'").collect())
    assert np.allclose(curve, sorted([(0.0, 0.0)] + [(a, b) for a, b, _ in want["points"]]))
    assert M.roc_curve(df, ["cell"]).filter("cell = 'one'").isEmpty() and M.pr_curve(df, ["cell"]).filter("cell = 'one'").isEmpty()


def test_threshold_ties_take_the_largest(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.2), (0, 0.1)], "label int, ai_probability double")
    r = M.threshold_for_fpr(df, 0.0).first()
    assert (r["threshold"], r["tpr"], r["fpr"]) == (0.9, 0.5, 0.0)
    none = M.threshold_for_fpr(df.withColumn("ai_probability", 1 - F.col("ai_probability")), 0.0).first()
    assert none["threshold"] == 1.0 and none["tpr"] == 0.0
    assert M.apply_thresholds(df, M.threshold_for_fpr(df, 0.0), []).filter("prediction = 1").count() == 1


def test_calibration_covers_all_rows(spark, data):
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(*data)], "label int, ai_probability double")
    bins = M.calibration_bins(M.score_counts(df, []), []).orderBy("bin_index").collect()
    assert len(bins) == 10 and sum(b["count"] for b in bins) == len(data[0])
    assert all(b["mean_predicted_probability"] is None or b["bin_left"] <= b["mean_predicted_probability"] <= b["bin_right"] for b in bins)


def test_bootstrap_surrounds_the_estimate(spark, data):
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(*data))], "id int, label int, ai_probability double")
    ci, point = M.bootstrap_intervals(df, replicates=60).first(), M.detector_metrics(df).first()
    for m in ("auroc", "auprc", "f1"):
        assert ci[f"{m}_ci_low"] < point[m] < ci[f"{m}_ci_high"]
    weights = M.bootstrap_weights(df, 60).groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert abs(np.mean([r["n"] for r in weights]) - 240) < 10


def test_fusion_picks_the_better_score(spark, data):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(*data, rng.random(240))], "label int, good double, noise double")
    assert M.choose_alpha(M.fusion_table(df, "good", "noise")).first()["alpha"] > 0.5


def test_shift_and_ks(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 150), 1), np.round(rng.normal(0.7, 2, 90), 1)
    to = lambda v, name: spark.createDataFrame([(name, float(x), 1.0) for x in v], "test_name string, f double, c double")
    r = {x["feature"]: x for x in D.feature_shift(to(a, "t"), to(b, "s"), ["f", "c"]).collect()}
    grid = np.union1d(a, b)
    ks = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert math.isclose(r["f"]["ks_statistic"], ks, abs_tol=1e-12)
    assert math.isclose(r["f"]["standardized_mean_difference"], abs(b.mean() - a.mean()) / a.std(ddof=1), abs_tol=1e-9)
    assert math.isclose(r["f"]["test_variance"], b.var(ddof=1), abs_tol=1e-9) and r["c"]["ks_statistic"] == 0.0 and r["c"]["standardized_mean_difference"] is None

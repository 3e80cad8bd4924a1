"""Train x test experiments: all predictions in one table, metrics of all cells in one grouped job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import corpus as C, drift, models as M
from ..operators.metrics import detector_metrics
from ..operators.resampling import multinomial_intervals
from ..session import cut_lineage

SUMMARY = ("auroc", "auprc", "f1", "tpr_at_fpr_1pct", "tpr_at_fpr_5pct", "fpr_at_tpr_95pct", "expected_calibration_error", "brier_score")


def train_sets(features: DataFrame, sources: Sequence[str], source: str = "source_dataset", seed: int = 42) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(train, dev) rows per train definition: each source, all, all balanced by source and label, all but one."""
    part = lambda members, split: features.filter(F.col(source).isin(*members) & (F.col("split") == split))
    out = {name: (part(m, "train"), part(m, "dev")) for name, m in C.train_definitions(sources).items()}
    both = part(sources, "train")
    chosen = C.balanced_sample(both.select("id", source, "label"), [source, "label"], "id", seed)
    out["train_balanced_combined"] = (both.join(chosen.select("id"), "id", "left_semi"), part(sources, "dev"))
    return out


def targeted_sets(features: DataFrame, first: str, second: str, cols: Sequence[str], source: str = "source_dataset", seed: int = 42) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Variants of one source: balanced by domain, generator or label, joined with a second source, without extreme domains."""
    part = lambda members, split: features.filter(F.col(source).isin(*members) & (F.col("split") == split))
    one, one_dev = part([first], "train"), part([first], "dev")
    two, two_dev = part([first, second], "train"), part([first, second], "dev")
    balanced = lambda df, groups: df.join(C.balanced_sample(df.select("id", *groups), groups, "id", seed).select("id"), "id", "left_semi")
    return {
        f"{first}_only": (one, one_dev),
        f"{first}_domain_balanced": (balanced(one, ["domain"]), one_dev),
        f"{first}_generator_balanced": (balanced(one, ["generator"]), one_dev),
        f"{first}_label_balanced": (balanced(one, ["label"]), one_dev),
        f"{first}_plus_{second}": (two, two_dev),
        f"{first}_plus_{second}_balanced": (balanced(two, [source, "label"]), two_dev),
        f"{first}_plus_{second}_without_extreme_domains": (drift.drop_extreme_domains(two, cols), two_dev),
    }


def run(features: DataFrame, definitions: dict[str, tuple[DataFrame, DataFrame]], tests: DataFrame, cols: Sequence[str], candidates: Sequence[M.Candidate] | None = None,
        order: Sequence[str] = M.RANKING) -> tuple[DataFrame, DataFrame, dict[str, M.Detector]]:
    """Fit the best model per definition and score all test rows (``test_name`` tells the set) with it.

    ``features`` is written once, each row with the definitions whose training rows (by ``id``) it is in; sizes, classes and medians of all
    definitions come from grouped jobs over it, and all definitions' candidates are fitted next to each other. The dev scores go into one table, so
    choosing the models is one grouped metrics job. Returns (predictions, failures, detectors). A definition without
    rows of both classes is listed and skipped; any other problem ends the run.
    """
    spark, candidates, cols = features.sparkSession, list(candidates or M.default_candidates()), list(cols)
    members = None
    for name, (train, _) in definitions.items():
        one = train.select("id", F.lit(name).alias("train_name"))
        members = one if members is None else members.unionByName(one)
    # at most one entry per definition
    of = members.groupBy("id").agg(F.collect_set("train_name").alias("definitions"))
    table = cut_lineage(features.select("id", "label", *cols).join(of, "id"))
    long = table.withColumn("train_name", F.explode("definitions"))
    classes = long.groupBy("train_name").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(F.col("label").isin(0, 1), F.col("label"))).alias("classes"))
    stats = {r["train_name"]: r for r in classes.collect()}
    known = [n for n in definitions if n in stats and stats[n]["classes"] == 2]
    failures = [(n, "training rows have one class only" if n in stats else "no training rows") for n in definitions if n not in known]
    if not known:
        raise ValueError(f"no train definition could be fitted: {failures}")
    medians = M.medians_by(long.filter(F.col("label").isin(0, 1)), cols, "train_name", known)
    ready = dict(zip(known, M.concurrently(spark, [lambda n=n: M.prepared(table.filter(F.array_contains("definitions", n)), cols, medians[n]) for n in known])))
    jobs = [(n, i) for n in known for i in range(len(candidates))]
    fitted = dict(zip(jobs, M.fit_many([ready[n] for n, _ in jobs], [(cols, candidates[i]) for _, i in jobs])))
    dev_scores = None
    for n in known:
        one = M.score_many([({"train_name": n, "candidate_index": i}, fitted[n, i]) for i in range(len(candidates))], definitions[n][1], ["label"])
        dev_scores = one if dev_scores is None else dev_scores.unionByName(one)
    found = {(r["train_name"], r["candidate_index"]): r for r in detector_metrics(dev_scores, ["train_name", "candidate_index"], prediction="prediction").collect()}
    predictions, detectors = None, {}
    for name in known:
        best = M.chosen_index({i: found[name, i] for i in range(len(candidates)) if (name, i) in found}, len(candidates), order)
        detector = detectors[name] = fitted[name, best]
        one = detector.score(tests).select(
            F.lit(name).alias("train_name"), F.lit(detector.name).alias("best_model"), F.lit(stats[name]["rows"]).alias("n_train"), F.lit(len(cols)).alias("n_features"),
            "test_name", "id", "label", "ai_probability", "prediction")
        predictions = one if predictions is None else predictions.unionByName(one)
    failed = spark.createDataFrame(failures, "train_name string, problem string")
    return cut_lineage(predictions), failed, detectors


CELL = ("train_name", "test_name", "best_model", "n_train", "n_features")


def matrix(predictions: DataFrame) -> DataFrame:
    """One row per train x test cell; the number of evaluated rows is part of it."""
    table = detector_metrics(predictions, list(CELL), prediction="prediction")
    return table.select(*CELL, F.col("n").alias("n_test"), *SUMMARY)


def matrix_with_intervals(predictions: DataFrame, replicates: int = 200) -> DataFrame:
    cells = ["train_name", "test_name"]
    return matrix(predictions).join(multinomial_intervals(predictions, cells, replicates, prediction="prediction"), cells)


def named_sets(full: Sequence[str], small: str, large: str, transition: dict[str, Sequence[str]], delta: Sequence[str], dynamics: dict[str, Sequence[str]],
               multiscale: Sequence[str], deep: Sequence[str]) -> dict[str, list[str]]:
    """The column sets that are compared: all plain columns with and without the transition, dynamics and deep columns of two models, their changes, and these alone."""
    both = lambda of: [*of[small], *of[large]]
    sets = {
        "full": [], **{f"full_plus_transition_{m}": transition[m] for m in (small, large)}, "full_plus_transition_both": both(transition),
        "full_plus_transition_delta": delta, **{f"full_plus_dynamics_{m}": dynamics[m] for m in (small, large)},
        "full_plus_dynamics_both": [*both(dynamics), *multiscale], "full_plus_transition_plus_dynamics": [*both(transition), *both(dynamics), *multiscale], "full_plus_deep": deep,
    }
    alone = {"transition_delta": delta, **{f"dynamics_{m}": dynamics[m] for m in (small, large)}, "dynamics_both_multiscale": [*both(dynamics), *multiscale], "deep": deep}
    return {name: [*full, *more] for name, more in sets.items()} | {name: list(cols) for name, cols in alone.items()}


def combinations(train: DataFrame, dev: DataFrame, tests: DataFrame, column_sets: dict[str, Sequence[str]], candidates: Sequence[M.Candidate] | None = None) -> DataFrame:
    """The same train set with several column sets (basic, + transition, + dynamics, ...): one row per set and test."""
    best = M.best_of_sets(train, dev, column_sets, list(candidates or M.default_candidates()), M.RANKING_WITH_TPR)
    marks = lambda name, d: {"feature_set": name, "best_model": d.name, "n_features": len(column_sets[name])}
    scored = M.score_many([(marks(name, d), d) for name, (d, _) in best.items()], tests, ["test_name", "label"])
    return detector_metrics(cut_lineage(scored), ["feature_set", "best_model", "n_features", "test_name"], prediction="prediction")

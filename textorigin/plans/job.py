"""The whole run: corpus to feature tables to models to reports, each stage kept as a table and reused when it fits."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import TextRules
from ..operators import corpus as C, dynamics as D, features as E, models as M, scale as S, surprise as L, transition as X
from ..session import cut_lineage
from . import matrix
from .growing import grown


#: raised whenever a family changes what it computes
VERSION = 3


def fingerprint(corpus: DataFrame, rules: TextRules = TextRules()) -> str:
    """What a model learned from a corpus depends on: ids, texts, splits, rules and the code's version.

    Row hashes are added up, so no order is needed and equal rows count.
    """
    hashes = F.xxhash64("id", "text", "split").cast("decimal(38,0)")
    row = corpus.agg(F.count(F.lit(1)).alias("n"), F.sum(hashes).alias("s")).first()
    return hashlib.md5(f"{VERSION}|{row['n']}|{row['s']}|{rules!r}".encode()).hexdigest()


#: families that need the language models
OF_LOSSES = ("probability", "contrast", "scale", "transition", "transition_delta", "dynamics", "multiscale", "global_dynamics")


def _deep(losses: DataFrame, model: str, cuts: Sequence[float]) -> DataFrame:
    ranked = losses.select("id", model, L.probability_rank(F.col(model)).alias("rank"), L.token_probability(F.col(model)).alias("prob"))
    return D.deep_observable(ranked, model, cuts, rank="rank", prob="prob")


def feature_tables(corpus: DataFrame, out: str, families: Sequence[str] = ("burst", "struct", "pert", "probability", "contrast", "scale", "transition"),
                   rules: TextRules = TextRules(), models: Sequence[str] = ("ng2",)) -> dict[str, DataFrame]:
    """One parquet table per family, grown by the documents that are new or changed since the last run.

    Language models, state bins, scalers and the global operator see training rows only, so the families that need them are built anew when a
    training row changes, and otherwise for new documents alone. ``transition``, ``dynamics`` and ``global_dynamics`` have a table for each of
    ``models``, ``transition_delta`` and ``multiscale`` one for each two that follow each other.
    """
    at = lambda name: f"{out}/features/{name}"
    texts = corpus.select("id", "text")
    of_rules = f"{VERSION}|{rules!r}"
    tables = {f: grown(texts, at(f), lambda new, f=f: E.document_features(new, [f], rules), of_rules) for f in families if f in E.FAMILIES}
    if not set(families) & set(OF_LOSSES):
        return tables
    train = corpus.filter("split = 'train'")
    of_model = fingerprint(train, rules)
    only = lambda table, new: table.join(new.select("id"), "id", "left_semi")
    family = lambda name, build: grown(texts, at(name), build, of_model)
    losses = family("losses", lambda new: L.GramModel.fit(train.select("id", "text")).losses(new))
    stats = family("probability", lambda new: L.loss_statistics(only(losses, new)))
    if "probability" in families:
        tables["probability"] = stats
    if "contrast" in families:
        tables["contrast"] = family("contrast", lambda new: L.contrasts(only(stats, new), [("ng1", "ng2"), ("ng2", "ng4")]))
    if "scale" in families:
        tables["scale"] = family("scale", lambda new: S.scale_response(*S.scale_columns(only(stats, new))))
    bins = functools.cache(lambda m: X.train_bins(only(losses, train), m))

    @functools.cache
    def global_model(m: str):
        paths = cut_lineage(_deep(only(losses, train), m, bins(m)["raw"][5]))
        scaler = D.fit_scaler(paths, D.DEEP_RANKED)
        return scaler, D.global_operator(D.scaled_steps(paths, scaler))

    def residuals(new: DataFrame, m: str) -> DataFrame:
        scaler, operator = global_model(m)
        scaled = D.scaled_steps(_deep(only(losses, new), m, bins(m)["raw"][5]), scaler)
        return D.residual_features(scaled, operator, prefix=f"deep_dmd_{m}").withColumnRenamed("steps", f"deep_dmd_{m}_steps")

    of_model_builds = {
        "transition": lambda new, m: X.full_profiles(only(losses, new), m, bins(m), m),
        "dynamics": lambda new, m: D.koopman_features(only(losses, new), m, m, bins(m)["raw"]),
        "global_dynamics": residuals,
    }
    wanted = set(families) | {need for f, need in (("transition_delta", "transition"), ("multiscale", "dynamics")) if f in families}
    built = {(f, m): family(f"{f}_{m}", lambda new, build=build, m=m: build(new, m)) for f, build in of_model_builds.items() if f in wanted for m in models}
    tables |= {f"{f}_{m}": t for (f, m), t in built.items() if f in families}
    of_pair_builds = {
        "transition_delta": lambda new, a, b: X.column_delta(only(built["transition", a], new), only(built["transition", b], new), a, b, f"scale_transition_delta_{a}_{b}_"),
        "multiscale": lambda new, a, b: D.multiscale(only(built["dynamics", a], new), only(built["dynamics", b], new), a, b),
    }
    for f, build in of_pair_builds.items():
        for a, b in zip(models, models[1:]) if f in families else ():
            tables[f"{f}_{a}_{b}"] = family(f"{f}_{a}_{b}", lambda new, build=build, a=a, b=b: build(new, a, b))
    return tables


def run(corpus: DataFrame, out: str, families: Sequence[str] = ("burst", "struct"), candidates: Sequence[M.Candidate] | None = None,
        rules: TextRules = TextRules(), replicates: int = 200, models: Sequence[str] = ("ng2",)) -> dict[str, DataFrame]:
    """Features, merge, column cleaning, the train x test matrix and its reports, written below ``out``."""
    C.assert_no_leak(corpus)
    tables = feature_tables(corpus, out, families, rules, models)
    meta = corpus.select("id", "label", "source_dataset", "domain", "split")
    E.merge_families(meta, list(tables.values())).write.mode("overwrite").parquet(f"{out}/all_features")
    merged = corpus.sparkSession.read.parquet(f"{out}/all_features")
    cols = E.numeric_features(merged)
    train = merged.filter("split = 'train'")
    kept, info = E.clean_columns(E.column_audit(train, cols), cols)
    sources = sorted(r[0] for r in merged.select("source_dataset").distinct().collect())
    tests = merged.filter("split = 'test' and label is not null").withColumn("test_name", F.concat(F.col("source_dataset"), F.lit("_test")))
    labelled = merged.filter("label is not null")
    predictions, failures, detectors = matrix.run(labelled, matrix.train_sets(labelled, sources), tests, kept, candidates)
    results = {"matrix": matrix.matrix_with_intervals(predictions, replicates), "predictions": predictions, "failures": failures, "catalogue": E.catalogue(merged)}
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{out}/results/{name}")
    for name, d in detectors.items():
        d.metadata["cleaning"] = info
        d.save(corpus.sparkSession, f"{out}/checkpoints/{name}")
    return {name: corpus.sparkSession.read.parquet(f"{out}/results/{name}") for name in results}

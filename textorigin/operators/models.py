"""Classifiers on feature tables: candidates, selection on a dev split, feature selection, ablation, probes."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .corpus import cap_groups, class_balance, train_test_split
from .features import feature_group, imputed
from .metrics import detector_metrics
from .ranking import medians as column_medians, medians_by

RANKING = ("auprc", "auroc", "f1")
RANKING_WITH_TPR = ("auprc", "auroc", "tpr_at_fpr_5pct", "f1")


@dataclass(frozen=True)
class Candidate:
    """A model family with its parameters. ``build(n_rows)`` gives the pipeline stages after the assembler."""

    name: str
    params: dict
    build: Callable[[int], list]
    #: candidates of one family differ only in ``size``, and a smaller one is the beginning of a larger one
    family: tuple | None = None
    size: int = 0


def logistic(c: float = 1.0, l1: bool = False, iterations: int = 100) -> Candidate:
    """Standardised logistic regression; ``c`` is the inverse penalty per training row."""
    def build(n: int) -> list:
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        return [scaler, LogisticRegression(
            weightCol="weight", regParam=1.0 / (c * max(n, 1)), elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=iterations)]

    return Candidate("logistic_regression", {"C": c, "l1": l1}, build)


def forest(trees: int = 300, depth: int | None = None, min_leaf: int = 1, max_features: str = "sqrt", seed: int = 42, balanced: bool = True) -> Candidate:
    """Random forest, with balanced class weights or none; no depth limit means Spark's largest depth, 30."""
    def build(_: int) -> list:
        weight = {"weightCol": "weight"} if balanced else {}
        return [RandomForestClassifier(
            featuresCol="raw_features", **weight, numTrees=trees, maxDepth=depth or 30, minInstancesPerNode=min_leaf,
            featureSubsetStrategy=max_features, seed=seed)]

    return Candidate("random_forest", {"trees": trees, "depth": depth, "min_leaf": min_leaf, "max_features": max_features, "balanced": balanced}, build)


def boosting(rounds: int = 200, depth: int = 3, rate: float = 0.05, subsample: float = 0.9, seed: int = 42) -> Candidate:
    def build(_: int) -> list:
        return [GBTClassifier(featuresCol="raw_features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed)]

    return Candidate("gradient_boosting", {"rounds": rounds, "depth": depth, "rate": rate}, build, (depth, rate, subsample, seed), rounds)


def normal_bayes() -> Candidate:
    """Naive Bayes with a normal density per class and column: one pass over the training rows, and a closed form that SQL can repeat."""
    def build(_: int) -> list:
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        return [scaler, NaiveBayes(modelType="gaussian", weightCol="weight")]

    return Candidate("normal_bayes", {}, build)


def default_candidates() -> list[Candidate]:
    return [logistic(), forest(), boosting()]


def tuning_grid() -> list[Candidate]:
    """4 logistic, 72 forest and 8 boosting settings."""
    out = [logistic(c) for c in (0.01, 0.1, 1.0, 10.0)]
    axes = itertools.product((300, 500), (None, 12, 20), (1, 3, 5), ("sqrt", "log2"), (True, False))
    out += [forest(n, d, leaf, m, balanced=b) for n, d, leaf, m, b in axes]
    out += [boosting(n, d, r, 0.8) for n, d, r in itertools.product((300, 600), (3, 5), (0.05, 0.1))]
    return out


def weighted(df: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """Balanced class weights n / (2 n_class); also the row count."""
    b = class_balance(df.withColumnRenamed(label, "label") if label != "label" else df).first()
    n = b["n_positive"] + b["n_negative"]
    pos, neg = n / (2.0 * max(b["n_positive"], 1)), n / (2.0 * max(b["n_negative"], 1))
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(pos)).otherwise(F.lit(neg))), n


@dataclass
class Detector:
    """A fitted model with the columns and training medians it needs."""

    name: str
    model: PipelineModel
    columns: list[str]
    medians: dict[str, float]
    metadata: dict = field(default_factory=dict)

    def score(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``df`` plus ``ai_probability`` and ``prediction``; columns the table lacks count as missing."""
        missing = [c for c in self.columns if c not in df.columns]
        filled = imputed(df.withColumns({c: F.lit(None).cast("double") for c in missing}), self.columns, self.medians)
        out = self.model.transform(filled).withColumn("ai_probability", vector_to_array("probability")[1])
        keep = [c for c in df.columns if c not in ("ai_probability", "prediction")]
        return out.withColumn("prediction", (F.col("ai_probability") >= threshold).cast("int")).select(*keep, "ai_probability", "prediction")

    def importance(self) -> dict[str, float]:
        last = self.model.stages[-1]
        if hasattr(last, "featureImportances"):
            values = last.featureImportances.toArray()
        elif hasattr(last, "coefficients"):
            values = abs(last.coefficients.toArray())
        else:
            # how far the class means lie apart, in deviations
            theta, sigma = last.theta.toArray(), last.sigma.toArray()
            values = abs(theta[1] - theta[0]) / sigma.mean(axis=0) ** 0.5
        return dict(sorted(zip(self.columns, map(float, values)), key=lambda kv: -kv[1]))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        side = {"name": self.name, "columns": self.columns, "medians": self.medians, "metadata": self.metadata}
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/side")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Detector":
        side = json.loads(spark.read.text(f"{path}/side").first()["value"])
        return cls(side["name"], PipelineModel.load(f"{path}/model"), side["columns"], side["medians"], side["metadata"])


def fit(train: DataFrame, cols: Sequence[str], candidate: Candidate, medians: dict[str, float] | None = None) -> Detector:
    """Fit one candidate; medians and class weights come from the training rows only."""
    return fit_many(prepared(train, cols, medians), [(cols, candidate)])[0]


@dataclass
class Training:
    """Training rows ready for many fits: imputed and weighted once, in few partitions, with the medians they were imputed by."""

    rows: DataFrame
    n: int
    medians: dict[str, float]


#: bytes of a partition of training rows, about: a small table has one, so that a fit's many short jobs have one task each
PARTITION = 32 << 20


def prepared(train: DataFrame, cols: Sequence[str], medians: dict[str, float] | None = None) -> Training:
    rows = train.filter(F.col("label").isin(0, 1))
    med = medians if medians is not None else column_medians(rows, list(cols))
    ready, n = weighted(imputed(rows.select("label", *cols), list(cols), med))
    ready = ready.withColumn("label", F.col("label").cast("double"))
    wanted = max(1, n * len(cols) * 8 // PARTITION)
    return Training(cut_lineage(ready.coalesce(wanted) if wanted < ready.rdd.getNumPartitions() else ready), n, med)


def concurrently(spark: SparkSession, work: Sequence[Callable], threads: int | None = None) -> list:
    """Results of independent pieces of driver work, several at a time, so that the cluster has more than one small job to do.

    Each thread has a scheduler pool of its own, which counts where the session schedules fairly.
    """
    if len(work) < 2:
        return [w() for w in work]
    threads = min(len(work), threads or max(4, min(16, spark.sparkContext.defaultParallelism)))

    def one(i: int, w: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"work-{i % threads}")
        return w()

    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(one), i, w) for i, w in enumerate(work)]]


def beginning(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model after its first ``rounds`` rounds: what a fit with so many rounds gives, as a round sees only earlier ones."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees, weights = java.trees(), java.treeWeights()
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    kept_weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        kept[i], kept_weights[i] = trees[i], weights[i]
    small = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{java.uid()}_{rounds}", kept, kept_weights)
    small.setFeaturesCol(java.getFeaturesCol())
    out = GBTClassificationModel(small)
    out._resetUid(small.uid())
    out._transfer_params_from_java()
    return out


def fit_many(training: Training | Sequence[Training], jobs: Sequence[tuple[Sequence[str], Candidate]]) -> list[Detector]:
    """A detector for each (columns, candidate), on one training table or on one of each job. Fits run next to each other; candidates
    of a family are fitted once, in the largest size, and the others are its beginnings."""
    own = list(training) if not isinstance(training, Training) else [training] * len(jobs)
    largest: dict[tuple, int] = {}
    for i, (cols, c) in enumerate(jobs):
        key = (id(own[i]), tuple(cols), c.name, c.family or i)
        if key not in largest or c.size > jobs[largest[key]][1].size:
            largest[key] = i

    def one(i: int) -> Callable:
        cols, c = jobs[i]
        return lambda: Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="raw_features"), *c.build(own[i].n)]).fit(own[i].rows)

    # the longest first
    order = sorted(largest.values(), key=lambda i: -jobs[i][1].size)
    spark = own[0].rows.sparkSession
    fitted = dict(zip(order, concurrently(spark, [one(i) for i in order])))
    out = []
    for i, (cols, c) in enumerate(jobs):
        k = largest[id(own[i]), tuple(cols), c.name, c.family or i]
        model = fitted[k]
        if k != i and c.size < jobs[k][1].size:
            model = PipelineModel([*model.stages[:-1], beginning(model.stages[-1], c.size)])
        out.append(Detector(c.name, model, list(cols), own[i].medians, {"params": c.params, "n_train": own[i].n}))
    return out


def score_many(detectors: Sequence[tuple[dict, Detector]], rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Scores of many detectors that share their medians, in one table: the columns ``keep``, ai_probability, prediction and each detector's own marks."""
    cols = sorted({c for _, d in detectors for c in d.columns})
    med = {c: v for _, d in detectors for c, v in d.medians.items()}
    filled = cut_lineage(imputed(rows.select(*keep, *cols), cols, med))
    out = None
    for marks, d in detectors:
        one = d.model.transform(filled).withColumn("ai_probability", vector_to_array("probability")[1])
        one = one.select(*[F.lit(v).alias(k) for k, v in marks.items()], *keep, "ai_probability", (F.col("ai_probability") >= 0.5).cast("int").alias("prediction"))
        out = one if out is None else out.unionByName(one)
    return out


def _rank(row, order) -> tuple:
    return tuple(float("-inf") if row[k] is None else float(row[k]) for k in order)


def chosen_index(rows: dict, n: int, order: Sequence[str]) -> int:
    """The candidate whose metrics are largest in this order, the first of equal ones; 0 where none has metrics."""
    known = [i for i in range(n) if i in rows]
    return max(known, key=lambda i: (_rank(rows[i], order), -i)) if known else 0


def fit_select(train: DataFrame, dev: DataFrame, cols: Sequence[str], candidates: Sequence[Candidate] | None = None,
               order: Sequence[str] = RANKING) -> tuple[Detector, DataFrame]:
    """Fit all candidates on train, compare them on dev, return the best one and the comparison table.

    All candidates are scored into one table, so the metrics of the whole search are one grouped job.
    """
    candidates = list(candidates or default_candidates())
    fitted = fit_many(prepared(train, cols), [(cols, c) for c in candidates])
    scored = score_many([({"candidate_index": i, "model": d.name}, d) for i, d in enumerate(fitted)], dev, ["label"])
    table = cut_lineage(detector_metrics(scored, ["candidate_index", "model"], prediction="prediction"))
    rows = {r["candidate_index"]: r for r in table.collect()}
    best = chosen_index(rows, len(fitted), order)
    chosen = fitted[best]
    chosen.metadata |= {"selection_metric": ">".join(order), "n_features": len(cols), "best_params": candidates[best].params}
    params = train.sparkSession.createDataFrame([(i, json.dumps(c.params, sort_keys=True)) for i, c in enumerate(candidates)], "candidate_index int, params_json string")
    return chosen, table.join(F.broadcast(params), "candidate_index").orderBy(*[F.desc_nulls_last(k) for k in order], "candidate_index")


def importance_table(spark: SparkSession, detector: Detector) -> DataFrame:
    return spark.createDataFrame(list(detector.importance().items()), "feature string, importance double")


def select_features(train: DataFrame, candidates: Sequence[str], mode: str, trees: int = 300, ranked: Sequence[str] | None = None) -> list[str]:
    """``all``, ``summary_only`` (no single transition cells), ``l1`` or ``top<N>`` by forest importance (``ranked``, if it is known)."""
    cols = list(candidates)
    if mode == "all" or not cols:
        return cols
    if mode == "summary_only":
        return [c for c in cols if "_trans_" not in c]
    if mode == "l1":
        # where the penalty leaves no column, weaker ones follow
        training = prepared(train, cols)
        for weight in (0.1, 1.0, 10.0):
            kept = fit_many(training, [(cols, logistic(weight, l1=True))])[0].importance()
            chosen = [c for c in cols if kept[c] > 1e-9]
            if chosen:
                return chosen
        return cols
    if mode.startswith("top"):
        return list(ranked if ranked is not None else fit(train, cols, forest(trees)).importance())[: int(mode[3:])]
    raise ValueError(f"unknown selection mode {mode!r}")


def choose_selection(train: DataFrame, dev: DataFrame, base: Sequence[str], extra: Sequence[str], modes: Sequence[str] = ("all", "top20", "top50", "top100", "l1"),
                     candidates: Sequence[Candidate] | None = None, trees: int = 300) -> tuple[str, list[str], DataFrame]:
    """Try the selection modes on dev and keep the best column list. One importance fit orders the columns for all ``top`` modes."""
    candidates = list(candidates or default_candidates())
    ranked = list(fit(train, list(extra), forest(trees)).importance()) if extra and any(m.startswith("top") for m in modes) else None
    sets = {m: list(base) + select_features(train, extra, m, trees, ranked) for m in modes}
    best = best_of_sets(train, dev, sets, candidates, RANKING_WITH_TPR)
    rows = [(m, len(sets[m]), d.name, *(row[k] for k in RANKING_WITH_TPR)) for m, (d, row) in best.items()]
    table = train.sparkSession.createDataFrame(rows, "selection_mode string, n_features int, model string, " + ", ".join(f"{k} double" for k in RANKING_WITH_TPR))
    mode = max(best, key=lambda m: (_rank(best[m][1], RANKING_WITH_TPR), -list(best).index(m)))
    return mode, sets[mode], table


def best_of_sets(train: DataFrame, dev: DataFrame, sets: dict[str, Sequence[str]], candidates: Sequence[Candidate], order: Sequence[str]) -> dict[str, tuple[Detector, dict]]:
    """For each column set the best candidate on dev, with its metrics: all fits on one training table, all metrics in one job."""
    training = prepared(train, sorted({c for cols in sets.values() for c in cols}))
    jobs = [(name, i, cols, c) for name, cols in sets.items() for i, c in enumerate(candidates)]
    fitted = fit_many(training, [(cols, c) for _, _, cols, c in jobs])
    scored = score_many([({"feature_set": name, "candidate_index": i}, d) for (name, i, _, _), d in zip(jobs, fitted)], dev, ["label"])
    found = {(r["feature_set"], r["candidate_index"]): r.asDict() for r in detector_metrics(scored, ["feature_set", "candidate_index"], prediction="prediction").collect()}
    out = {}
    for name in sets:
        rows = {i: r for (s, i), r in found.items() if s == name}
        best = chosen_index(rows, len(candidates), order)
        out[name] = fitted[next(k for k, j in enumerate(jobs) if j[:2] == (name, best))], rows.get(best, dict.fromkeys(order))
    return out


def ablation_groups(cols: Sequence[str]) -> dict[str, list[str]]:
    """Column sets by feature family and their usual combinations; empty sets are left out."""
    of = lambda *groups: [c for c in cols if feature_group(c).split("_ng")[0] in groups]
    burst, struct, prob, scale = of("burstiness"), of("structure"), of("probability"), of("scale_response")
    models = sorted({feature_group(c) for c in cols if feature_group(c).startswith("probability_")})
    sets = {
        "burstiness_only": burst, "structure_only": struct, "perturbation_only": of("perturbation"),
        **{f"{m}_only": [c for c in cols if feature_group(c) == m] for m in models},
        "probability_only": prob, "scale_response_only": scale, "binoculars_style_only": of("binoculars_style"),
        "probability_scale_response": prob + scale, "burstiness_scale_response": burst + scale, "burstiness_structure": burst + struct,
        "burstiness_probability": burst + prob, "structure_probability": struct + prob, "basic_probability": burst + struct + prob,
        "basic_scale_response": burst + struct + scale, "burstiness_probability_binoculars": burst + prob + of("binoculars_style"),
        "all_features": list(cols),
    }
    return {k: v for k, v in sets.items() if v}


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, Sequence[str]], candidates: Sequence[Candidate]) -> DataFrame:
    """Every column set with every candidate, fitted on train and measured on test, best F1 first."""
    jobs = [(group, cols, c) for group, cols in groups.items() for c in candidates]
    fitted = fit_many(prepared(train, sorted({c for cs in groups.values() for c in cs})), [(cols, c) for _, cols, c in jobs])
    scored = score_many([({"feature_set": group, "model": c.name, "feature_count": len(cols)}, d) for (group, cols, c), d in zip(jobs, fitted)], test, ["label"])
    table = detector_metrics(scored, ["feature_set", "model", "feature_count"], prediction="prediction")
    return table.orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("auroc"))


def pca_2d(df: DataFrame, cols: Sequence[str], groups: Sequence[str], per_group: int | None = None, key: str = "id") -> DataFrame:
    """First two principal components of the standardised features, fitted to all rows. ``per_group`` rows of each group are
    returned, or all."""
    ready = imputed(df, list(cols), column_medians(df, list(cols)))
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        PCA(k=2, inputCol="features", outputCol="pc"),
    ]
    model = Pipeline(stages=stages).fit(ready)
    if per_group is not None:
        ready = ready.join(cap_groups(df.select(key, *groups), per_group, groups, key).select(key), key, "left_semi")
    return model.transform(ready).select(key, *groups, *[vector_to_array("pc")[i].alias(f"pc{i + 1}") for i in range(2)])


def probe_accuracy(df: DataFrame, cols: Sequence[str], targets: Sequence[str], test_share: float | None = 0.35, key: str = "id") -> DataFrame:
    """How well each target column can be told from the features by a linear model; in-sample without a test share. A test row whose
    class is not among the training rows is a miss."""
    ready = imputed(df, list(cols), column_medians(df, list(cols)))
    out = []
    for t in targets:
        rows = ready.filter(F.col(t).isNotNull()).withColumn(t, F.col(t).cast("string"))
        if rows.select(t).distinct().limit(2).count() < 2:
            continue
        train, test = rows, rows
        if test_share:
            parts = train_test_split(rows.select(key, t), key, t, test_share)
            train = rows.join(parts.filter("split = 'train'").select(key), key, "left_semi")
            test = rows.join(parts.filter("split = 'test'").select(key), key, "left_semi")
        stages = [
            StringIndexer(inputCol=t, outputCol="label_index", handleInvalid="keep"),
            VectorAssembler(inputCols=list(cols), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(labelCol="label_index", regParam=1e-3),
        ]
        scored = Pipeline(stages=stages).fit(train).transform(test)
        known = F.col(t).isin([r[0] for r in train.select(t).distinct().collect()])
        hit = F.avg((known & (F.col("prediction") == F.col("label_index"))).cast("double")).alias("accuracy")
        out.append(scored.agg(F.lit(t).alias("target"), F.count(F.lit(1)).alias("n"), hit))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total

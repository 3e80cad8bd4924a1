"""Queries that fit models. Their values depend on the learner, so only the rows are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded_table
from ..operators import corpus as C, dynamics as D, features as E, models as M
from ..plans import matrix as P, scoring as S
from ..session import cut_lineage
from . import corpora
from .documents import R6, TOKENS, VARIANTS_CTE, structure
from .dynamics import _scaled
from .reporting import features
from .sequences import losses
from ..operators import surprise as L, transition as T
from .tables import documents, stage, table


def _table(spark, sf):
    def build():
        meta = C.resplit(corpora.labelled(spark, sf))
        probability = L.loss_statistics(losses(spark, sf))
        return E.merge_families(meta, [features(spark, sf), structure(spark, sf), probability])

    return stage(spark, sf, "model_table", build)


def _cols(df):
    cols = [c for c in E.numeric_features(df) if c != "doc_id"]
    return E.clean_columns(E.column_audit(df, cols), cols)[0]


def _parts(spark, sf):
    df = _table(spark, sf)
    return df, df.filter("split = 'train'"), df.filter("split = 'dev'"), df.filter("split = 'test'"), _cols(df)


def model_selection(spark, sf):
    _, train, dev, _, cols = _parts(spark, sf)
    return M.fit_select(train, dev, cols)[1]


def hyper_parameters(spark, sf):
    _, train, dev, _, cols = _parts(spark, sf)
    return M.fit_select(train, dev, cols, M.tuning_grid())[1].select("candidate_index", "model", "params_json", "auprc", "auroc", "f1")


def importance(spark, sf):
    _, train, _, _, cols = _parts(spark, sf)
    return M.importance_table(spark, M.fit(train, cols, M.forest()))


def l1_selection(spark, sf):
    _, train, _, _, cols = _parts(spark, sf)
    return spark.createDataFrame([(c,) for c in M.select_features(train, cols, "l1")], "feature string")


def selection_modes(spark, sf):
    _, train, dev, _, cols = _parts(spark, sf)
    base = [c for c in cols if c.startswith("burst_")]
    extra = [c for c in cols if not c.startswith("burst_")]
    return M.choose_selection(train, dev, base, extra)[2].select("selection_mode", "n_features", "auprc", "auroc", "f1")


def ablation(spark, sf):
    _, train, _, test, cols = _parts(spark, sf)
    return M.ablation(train, test, M.ablation_groups(cols), M.default_candidates()).select("feature_set", "model", "feature_count", "n", "auroc", "f1")


def _predictions(spark, sf):
    def build():
        df, *_, cols = _parts(spark, sf)
        tests = df.filter("split = 'test'").withColumn("test_name", F.col("source_dataset"))
        return P.run(df, P.train_sets(df, corpora.sources_of(df)), tests, cols)[0]

    return stage(spark, sf, "matrix_predictions", build)


def source_matrix(spark, sf):
    return P.matrix(_predictions(spark, sf))


def source_matrix_intervals(spark, sf):
    return P.matrix_with_intervals(_predictions(spark, sf), 200)


def targeted_matrix(spark, sf):
    df, *_, cols = _parts(spark, sf)
    tests = df.filter("split = 'test'").withColumn("test_name", F.col("source_dataset"))
    first, second = corpora.largest_sources(df, 2)
    return P.matrix(P.run(df, P.targeted_sets(df, first, second, cols), tests, cols)[0])


def _sequence_families(spark, sf, train):
    """Transition, delta, dynamics, multiscale and deep columns of two models, all cut points and scales from ``train``."""
    models, l = ("ng1", "ng2"), losses(spark, sf)
    own = l.join(train.select("id"), "id", "left_semi")
    bins = {m: T.train_bins(own, m) for m in models}
    transition = {m: cut_lineage(T.full_profiles(l, m, bins[m], m)) for m in models}
    dynamics = {m: cut_lineage(D.koopman_features(l, m, m, bins[m]["raw"])) for m in models}
    ranked = l.select("id", "ng2", L.probability_rank(F.col("ng2")).alias("rank"), L.token_probability(F.col("ng2")).alias("prob"))
    paths = cut_lineage(D.deep_observable(ranked, "ng2", bins["ng2"]["raw"][5], rank="rank", prob="prob"))
    scaler = D.fit_scaler(paths.join(train.select("id"), "id", "left_semi"), D.DEEP_RANKED)
    deep = D.pooled(D.scaled_steps(paths, scaler), len(D.DEEP_RANKED)).drop("steps")
    return models, transition, T.column_delta(*transition.values(), *models), dynamics, D.multiscale(*dynamics.values(), *models), deep


def _combination_table(spark, sf):
    """The model table with all sequence columns, and the named column sets."""
    df, train, *_, cols = _parts(spark, sf)
    models, transition, delta, dynamics, multiscale, deep = _sequence_families(spark, sf, train)
    names = lambda t: [c for c in t.columns if c != "id"]
    wide = E.merge_families(df, [*transition.values(), delta, *dynamics.values(), multiscale, deep])
    sets = P.named_sets(cols, *models, {m: names(t) for m, t in transition.items()}, names(delta), {m: names(t) for m, t in dynamics.items()}, names(multiscale), names(deep))
    return cut_lineage(wide), sets


def feature_combinations(spark, sf):
    wide, sets = _combination_table(spark, sf)
    part = lambda s: wide.filter(F.col("split") == s)
    found = P.combinations(part("train"), part("dev"), part("test").withColumn("test_name", F.lit("all")), sets)
    return found.select("feature_set", "n_features", "n", "auroc", "auprc", "f1", "tpr_at_fpr_1pct", "tpr_at_fpr_5pct")


def pca(spark, sf):
    df, *_, cols = _parts(spark, sf)
    return M.pca_2d(df, cols, ["source_dataset"])


def probes(spark, sf):
    df, *_, cols = _parts(spark, sf)
    return M.probe_accuracy(df, cols, ["label", "source_dataset", "domain"])


def pooled_classifier(spark, sf):
    # medians, weights and scores read it: written once, not made from the losses again for each
    pool = cut_lineage(D.pooled(_scaled(spark, sf)[0], len(D.DEEP_RANKED)))
    df = C.resplit(corpora.labelled(spark, sf)).join(pool, "id")
    cols = [c for c in pool.columns if c != "id"]
    return M.fit(df.filter("split = 'train'"), cols, M.logistic()).score(df.filter("split <> 'train'")).select("id", "label", "ai_probability", "prediction")


def scored_texts(spark, sf):
    """New texts (the benchmark passages) scored by a detector trained on the labelled documents."""
    df, train, _, _, cols = _parts(spark, sf)
    basic = [c for c in cols if c.startswith(("burst_", "struct_"))]
    detector = M.fit(train, basic, M.forest())
    new = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    out = S.score_texts(detector, new)
    return out.select("id", "answer", "ai_probability", "risk_level", F.array_join("top_evidence", " ").alias("top_evidence"))


def semantic_stability(spark, sf):
    return rounded_table(E.semantic_stability(documents(spark, sf)))


QUERIES = {
    "model_selection": model_selection, "hyper_parameters": hyper_parameters, "importance": importance, "l1_selection": l1_selection, "selection_modes": selection_modes,
    "ablation": ablation, "source_matrix": source_matrix, "source_matrix_intervals": source_matrix_intervals, "targeted_matrix": targeted_matrix,
    "feature_combinations": feature_combinations, "pca_2d": pca, "probe_accuracy": probes, "pooled_classifier": pooled_classifier, "scored_texts": scored_texts,
    "semantic_stability": semantic_stability,
}
ORACLES: dict = {
    "semantic_stability": f"""with {VARIANTS_CTE}, nd as (select count(*)::double as nd from u),
      e as (select id, 0 as k, t as x from u union all select id, i as k, vs[i] as x from (select id, vs, unnest(generate_series(1, len(vs))) as i from u)),
      w as (select id, k, unnest(list_transform({TOKENS('x')}, lambda q: lower(q))) as a from e),
      c as (select id, k, a, count(*)::double as n from w group by all), d as (select a, count(*)::double as df from c where k = 0 group by a),
      z as (select id, k, a, n, ln((nd + 1) / (coalesce(df, 0) + 1)) as i from c left join d using (a) cross join nd),
      nm as (select id, k, sqrt(sum(n * n * i * i)) as s from z group by all),
      p as (select v.id, v.k, sum(o.n * v.n * v.i * v.i) as p from z v join z o on o.id = v.id and o.a = v.a and o.k = 0 where v.k > 0 group by all),
      q as (select e.id, coalesce(p.p / nullif(a.s * b.s, 0), 0) as q from e left join p on p.id = e.id and p.k = e.k left join nm a on a.id = e.id and a.k = 0 left join nm b on b.id = e.id and b.k = e.k where e.k > 0)
      select u.id, {R6('coalesce(avg(q), 0)')} as pert_semantic_similarity_mean, {R6('coalesce(stddev_pop(q), 0)')} as pert_semantic_similarity_std from u left join q using (id) group by u.id""",
}

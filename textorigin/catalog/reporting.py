"""Queries over drift, error analysis, feature tables and tables of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded, rounded_table
from ..functions import fixed_values as V
from ..functions.categories import risk_level
from ..operators import drift as D, features as E, metrics as M, models as Mo, reports as R
from ..operators.ranking import quantiles
from ..plans import matrix as P
from ..session import cut_lineage
from . import corpora
from .documents import BURST_SQL, R6, STRUCT_SQL, burstiness, structure
from .evaluation import PRED_SQL, predictions
from .sequences import SPLIT_SQL, split_of
from .tables import documents, labels, stage


def features(spark, sf):
    """Burstiness features of all documents, rounded so that both engines share the exact values; computed once."""
    return stage(spark, sf, "burstiness", lambda: burstiness(spark, sf))


def called(spark, sf):
    return predictions(spark, sf).withColumn("prediction", (F.col("ai_probability") >= 0.5).cast("int"))


def _with_language(spark, sf):
    return features(spark, sf).join(corpora.meta(spark, sf).select("id", "source_dataset", "domain", "label"), "id")


def _cols(df):
    return [c for c in df.columns if c.startswith("burst_")]


def _shift(spark, sf):
    f = _with_language(spark, sf)
    return D.feature_shift(f.filter("source_dataset = 'en'"), f.filter("source_dataset <> 'en'").withColumnRenamed("source_dataset", "test_name"), _cols(f))


def shift(spark, sf):
    return rounded_table(_shift(spark, sf), digits=4)


def shift_top(spark, sf):
    return rounded_table(D.top_shifts(_shift(spark, sf), 30).select("test_name", "feature", "standardized_mean_difference"), digits=4)


def shift_summary(spark, sf):
    return rounded_table(D.shift_summary(_shift(spark, sf)), digits=4)


def domain_scores(spark, sf):
    f = _with_language(spark, sf)
    return rounded_table(D.domain_scores(f, _cols(f)), ["domain", "n"], 4)


def kept_domains(spark, sf):
    f = _with_language(spark, sf)
    return D.drop_extreme_domains(f, _cols(f)).select("id", "domain")


def deviations(spark, sf):
    f = features(spark, sf)
    top = D.top_deviations(f, D.reference_statistics(f, _cols(f)), {"burst_word_count": 2.0}, 3)
    return f.select("id", F.posexplode(top).alias("rank", "e")).select("id", "rank", "e.feature", rounded(F.col("e.score"), 4).alias("score"))


def medians(spark, sf):
    f = features(spark, sf)
    q = quantiles(f, _cols(f), [0.5, 0.1, 0.9])
    return q.select("feature", *[rounded(F.col("quantiles")[i], 5).alias(n) for i, n in enumerate(("median", "q10", "q90"))])


def audit(spark, sf):
    f = features(spark, sf)
    return rounded_table(E.column_audit(f, _cols(f)), ["feature", "rows", "finite_count", "nan_count", "inf_count"], 4)


def clean_columns(spark, sf):
    f = features(spark, sf).join(cut_lineage(structure(spark, sf)), "id")
    cols = E.numeric_features(f)
    kept, _ = E.clean_columns(E.column_audit(f, cols), cols)
    return spark.createDataFrame([(c, E.feature_group(c)) for c in kept], "feature string, group string")


def _audited_columns():
    """All burstiness columns but the first two, and one that no table has."""
    return [*BCOLS[2:], "burst_absent"]


def audit_report(spark, sf):
    """What a check of a trained feature list finds, one row per finding."""
    found = E.audit_report(features(spark, sf), _audited_columns())
    rows = [(kind, name) for kind in ("unused", "missing", "constant", "drop_recommended") for name in found[kind]]
    rows += [(kind, str(found[kind])) for kind in ("nan_columns", "inf_columns")] + [(f"group {g}", str(n)) for g, n in found["group_counts"].items()]
    return spark.createDataFrame(rows, "finding string, feature string")


def merged(spark, sf):
    base = corpora.labelled(spark, sf).select("id", "label")
    wide = E.merge_families(base, [features(spark, sf).withColumn("burst_zipf_deviation_score", F.when(F.col("burst_word_count") > 100, F.col("burst_zipf_deviation_score")))])
    med = E.medians(wide, _cols(wide))
    return rounded_table(E.imputed(wide, _cols(wide), med), ["id", "label"], 5)


def pooled(spark, sf):
    f = features(spark, sf).select("id", "burst_word_count", "burst_sentence_count")
    pred = predictions(spark, sf).select("id", F.col("ai_probability").alias("burst_word_count"))
    return rounded_table(E.pooled_left_join(documents(spark, sf).select("id"), [pred, f]))


def one_to_one(spark, sf):
    f = features(spark, sf).select("id", "burst_word_count")
    j = E.join_one_to_one(corpora.meta(spark, sf).select("id", "label"), labels(spark, sf).select("id", "toxic"))
    return E.without_features(j, ["toxic"]).select("id").join(f, "id")


def error_summary(spark, sf):
    f = features(spark, sf).select("id", "burst_type_token_ratio", "burst_avg_sentence_length")
    p = R.joined_for_errors(called(spark, sf), labels(spark, sf).select("id", "label"), f)
    return rounded_table(R.error_summary(p, ["test_name"], features=["burst_type_token_ratio", "burst_avg_sentence_length"]), ["test_name", "n", "TP", "FP", "TN", "FN"], 4)


def top_errors(spark, sf):
    t = R.top_errors(called(spark, sf), ["test_name"], 30)
    return rounded_table(t.select("test_name", "rank", "id", "error_type", "wrong_confidence"), ["rank"], 5)


def error_rate_by_length(spark, sf):
    return rounded_table(R.error_rate_by_length(called(spark, sf)), ["length_bin", "n", "shortest", "longest"])


#: the source that no train definition uses
EXTERNAL = "en"


def report_predictions(spark, sf):
    """Scores of the held-out rows of every source by a detector trained on the training rows of each source but the external one."""

    def build():
        f = features(spark, sf).join(corpora.meta(spark, sf).select("id", "source_dataset"), "id").join(labels(spark, sf).select("id", "label"), "id").join(split_of(spark, sf), "id")
        rows = cut_lineage(f)
        train = lambda s: rows.filter((F.col("source_dataset") == s) & (F.col("split") == "train"))
        # one candidate: nothing is chosen on dev rows
        definitions = {f"train_{s}": (train(s), train(s)) for s in corpora.sources_of(rows) if s != EXTERNAL}
        tests = rows.filter("split <> 'train'").withColumn("test_name", F.col("source_dataset"))
        return P.run(rows, definitions, tests, _cols(f), [Mo.normal_bayes()])[0].withColumn("ai_probability", rounded(F.col("ai_probability"), 4))

    return stage(spark, sf, "report_predictions", build)


def report_scores(spark, sf):
    return report_predictions(spark, sf).select("train_name", "test_name", "id", "label", "n_train", "n_features", "ai_probability")


def metric_table(spark, sf):
    """Train x test metrics of these predictions."""
    table = M.detector_metrics(report_predictions(spark, sf), ["train_name", "test_name"]).select("train_name", "test_name", "n", "auroc", "auprc", "f1", "tpr_at_fpr_5pct")
    return cut_lineage(rounded_table(table, ["n"]).withColumn("method", F.lit("normal_bayes")))


def matrix(spark, sf):
    return R.pivot_matrix(metric_table(spark, sf), "auroc")


def external_drop(spark, sf):
    return rounded_table(R.external_drop(metric_table(spark, sf), EXTERNAL), digits=5)


def gap(spark, sf):
    sources = [s for s in corpora.sources_of(corpora.meta(spark, sf)) if s != EXTERNAL]
    return rounded_table(R.generalisation_gap(metric_table(spark, sf), {f"train_{s}": s for s in sources}, EXTERNAL), digits=5)


def best(spark, sf):
    return R.best_method(metric_table(spark, sf), ["test_name"], ["auroc", "auprc", "tpr_at_fpr_5pct", "f1"], "train_name").select("test_name", "train_name", "auroc")


def delta(spark, sf):
    t = metric_table(spark, sf)
    return rounded_table(R.against_reference(t.filter("train_name = 'train_de'"), t.filter("train_name = 'train_fr'"), ["test_name"]).select("test_name", "delta_auroc", "delta_auprc", "delta_f1"), digits=5)


def melt(spark, sf):
    return R.melted(metric_table(spark, sf), ["train_name", "test_name"], ["auroc", "f1"])


def collected(spark, sf):
    """Tables of two kinds as one, ranked."""
    m = corpora.meta(spark, sf)
    tables = {"language": m.groupBy("source_dataset").count(), "domain": m.groupBy("domain").count()}
    return R.ranked_results(R.collected(tables), ("count",))


def renamed_features(spark, sf):
    """Two feature columns under names of a model."""
    f = features(spark, sf).select("id", "burst_word_count", "burst_char_count")
    return E.renamed(f, prefix="m_", suffix="_v2")


def distribution(spark, sf):
    return R.distribution_json(corpora.meta(spark, sf), ["source_dataset"], "domain")


def risk(spark, sf):
    return predictions(spark, sf).select("id", risk_level(F.col("ai_probability")).alias("risk_level"))


def evidence(spark, sf):
    f = features(spark, sf)
    return f.select("id", F.array_join(R.evidence(f, f.columns), " ").alias("evidence"))


QUERIES = {
    "feature_shift": shift, "top_shifts": shift_top, "shift_summary": shift_summary, "domain_scores": domain_scores, "drop_extreme_domains": kept_domains,
    "top_deviations": deviations, "column_quantiles": medians, "column_audit": audit, "clean_columns": clean_columns, "audit_report": audit_report, "merge_and_impute": merged,
    "pooled_left_join": pooled, "join_one_to_one": one_to_one, "error_summary": error_summary, "top_errors": top_errors, "error_rate_by_length": error_rate_by_length,
    "report_scores": report_scores, "metric_matrix": matrix, "external_drop": external_drop, "generalisation_gap": gap, "best_method": best, "against_reference": delta, "melted_metrics": melt,
    "collected_results": collected, "renamed_features": renamed_features, "distribution_json": distribution, "risk_level": risk, "evidence": evidence,
}

FEAT = f"ft as materialized ({BURST_SQL.strip()})"
BCOLS = ["text_length", "char_count", "word_count", "sentence_count", "avg_sentence_length", "std_sentence_length", "sentence_length_cv", "max_sentence_length", "min_sentence_length",
         "punctuation_ratio", "comma_ratio", "period_ratio", "question_ratio", "exclamation_ratio", "paragraph_count", "avg_paragraph_length", "std_paragraph_length", "type_token_ratio",
         "repeated_char_ratio", "repeated_word_ratio", "zipf_deviation_score"]
BCOLS = [f"burst_{c}" for c in BCOLS]
LANG = f"{FEAT}, fl as (select ft.*, d.lang as test_name, d.source as domain from ft join documents d on ft.id = cast(d.doc_id as varchar))"
_LONG = lambda src, keep: f"select {keep}, unnest([{', '.join(repr(c) for c in BCOLS)}]) as feature, unnest([{', '.join(BCOLS)}]) as value from {src}"
SHIFT_SQL = f"""{LANG}, lo as materialized ({_LONG('fl', 'test_name')}),
 tr as (select feature, avg(value) as train_mean, var_samp(value) as train_variance, count(*) as n from lo where test_name = 'en' group by 1),
 te as (select test_name, feature, avg(value) as test_mean, var_samp(value) as test_variance, count(*) as n from lo where test_name <> 'en' group by all),
 tn as (select unnest(['de', 'es', 'fr']) as test_name),
 cu as (select tn.test_name, feature, value, count(*) filter (lo.test_name = 'en') as a, count(*) filter (lo.test_name = tn.test_name) as b from lo, tn where lo.test_name = 'en' or lo.test_name = tn.test_name group by all),
 ru as (select test_name, feature, sum(a) over w / sum(a) over p as fa, sum(b) over w / sum(b) over p as fb from cu window w as (partition by test_name, feature order by value), p as (partition by test_name, feature)),
 ks as (select test_name, feature, max(abs(fa - fb)) as ks from ru group by all),
 sh as (select te.test_name, te.feature, train_mean, train_variance, test_mean, test_variance, abs((test_mean - train_mean) / nullif(sqrt(train_variance), 0)) as standardized_mean_difference, ks as ks_statistic
   from te join tr using (feature) join ks using (test_name, feature))"""
_SC = ", ".join(f"avg({c}) as {c}" for c in BCOLS)
DOMAIN_SQL = f"""{LANG}, gm as (select {', '.join(f'avg({c}) as m{i}, nullif(stddev_samp({c}), 0) as s{i}' for i, c in enumerate(BCOLS))} from fl),
 pm as (select domain, count(*) as n, {_SC} from fl group by 1),
 ds as (select domain, n, case when n >= 30 then list_avg(list_filter([{', '.join(f'abs(({c} - m{i}) / s{i})' for i, c in enumerate(BCOLS))}], lambda x: x is not null)) end as score from pm, gm)"""
CALLED = f"{PRED_SQL}, cl as (select *, (ai_probability >= 0.5)::int as prediction from pred), er as (select *, label <> prediction as wrong, case when label = 1 and prediction = 1 then 'TP' when label = 0 and prediction = 1 then 'FP' when label = 0 and prediction = 0 then 'TN' else 'FN' end as error_type, case when label <> prediction then case when prediction = 1 then ai_probability else 1 - ai_probability end end as wrong_confidence from cl)"


def _matrix_sql():
    from .evaluation import metrics_sql

    return f"mt as materialized ({metrics_sql('pr', ['train_name', 'test_name'], extra_ctes=BAYES_SQL, select=['auroc', 'auprc', 'f1', 'tpr_at_fpr_5pct'])})"


# normal densities per source, class and feature, scaled by the source's deviation; Spark adds a small share of the largest variance
BAYES_SQL = f"""{corpora.META_SQL}, {SPLIT_SQL}, {FEAT}, fe as (select ft.*, m.source_dataset as test_name, l.quality as label, train from ft join meta m using (id) join labels l on ft.id = cast(l.doc_id as varchar) join sp using (id)),
 lo as materialized ({_LONG('fe', 'id, test_name, label, train')}),
 st as (select test_name as src, feature, avg(value) filter (label = 1) as m1, avg(value) filter (label = 0) as m0, var_pop(value) filter (label = 1) as v1, var_pop(value) filter (label = 0) as v0, stddev_samp(value) as sd, count(*) as n_train
   from lo where train and test_name <> '{EXTERNAL}' group by all having count(distinct label) = 2),
 ep as (select src, 1e-9 * max(((v1 + v0) / 2 + (m1 - m0) ** 2 / 4) / (sd * sd)) as eps from st where sd > 0 group by 1),
 dn as (select *, v1 / (sd * sd) + eps as s1, v0 / (sd * sd) + eps as s0 from st join ep using (src) where sd > 0),
 od as (select 'train_' || src as train_name, test_name, id, label, any_value(n_train) as n_train, sum(((value - m0) / sd) ** 2 / (2 * s0) - ((value - m1) / sd) ** 2 / (2 * s1) + (ln(s0) - ln(s1)) / 2) as odds
   from lo join dn using (feature) where not train group by all),
 pr as (select *, {R6('1 / (1 + exp(-greatest(-700, least(700, odds))))', 4)} as ai_probability from od)"""
MATRIX = _matrix_sql()
_Q3 = lambda k, n: f"quantile_cont(ai_probability, {k}) filter (label = {n})"
ORACLES = {
    "collected_results": f"with {corpora.META_SQL} select source_dataset, null as domain, count(*) as count, 'language' as experiment from meta group by 1 union all select null, domain, count(*), 'domain' from meta group by 2",
    "renamed_features": f"with {FEAT} select id, burst_word_count as m_burst_word_count_v2, burst_char_count as m_burst_char_count_v2 from ft",
    "feature_shift": f"with {SHIFT_SQL} select test_name, feature, " + ", ".join(f"{R6(c, 4)} as {c}" for c in ("train_mean", "train_variance", "test_mean", "test_variance", "standardized_mean_difference", "ks_statistic")) + " from sh",
    "top_shifts": f"with {SHIFT_SQL}, rk as (select *, row_number() over (partition by test_name order by standardized_mean_difference desc nulls last, ks_statistic desc, feature) as r from sh) select test_name, feature, {R6('standardized_mean_difference', 4)} as standardized_mean_difference from rk where r <= 30",
    "shift_summary": f"with {SHIFT_SQL} select test_name, {R6('avg(standardized_mean_difference)', 4)} as mean_smd, {R6('avg(ks_statistic)', 4)} as mean_ks from sh group by 1",
    "domain_scores": f"with {DOMAIN_SQL} select domain, n, {R6('score', 4)} as score from ds",
    "drop_extreme_domains": f"with {DOMAIN_SQL} select id, domain from fl where domain in (select domain from ds where score <= (select quantile_cont(score, 0.9) from ds))",
    "top_deviations": f"with {FEAT}, lo as ({_LONG('ft', 'id')}), st as (select feature, median(value) as md, stddev_pop(value) as sd from lo group by 1), sc as (select id, feature, abs(value - md) / sd * case when feature = 'burst_word_count' then 2 else 1 end as score from lo join st using (feature) where sd > 0), rk as (select *, row_number() over (partition by id order by score desc, feature desc) as r from sc) select id, (r - 1)::int as rank, feature, {R6('score', 4)} as score from rk where r <= 3",
    "column_quantiles": f"with {FEAT}, lo as ({_LONG('ft', 'id')}) select feature, {R6('median(value)', 5)} as median, {R6('quantile_cont(value, 0.1)', 5)} as q10, {R6('quantile_cont(value, 0.9)', 5)} as q90 from lo group by 1",
    "column_audit": f"with {FEAT}, lo as ({_LONG('ft', 'id')}) select feature, count(*) as rows, count(value) as finite_count, count(*) filter (value is null) as nan_count, 0::bigint as inf_count, {R6('min(value)', 4)} as lowest, {R6('max(value)', 4)} as highest, {R6('stddev_samp(value)', 4)} as std from lo group by 1",
    "clean_columns": f"""with {FEAT}, st as materialized ({STRUCT_SQL.strip()}), sn as (select columns('^struct_.*')::double from st),
      sl as (select feature, value from sn unpivot include nulls (value for feature in (columns(*)))),
      bl as ({_LONG('ft', 'id')}), lo as (select feature, value from bl union all select feature, value from sl)
      select feature, case when feature like 'burst%' then 'burstiness' else 'structure' end as "group" from lo group by feature
      having count(value) > 0 and count(*) filter (isinf(value)) = 0 and min(value) < max(value)""",
    "audit_report": f"""with {FEAT}, lo as ({_LONG('ft', 'id')}), co as (select feature, count(*) filter (value is null) as nulls, count(*) filter (isinf(value)) as infs, min(value) as a, max(value) as b from lo group by 1),
      us as (select * from co where feature in ({', '.join(repr(c) for c in BCOLS[2:])})),
      cs as (select feature from us where a = b)
      select 'unused' as finding, feature from co where feature not in (select feature from us) union all select 'missing', 'burst_absent'
      union all select 'constant', feature from cs union all select 'drop_recommended', feature from cs union all select 'drop_recommended', 'burst_absent'
      union all select 'nan_columns', cast(count(*) filter (nulls > 0) as varchar) from us union all select 'inf_columns', cast(count(*) filter (infs > 0) as varchar) from us
      union all select 'group burstiness', cast(count(*) as varchar) from us""",
    "merge_and_impute": f"with {FEAT}, ba as (select cast(doc_id as varchar) as id, quality as label from labels), jo as (select ba.id, label, ft.* exclude (id) replace (case when burst_word_count > 100 then burst_zipf_deviation_score end as burst_zipf_deviation_score) from ba left join ft on ba.id = ft.id), md as (select {', '.join(f'coalesce(median({c}), 0) as m_{c}' for c in BCOLS)} from jo) select id, label, {', '.join(R6(f'coalesce({c}, m_{c})', 5) + f' as {c}' for c in BCOLS)} from jo, md",
    "pooled_left_join": f"with {FEAT}, {PRED_SQL} select d.id, {R6('coalesce(p.ai_probability, f.burst_word_count)')} as burst_word_count, {R6('case when p.id is null then f.burst_sentence_count end')} as burst_sentence_count from (select cast(doc_id as varchar) as id from documents) d left join pred p on d.id = p.id left join ft f on d.id = f.id",
    "join_one_to_one": f"with {FEAT} select id, burst_word_count from ft where id not in (select cast(doc_id as varchar) from labels)",
    "error_summary": f"""with {FEAT}, {CALLED} select test_name, count(*) as n, {', '.join(f"count(*) filter (error_type = '{k}') as {k}" for k in ('TP', 'FP', 'TN', 'FN'))}, {R6('avg(ai_probability) filter (label = 0)', 4)} as human_prob_mean, {R6('avg(ai_probability) filter (label = 1)', 4)} as ai_prob_mean,
      {R6('avg(text_length) filter (wrong)', 4)} as wrong_text_length_mean, {', '.join(f"{R6(_Q3(q, k), 4)} as {s}_prob_{n}" for k, s in ((0, 'human'), (1, 'ai')) for q, n in ((0.5, 'median'), (0.1, 'q10'), (0.9, 'q90')))},
      coalesce(avg(ai_probability) filter (label = 1) < avg(ai_probability) filter (label = 0), false) as prob_direction_reversed, {R6('(avg(burst_type_token_ratio) filter (wrong) + avg(burst_avg_sentence_length) filter (wrong)) / 2', 4)} as wrong_probability_feature_mean
      from er join ft using (id) group by 1""",
    "top_errors": f"with {CALLED}, rk as (select *, row_number() over (partition by test_name order by wrong_confidence desc, id) as rank from er where wrong) select test_name, rank::int as rank, id, error_type, {R6('wrong_confidence', 5)} as wrong_confidence from rk where rank <= 30",
    "error_rate_by_length": f"with {CALLED}, cu as (select quantile_cont(text_length, [0.2, 0.4, 0.6, 0.8]) as q from er), bn as (select *, (text_length > q[1])::int + (text_length > q[2])::int + (text_length > q[3])::int + (text_length > q[4])::int as length_bin from er, cu) select length_bin, count(*) as n, min(text_length)::int as shortest, max(text_length)::int as longest, {R6('avg(wrong::int)')} as error_rate from bn group by 1",
    "report_scores": f"with {BAYES_SQL} select train_name, test_name, id, label, n_train, {len(BCOLS)} as n_features, ai_probability from pr",
    "metric_matrix": f"with {MATRIX} select train_name, " + ", ".join(f"max(auroc) filter (test_name = '{k}') as {k}" for k in ("de", "en", "es", "fr")) + " from mt group by 1",
    "external_drop": f"with {MATRIX} select train_name, " + ", ".join(f"{R6(f'avg({m}) filter (test_name <> {chr(39)}en{chr(39)})', 5)} as {m}_public_mean, {R6(f'max({m}) filter (test_name = {chr(39)}en{chr(39)})', 5)} as {m}_external, {R6(f'avg({m}) filter (test_name <> {chr(39)}en{chr(39)}) - max({m}) filter (test_name = {chr(39)}en{chr(39)})', 5)} as {m}_drop" for m in ("auroc", "auprc", "f1")) + " from mt group by 1",
    "generalisation_gap": f"""with {MATRIX}, gp as (select train_name, 'normal_bayes' as method, max(auroc) filter (test_name = right(train_name, 2)) as s, avg(auroc) filter (test_name <> right(train_name, 2) and test_name <> 'en') as c, max(auroc) filter (test_name = 'en') as e from mt group by 1)
      select train_name, method, {R6('s', 5)} as same_source, {R6('c', 5)} as mean_cross_source, {R6('e', 5)} as external, {R6('s - e', 5)} as same_to_external_gap, {R6('c - e', 5)} as cross_to_external_gap from gp""",
    "best_method": f"with {MATRIX} select test_name, train_name, auroc from (select *, row_number() over (partition by test_name order by auroc desc nulls last, auprc desc nulls last, tpr_at_fpr_5pct desc nulls last, f1 desc, train_name desc) as r from mt) where r = 1",
    "against_reference": f"with {MATRIX} select a.test_name, " + ", ".join(f"{R6(f'a.{m} - b.{m}', 5)} as delta_{m}" for m in ("auroc", "auprc", "f1")) + " from mt a join mt b on a.test_name = b.test_name and a.train_name = 'train_de' and b.train_name = 'train_fr'",
    "melted_metrics": f"with {MATRIX} select train_name, test_name, 'auroc' as metric, auroc as value from mt union all select train_name, test_name, 'f1', f1 from mt",
    "distribution_json": "select lang as source_dataset, '{' || string_agg('\"' || source || '\":' || c, ',' order by source) || '}' as domain_distribution from (select lang, source, count(*) as c from documents group by all) group by 1",
    "risk_level": f"with {PRED_SQL} select id, case when ai_probability < 0.35 then 'Low' when ai_probability < 0.7 then 'Medium' else 'High' end as risk_level from pred",
    "evidence": f"with {FEAT} select id, case when burst_std_sentence_length < 3 and burst_sentence_count >= 2 then '{V.EVIDENCE_SENTENCES}' else '{V.EVIDENCE_NONE}' end as evidence from ft",
}

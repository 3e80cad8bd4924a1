"""Queries over prediction tables. The scores are document features, so both engines see the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories as K, text as X
from ..functions.columns import ratio, rounded_table
from ..operators import metrics as M, resampling as S
from ..operators.features import document_features
from .documents import DOCS, R6, RATIO, TOKENS
from .tables import documents, labels

PRED_SQL = f"""{DOCS}, tk as (select id, t, list_transform({TOKENS('t')}, lambda w: lower(w)) as w from docs),
 pred as (select tk.id, d.lang as test_name, d.source as domain, l.quality as label, length(t) as text_length,
   round({RATIO('len(list_distinct(w))', 'len(w)')}, 3) as ai_probability, least(1.0::double, round(length(t) / 5000.0::double, 3)) as other
   from tk join labels l on tk.id = cast(l.doc_id as varchar) join documents d on d.doc_id = l.doc_id)"""


def predictions(spark, sf):
    d = X.cleaned(documents(spark, sf))
    w = F.transform(X.tokens(F.col("text")), F.lower)
    scored = d.select("id", F.col("source_dataset").alias("test_name"), "domain", F.length("text").alias("text_length"),
                      F.round(ratio(F.size(F.array_distinct(w)), F.size(w)), 3).alias("ai_probability"),
                      F.least(F.lit(1.0), F.round(F.length("text") / F.lit(5000.0), 3)).alias("other"))
    return scored.join(labels(spark, sf).select("id", "label"), "id")


_r = rounded_table


CELL = ["test_name"]


def detector_metrics(spark, sf):
    return _r(M.detector_metrics(predictions(spark, sf), CELL), {"test_name", "n"})


def detector_metrics_all(spark, sf):
    return _r(M.detector_metrics(predictions(spark, sf)), {"n"})


def roc(spark, sf):
    return _r(M.roc_curve(predictions(spark, sf), CELL), {"test_name"})


def pr(spark, sf):
    return _r(M.pr_curve(predictions(spark, sf), CELL), {"test_name"})


def calibration(spark, sf):
    return _r(M.calibration_bins(M.score_counts(predictions(spark, sf), CELL), CELL), {"test_name", "bin_index", "count"})


def thresholds(spark, sf):
    return _r(M.choose_thresholds(predictions(spark, sf), CELL), {"test_name", "rule"})


def thresholds_applied(spark, sf):
    p = predictions(spark, sf)
    dev = p.filter("domain < 'src2'")
    chosen = M.threshold_for_fpr(dev, 0.05)
    return _r(M.detector_metrics(M.apply_thresholds(p.filter("domain >= 'src2'"), chosen.select("threshold"), []), prediction="prediction").select("n", "tpr", "fpr", "f1", "accuracy"), {"n"})


def confusion(spark, sf):
    p = predictions(spark, sf).withColumn("prediction", (F.col("ai_probability") >= 0.5).cast("int"))
    return M.confusion(p, CELL)


def class_report(spark, sf):
    p = predictions(spark, sf).withColumn("prediction", (F.col("ai_probability") >= 0.5).cast("int"))
    return _r(M.class_report(p, CELL), {"test_name", "class", "support"})


def bootstrap(spark, sf):
    return _r(M.bootstrap_intervals(predictions(spark, sf), CELL, replicates=200), {"test_name"})


def multinomial(spark, sf):
    return _r(S.multinomial_intervals(predictions(spark, sf), CELL, replicates=200), {"test_name"})


def bootstrap_sizes(spark, sf):
    """Every replicate draws as many rows as its cell has, and from its own scores only."""
    p = predictions(spark, sf)
    drawn = S.multinomial_draws(p, CELL, replicates=200).withColumn("score", F.round("score", 6))
    own = M.score_counts(p, CELL).select(*CELL, F.round("score", 6).alias("score"), (F.col("pos") > 0).alias("has_pos"), (F.col("neg") > 0).alias("has_neg"))
    known = drawn.join(own, [*CELL, "score"], "left")
    wrong = ((F.col("pos") > 0) & ~F.coalesce("has_pos", F.lit(False))) | ((F.col("neg") > 0) & ~F.coalesce("has_neg", F.lit(False)))
    return known.groupBy(*CELL, "replicate").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum(wrong.cast("long")).alias("n_foreign"))


def two_scores(spark, sf):
    """Two prediction tables of the same rows, joined."""
    p = predictions(spark, sf)
    return M.joined_scores(p.drop("other"), p.select("id", F.col("other").alias("ai_probability")))


def fusion(spark, sf):
    return _r(M.fusion_table(two_scores(spark, sf), "score_a", "score_b", CELL).select("test_name", "alpha", "auprc", "auroc", "f1"), {"test_name"})


def fusion_choice(spark, sf):
    return _r(M.choose_alpha(M.fusion_table(two_scores(spark, sf), "score_a", "score_b")).select("alpha"), set())


def score_average(spark, sf):
    return _r(M.detector_metrics(M.averaged(predictions(spark, sf), "ai_probability", "other")).select("n", "auroc", "auprc", "brier_score"), {"n"})


QUERIES = {
    "detector_metrics": detector_metrics, "detector_metrics_all": detector_metrics_all, "roc_curve": roc, "pr_curve": pr, "calibration_bins": calibration,
    "choose_thresholds": thresholds, "threshold_for_fpr": thresholds_applied, "confusion_matrix": confusion, "class_report": class_report,
    "bootstrap_intervals": bootstrap, "multinomial_intervals": multinomial, "bootstrap_sizes": bootstrap_sizes, "fusion_table": fusion, "fusion_choice": fusion_choice, "score_average": score_average,
}


def metrics_sql(source, cells, score="ai_probability", hat=None, extra_ctes="", select=None):
    """DuckDB metrics of ``source``: straightforward window sums."""
    g = ", ".join(cells)
    by = f"partition by {g} " if g else ""
    gb = f"group by {g}" if g else ""
    pre = f"{g}, " if g else ""
    hat = hat or "s >= 0.5"
    edges = "[" + ", ".join(repr(i * 0.1) + "::double" for i in range(1, 10)) + "]"
    join = f"using ({g})" if g else "on true"
    zero = lambda v: f"coalesce({v}, 0)"
    cols = {
        "positive_class_rate": "P / (P + N)", "mean_ai_probability_human": "sn / nullif(N, 0)", "mean_ai_probability_ai": "sp / nullif(P, 0)",
        "auroc": "wins / nullif(P * N, 0)", "auprc": "case when P > 0 and N > 0 then ap / P end", "accuracy": "(TP + N - FP) / (P + N)",
        "balanced_accuracy": "case when P > 0 and N > 0 then (TP / P + (N - FP) / N) / 2 else coalesce(TP / nullif(P, 0), (N - FP) / nullif(N, 0)) end",
        "precision": zero("TP / nullif(TP + FP, 0)"), "recall": zero("TP / nullif(P, 0)"), "tpr": zero("TP / nullif(P, 0)"),
        "specificity": zero("(N - FP) / nullif(N, 0)"), "tnr": zero("(N - FP) / nullif(N, 0)"), "f1": zero("2 * TP / nullif(TP + FP + P, 0)"),
        "mcc": zero("(TP * (N - FP) - FP * (P - TP)) / nullif(sqrt((TP + FP) * P * N * (N - FP + P - TP)), 0)"),
        "fpr": zero("FP / nullif(N, 0)"), "fnr": zero("(P - TP) / nullif(P, 0)"),
        **{f"tpr_at_fpr_{k}pct": f"case when P > 0 and N > 0 then coalesce(t{k}, 0) end" for k in (1, 5, 10)},
        **{f"fpr_at_tpr_{k}pct": f"case when P > 0 and N > 0 then f{k} end" for k in (90, 95)},
        "brier_score": "sq / (P + N)", "expected_calibration_error": "ece", "ECE": "ece", "log_loss": "ll / (P + N)",
    }
    wanted = select or list(cols)
    return f"""with {extra_ctes},
 sc as (select {pre}greatest(0, least(1, {score}::double)) as s, label as y from {source}),
 sh as (select *, ({hat}) as h from sc),
 cn as (select {pre}s, count(*) filter (y = 1)::double as pos, count(*) filter (y = 0)::double as neg, count(*) filter (y = 1 and h)::double as hp, count(*) filter (y = 0 and h)::double as hn from sh group by {pre}s),
 tt as (select {pre}sum(pos) as P, sum(neg) as N from cn {gb}),
 rn as (select cn.*, P, N, sum(pos) over ({by}order by s desc) as tp, sum(neg) over ({by}order by s desc) as fp from cn join tt {join}),
 su as (select {pre}any_value(P) as P, any_value(N) as N, sum(hp) as TP, sum(hn) as FP, sum(s * pos) as sp, sum(s * neg) as sn, sum(neg * (tp - pos / 2)) as wins, sum(pos * tp / (tp + fp)) as ap,
   sum(pos * (s - 1) * (s - 1) + neg * s * s) as sq,
   sum(-pos * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, s))) - neg * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, s)))) as ll,
   {', '.join(f"max(case when fp / nullif(N, 0) <= {k / 100} + 1e-12 then tp / nullif(P, 0) end) as t{k}" for k in (1, 5, 10))},
   {', '.join(f"min(case when tp / nullif(P, 0) >= {k / 100} - 1e-12 then fp / nullif(N, 0) end) as f{k}" for k in (90, 95))} from rn {gb}),
 bn as (select {pre}len(list_filter({edges}, lambda e: e <= s)) as b, sum(pos + neg) as c, sum(s * (pos + neg)) as ss, sum(pos) as pp from cn group by {pre}b),
 ec as (select {pre}sum(abs(ss / c - pp / c) * c) / sum(c) as ece from bn {gb})
 select {pre}cast(P + N as bigint) as n, {', '.join(f"{R6(cols[m])} as {m}" for m in wanted)} from su join ec {join}"""


_RANKED = f"""{PRED_SQL}, cn as (select test_name, ai_probability as s, count(*) filter (label = 1)::double as pos, count(*) filter (label = 0)::double as neg from pred group by 1, 2),
 rn as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by test_name) as P, sum(neg) over (partition by test_name) as N from cn window w as (partition by test_name order by s desc))"""
_BOOT = ", ".join(f"({b}, {pow(M.MULTIPLIER, b + 1, M.MODULUS)})" for b in range(200))
_POI = " + ".join(f"(u >= {c!r}::double)::int" for c in M.POISSON)
_ALPHA = ", ".join(f"({a!r}::double)" for a in M.ALPHAS)
FUSED = f"{PRED_SQL}, al(alpha) as (values {_ALPHA}), fu as (select pred.* exclude (ai_probability), alpha, alpha * ai_probability + (1 - alpha) * other as ai_probability from pred, al)"
_FUSE_ALL = metrics_sql("fu", ["alpha"], extra_ctes=FUSED, select=["auprc", "auroc", "f1"])

ORACLES = {
    "detector_metrics": metrics_sql("pred", CELL, extra_ctes=PRED_SQL),
    "detector_metrics_all": metrics_sql("pred", [], extra_ctes=PRED_SQL),
    "roc_curve": f"""with {_RANKED} select test_name, {R6('fp / N')} as fpr, {R6('tp / P')} as tpr, {R6('s')} as threshold from rn where P > 0 and N > 0
      union all select distinct test_name, 0.0::double, 0.0::double, 'inf'::double from rn where P > 0 and N > 0""",
    "pr_curve": f"""with {_RANKED} select test_name, {R6('tp / P')} as recall, {R6('tp / (tp + fp)')} as precision, {R6('s')} as threshold from rn where P > 0 and N > 0
      union all select distinct test_name, 0.0::double, 1.0::double, null from rn where P > 0 and N > 0""",
    "calibration_bins": f"""with {PRED_SQL}, ed as (select b::int as bin_index, [0.0::double, {', '.join(repr(i * 0.1) + '::double' for i in range(1, 10))}, 1.0::double] as e from range(10) t(b)),
      cells as (select distinct test_name from pred)
      select c.test_name, bin_index, {R6('any_value(e[bin_index + 1])')} as bin_left, {R6('any_value(e[bin_index + 2])')} as bin_right, count(p.id) as count,
       {R6('avg(ai_probability)')} as mean_predicted_probability, {R6('avg(label)')} as observed_positive_rate, {R6('abs(avg(ai_probability) - avg(label))')} as abs_calibration_gap
      from cells c cross join ed left join pred p on p.test_name = c.test_name and ai_probability >= e[bin_index + 1] and (ai_probability < e[bin_index + 2] or (bin_index = 9 and ai_probability <= 1))
      group by 1, 2""",
    "choose_thresholds": f"""with {_RANKED}, f as (select *, tp / (tp + fp) as pr, tp / P as rc, fp / nullif(N, 0) as fr from rn),
      g as (select *, 2 * pr * rc / greatest(pr + rc, 1e-12::double) as f1 from f), c as (select distinct test_name from f),
      b as (select test_name, s, row_number() over (partition by test_name order by f1 desc, s) as k from g)
      select test_name, 'default_threshold' as rule, 0.5::double as threshold from c
      union all select test_name, 'best_f1_threshold', {R6('s')} from b where k = 1
      """ + " ".join(f"""union all select c.test_name, 'target_fpr_{k}pct_threshold', {R6(f"coalesce((select s from f where f.test_name = c.test_name and fr <= {k / 100} + 1e-12 and rc > 0 order by rc desc, s desc limit 1), 1)")} from c""" for k in (1, 5, 10)),
    "threshold_for_fpr": metrics_sql("(select * from pred where domain >= 'src2')", [], hat="s >= (select th from th)", select=["tpr", "fpr", "f1", "accuracy"],
        extra_ctes=f"""{PRED_SQL}, dv as (select ai_probability as s, count(*) filter (label = 1)::double as pos, count(*) filter (label = 0)::double as neg from pred where domain < 'src2' group by 1),
        dr as (select *, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp, sum(neg) over () as N from dv),
        th as (select coalesce((select s from dr where fp / N <= 0.05 + 1e-12 and tp > 0 order by tp desc, s desc limit 1), 1.0) as th)"""),
    "confusion_matrix": f"with {PRED_SQL} select test_name, label, (ai_probability >= 0.5)::int as prediction, count(*) as n from pred group by all",
    "class_report": f"""with {PRED_SQL}, q as (select *, (ai_probability >= 0.5)::int as h from pred), k(class) as (values (0), (1)),
      a as (select test_name, class, count(*) filter (label = class and h = class)::double as tp, count(*) filter (h = class) as c, count(*) filter (label = class) as support from q, k group by 1, 2)
      select test_name, class, {R6('coalesce(tp / nullif(c, 0), 0)')} as precision, {R6('coalesce(tp / nullif(support, 0), 0)')} as recall, {R6('coalesce(2 * tp / nullif(c + support, 0), 0)')} as f1, support from a""",
    "bootstrap_intervals": f"""with {PRED_SQL}, bs(b, m) as (values {_BOOT}),
      x as (select *, (('0x' || substr(md5(id || ':42'), 1, 8))::bigint % {M.MODULUS - 1}) + 1 as x from pred),
      u as (select test_name, b, label as y, ai_probability as s, ((x * m) % {M.MODULUS}) / {M.MODULUS}.0::double as u from x, bs),
      w as (select *, {_POI} as w from u),
      cn as (select test_name, b, s, sum(case when y = 1 then w else 0 end)::double as pos, sum(case when y = 0 then w else 0 end)::double as neg from w where w > 0 group by 1, 2, 3),
      rn as (select *, sum(pos) over o as tp, sum(neg) over o as fp from cn window o as (partition by test_name, b order by s desc)),
      su as (select test_name, b, sum(pos) as P, sum(neg) as N, coalesce(sum(pos) filter (s >= 0.5), 0) as TP, coalesce(sum(neg) filter (s >= 0.5), 0) as FP, sum(neg * (tp - pos / 2)) as wins, sum(pos * tp / (tp + fp)) as ap from rn group by 1, 2),
      ms as (select test_name, wins / nullif(P * N, 0) as auroc, case when P > 0 and N > 0 then ap / P end as auprc, coalesce(2 * TP / nullif(TP + FP + P, 0), 0) as f1 from su)
      select test_name, """ + ", ".join(f"{R6(f'quantile_cont({m}, {q})')} as {m}_ci_{n}" for m in ("auroc", "auprc", "f1") for q, n in ((0.025, "low"), (0.975, "high"))) + " from ms group by 1",
    "bootstrap_sizes": f"with {PRED_SQL} select test_name, cast(b as int) as replicate, count(*) as n, cast(0 as bigint) as n_foreign from pred cross join range(200) r(b) group by 1, 2",
    "fusion_table": "select * exclude (n, alpha), " + R6("alpha") + " as alpha from (" + metrics_sql("fu", ["test_name", "alpha"], extra_ctes=FUSED, select=["auprc", "auroc", "f1"]) + ")",
    "fusion_choice": f"select {R6('alpha')} as alpha from ({_FUSE_ALL}) order by auprc desc, auroc desc, f1 desc, alpha limit 1",
    "score_average": metrics_sql("(select id, label, 0.5 * ai_probability + 0.5 * other as ai_probability from pred)", [], extra_ctes=PRED_SQL, select=["auroc", "auprc", "brier_score"]),
}

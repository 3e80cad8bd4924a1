"""Queries over per-token losses: probability features, contrasts, scale response, transition profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.columns import rounded, rounded_table
from ..operators import corpus as C, scale as S, surprise as L, transition as X
from ..session import cut_lineage
from .corpora import META_SQL, meta
from .documents import DOCS, R6, RATIO, TOKENS
from .tables import documents, stage, table


def split_of(spark, sf):
    return C.train_test_split(meta(spark, sf), label="source_dataset").select("id", "split")


def _packed(spark, sf):
    """Packed losses of all documents, trained on the training split."""

    def build():
        train = split_of(spark, sf).filter("split = 'train'").select("id", F.lit(True).alias("_train")).distinct()
        docs = documents(spark, sf).select("id", "text").join(train, "id", "left")
        return L.packed_within(docs.withColumn("_train", F.coalesce("_train", F.lit(False))), "_train")

    return stage(spark, sf, "losses", build, written=True)


def losses(spark, sf):
    """Token-loss table of all documents, trained on the training split."""
    return _packed(spark, sf).unpacked()


def train_losses(spark, sf):
    """The token losses of the training split."""
    return _packed(spark, sf).unpacked(learned=True)


_rounded = rounded_table


def token_losses(spark, sf):
    l = losses(spark, sf)
    return l.select("id", F.posexplode(F.arrays_zip("ng1", "ng2", "ng3", "ng4"))).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), *[rounded(F.sum(f"col.{m}"), 3).alias(m) for m in ("ng1", "ng2", "ng3", "ng4")])


def loss_records(spark, sf):
    r = L.loss_records(losses(spark, sf), documents(spark, sf))
    return r.select("id", "model_name", F.col("token_count").cast("long").alias("token_count"), "text_hash",
                    rounded(A.total(F.col("rank_sequence")), 3).alias("rank_sum"), rounded(A.total(F.col("prob_sequence")), 3).alias("prob_sum"),
                    rounded(F.try_element_at("rank_sequence", F.lit(-1)), 5).alias("last_rank"))


def probability(spark, sf):
    return _rounded(L.loss_statistics(losses(spark, sf)))


def contrasts(spark, sf):
    return _rounded(L.contrasts(_rounded(L.loss_statistics(losses(spark, sf))), [("ng1", "ng2"), ("ng2", "ng4")]))


def _scale_table(spark, sf):
    return S.scale_columns(cut_lineage(_rounded(L.loss_statistics(losses(spark, sf)))))


def scale_response(spark, sf):
    merged, scales, metrics = _scale_table(spark, sf)
    out = S.scale_response(merged, scales, metrics)
    return _rounded(out, digits=lambda c: 3 if "ratio" in c or "rel_delta" in c or "ppl" in c else 5)


def train_bins_of(spark, sf, model="ng2"):
    return X.train_bins(train_losses(spark, sf), model)


def loss_bins(spark, sf):
    b = train_bins_of(spark, sf)
    rows = [(k, n, i, v) for k, per in b.items() for n, cuts in per.items() for i, v in enumerate(cuts)]
    return spark.createDataFrame(rows, "encoding string, n_states int, cut int, value double").withColumn("value", rounded(F.col("value"), 5))


def transition_full(spark, sf):
    return _rounded(X.full_profiles(losses(spark, sf), "ng2", train_bins_of(spark, sf), "ng2", with_gap=False))


def transition_formal(spark, sf):
    return _rounded(X.formal_profiles(losses(spark, sf), "ng2", train_bins_of(spark, sf)["raw"], "ng2", with_gap=False))


def transition_own(spark, sf):
    return _rounded(X.own_profiles(losses(spark, sf), "ng2", "ng2", with_gap=False))


def transition_gap(spark, sf):
    p = X.full_profiles(losses(spark, sf), "ng2", train_bins_of(spark, sf), "ng2")
    return _rounded(p.select("id", *[c for c in p.columns if c.endswith("spectral_gap")]))


def transition_gap_three(spark, sf):
    """The gap of the three-state chains, whose cubic has a closed form."""
    codings = {p: c for p, c in X.full_codings(train_bins_of(spark, sf), "ng2").items() if c.states == 3}
    p = X.coded_profiles(X.values_of(losses(spark, sf), "ng2"), codings)
    return rounded_table(p.select("id", *[c for c in p.columns if c.endswith("_spectral_gap")]), digits=4)


def transition_delta(spark, sf):
    one = {m: _rounded(X.own_profiles(losses(spark, sf), m, m, with_gap=False)) for m in ("ng1", "ng2")}
    return _rounded(X.column_delta(one["ng1"], one["ng2"], "ng1", "ng2"))


def event_profiles(spark, sf):
    """Values of each user along time, in 3, 5 and 7 states."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return _rounded(X.long_profiles(e, "user_id", "ts", "value", X.fit_bins(e, ["value"])["value"], "value", with_gap=False, ties=["event_id"]), ["user_id"])


QUERIES = {
    "token_losses": token_losses, "loss_records": loss_records, "features_probability": probability, "features_contrast": contrasts,
    "features_scale_response": scale_response, "loss_bins": loss_bins, "transition_full": transition_full, "transition_formal": transition_formal,
    "transition_own": transition_own, "transition_spectral_gap": transition_gap, "spectral_gap_three": transition_gap_three, "transition_delta": transition_delta, "event_profiles": event_profiles,
}

NG = ("ng1", "ng2", "ng3", "ng4")
_MIX = lambda n: "0.01::double / (v + 1.0::double)" + "".join(f" + {(1 - L.FLOOR) * 2.0 ** (k - 1) / (2.0 ** n - 1)!r}::double * coalesce(p{k}, 0)" for k in range(1, n + 1))
SPLIT_SQL = """sp as (select id, r <= floor(n * 0.8::double + 0.5) as train from (select id, row_number() over (partition by source_dataset order by md5(id || ':42'), id) as r,
  count(*) over (partition by source_dataset) as n from meta))"""
LOSS_SQL = f"""{META_SQL}, {SPLIT_SQL}, {DOCS}, tk as (select id, list_transform({TOKENS('t')}, lambda w: lower(w)) as w from docs),
 ps as (select id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as a from tk),
 g as (select id, pos, a, lag(a, 1) over o as b, lag(a, 2) over o as c, lag(a, 3) over o as d from ps window o as (partition by id order by pos)),
 tr as (select g.* from g join sp using (id) where train),
 c1 as (select a, count(*)::double as k from tr group by 1), n1 as (select sum(k) as n, count(*) as v from c1),
 c2 as (select b, a, count(*)::double as k from tr where pos >= 1 group by all), x2 as (select b, sum(k) as n from c2 group by 1),
 c3 as (select c, b, a, count(*)::double as k from tr where pos >= 2 group by all), x3 as (select c, b, sum(k) as n from c3 group by all),
 c4 as (select d, c, b, a, count(*)::double as k from tr where pos >= 3 group by all), x4 as (select d, c, b, sum(k) as n from c4 group by all),
 q2 as (select b, a, k / n as p2 from c2 join x2 using (b)), q3 as (select c, b, a, k / n as p3 from c3 join x3 using (c, b)), q4 as (select d, c, b, a, k / n as p4 from c4 join x4 using (d, c, b)),
 pr as (select id, pos, c1.k / n1.n as p1, p2, p3, p4, v from g left join c1 using (a) cross join n1 left join q2 using (b, a) left join q3 using (c, b, a) left join q4 using (d, c, b, a) where pos >= 1),
 ls as materialized (select id, pos, {', '.join(f"round(-ln({_MIX(n)}), 6) as ng{n}" for n in range(1, 5))} from pr)"""


def _stats_cols(m):
    k = f"greatest(1, ceil(count({m}) * 0.1::double)::int)"
    top, bottom = f"list_avg(list_sort(list({m}), 'desc')[1:{k}])", f"list_avg(list_sort(list({m}))[1:{k}])"
    return f"""avg({m}) as {m}_a, stddev_pop({m}) as {m}_s, min({m}) as {m}_lo, max({m}) as {m}_hi, {top} as {m}_top, {bottom} as {m}_bot, count({m}) as {m}_n,
      (avg({m} * {m} * {m}) - 3 * avg({m}) * avg({m} * {m}) + 2 * avg({m}) * avg({m}) * avg({m})) as {m}_m3, case when count({m}) > 3 and max({m}) > min({m}) then kurtosis_pop({m}) else 0 end as {m}_ku"""


def _stats_out(m):
    vals = {
        "ppl": f"exp(least({m}_a, 50))", "loss_mean": f"{m}_a", "loss_std": f"{m}_s", "loss_cv": RATIO(f"{m}_s", f"{m}_a"), "loss_min": f"{m}_lo", "loss_max": f"{m}_hi",
        "loss_range": f"{m}_hi - {m}_lo", "loss_skewness": f"case when {m}_n < 3 or {m}_hi = {m}_lo then 0 else {m}_m3 / ({m}_s * {m}_s * {m}_s) end",
        "loss_kurtosis": f"{m}_ku", "top_10_percent_loss_mean": f"{m}_top", "bottom_10_percent_loss_mean": f"{m}_bot", "token_count_used": f"{m}_n::double",
    }
    return ", ".join(f"case when {m}_n > 0 then {R6(v)} end as {m}_{k}" for k, v in vals.items())


STATS_SQL = f"""{LOSS_SQL}, sa as (select docs.id, {', '.join(_stats_cols(m) for m in NG)} from docs left join ls on docs.id = ls.id group by 1),
 st as materialized (select id, {', '.join(_stats_out(m) for m in NG)} from sa)"""


def _contrast_sql(o, p):
    x = f"bino_{o}_{p}"
    c = {"ppl_observer": f"{o}_ppl", "ppl_performer": f"{p}_ppl", "loss_mean_observer": f"{o}_loss_mean", "loss_mean_performer": f"{p}_loss_mean", "loss_std_observer": f"{o}_loss_std",
         "loss_std_performer": f"{p}_loss_std", "ppl_ratio": f"case when {o}_ppl is not null then {RATIO(f'{o}_ppl', f'{p}_ppl')} end", "loss_mean_diff": f"{o}_loss_mean - {p}_loss_mean",
         "loss_std_diff": f"{o}_loss_std - {p}_loss_std", "binoculars_style_score": f"case when {o}_loss_mean is not null then {RATIO(f'{o}_loss_mean', f'{p}_loss_mean')} end"}
    return ", ".join(f"{R6(v)} as {x}_{k}" for k, v in c.items())


def profile_sql(source, enc, n, key="id"):
    """CTEs giving one profile per key from (key, pos, s) rows."""
    cells = [(i, j) for i in range(n) for j in range(n)]
    pairs = ", ".join(f"count(*) filter (p = {i} and s = {j})::double as c{i}_{j}" for i, j in cells)
    cnt = ", ".join(f"count(*) filter (s = {k})::double as s{k}" for k in range(n))
    add = lambda test: " + ".join([f"c{i}_{j}" for i, j in cells if test(i, j)] or ["0"])
    ent = lambda names, tot: "-(" + " + ".join(f"case when {x} > 0 then {x} / {tot} * log2({x} / {tot}) else 0 end" for x in names) + ")"
    step = lambda v: f"case when n > 1 then ({v}) / (n - 1) end"
    cols = {f"trans_{i}_to_{j}": step(f"c{i}_{j}") for i, j in cells}
    cols |= {
        "transition_entropy": f"case when n > 1 then {ent([f'c{i}_{j}' for i, j in cells], '(n - 1)')} end", "self_transition_rate": step(add(lambda i, j: i == j)),
        "upward_transition_rate": step(add(lambda i, j: j > i)), "downward_transition_rate": step(add(lambda i, j: j < i)), "large_jump_rate": step(add(lambda i, j: abs(i - j) >= 2)),
        "high_loss_burst_density": f"s{n - 1} / n", "low_loss_run_length_mean": "coalesce(s0 / nullif(r0, 0), 0)", "high_loss_run_length_mean": f"coalesce(s{n - 1} / nullif(r1, 0), 0)",
        "state_sequence_entropy": ent([f"s{k}" for k in range(n)], "n"), "token_count": "n::double",
    }
    # runs counted by gaps and islands, independently of the pair counts
    return f"""{enc}_l as (select {key}, pos, s, lag(s) over (partition by {key} order by pos) as p,
       row_number() over (partition by {key} order by pos) - row_number() over (partition by {key}, s order by pos) as island from {source}),
     {enc}_r as (select {key}, count(distinct island) filter (s = 0) as r0, count(distinct island) filter (s = {n - 1}) as r1 from {enc}_l group by 1),
     {enc}_c as (select {key}, count(*)::double as n, {pairs}, {cnt} from {enc}_l group by 1),
     {enc} as (select {key}, {', '.join(f"{R6(v)} as {enc}_{k}" for k, v in cols.items())} from {enc}_c join {enc}_r using ({key}))"""


def _bin_sql(x, bins, n):
    return " + ".join(f"coalesce(({x} >= {bins}[{i}])::int, 0)" for i in range(1, n))


_Q = lambda n: "[" + ", ".join(f"{i / n!r}" for i in range(1, n)) + "]"
ZS = """zs as (select id, pos, ng2, round((ng2 - m) / case when sd > 0 then sd else 1 end, 6) + 0.0::double as z from ls join (select id, avg(ng2) as m, stddev_pop(ng2) as sd from ls group by 1) using (id))"""
BINS = f"""{ZS}, bn as materialized (select {', '.join(f"case when max({c}) > min({c}) then quantile_cont({c}, {_Q(n)}) end as {a}{n}" for c, a in (('ng2', 'raw'), ('z', 'zscore')) for n in (3, 5, 7)) } from zs join sp using (id) where train)"""
RK = lambda x: f"(rank() over (partition by id order by {x}) + (count(*) over (partition by id, {x}) - 1) / 2.0::double) / count(*) over (partition by id)"
_state_rank = lambda x, n: f"least({n - 1}, greatest(0, floor({RK(x)} * {n})::int))"


def _joined(encs, base="docs"):
    return f"select * from (select id from {base}) " + " ".join(f"left join {e} using (id)" for e in encs)


def _profiles_sql(sources):
    """sources: {encoding: (sql giving id, pos, s; n)}"""
    ctes = [f"{e}_src as ({sql}), {profile_sql(e + '_src', e, n)}" for e, (sql, n) in sources.items()]
    return ", ".join(ctes)


def _gap_sql(enc):
    """CTE ``enc`` (id, gap): the second largest modulus of a three-state chain. One root of its cubic is 1 where every state is left again, else 0;
    the two others solve a quadratic with sum t and product d."""
    share = ", ".join(f"coalesce(c{i}{j} / nullif(c{i}0 + c{i}1 + c{i}2, 0), 0) as p{i}{j}" for i in range(3) for j in range(3))
    cells = ", ".join(f"count(*) filter (p = {i} and s = {j})::double as c{i}{j}" for i in range(3) for j in range(3))
    left = " + ".join(f"(c{i}0 + c{i}1 + c{i}2 > 0)::int" for i in range(3))
    det = "p00 * (p11 * p22 - p12 * p21) - p01 * (p10 * p22 - p12 * p20) + p02 * (p10 * p21 - p11 * p20)"
    minors = "p00 * p11 - p01 * p10 + p00 * p22 - p02 * p20 + p11 * p22 - p12 * p21"
    return f"""{enc}_q as (select id, s, lag(s) over (partition by id order by pos) as p from {enc}_src), {enc}_n as (select id, {cells} from {enc}_q group by 1),
      {enc}_p as (select id, {left} as alive, {share} from {enc}_n), {enc}_t as (select id, alive, p00 + p11 + p22 - (alive = 3)::int as t, case when alive = 3 then {det} else {minors} end as d from {enc}_p),
      {enc}_e as (select *, sqrt(greatest(t * t - 4 * d, 0)) as w, t * t < 4 * d as round from {enc}_t),
      {enc} as (select id, 1 - case when alive < 2 then 0 when round then sqrt(d) when alive = 3 then greatest(abs(t + w), abs(t - w)) / 2 else least(abs(t + w), abs(t - w)) / 2 end as gap from {enc}_e)"""


_FULL = {}
for _n in (3, 5, 7):
    _FULL[f"ng2_raw_lossq{_n}"] = (f"select id, pos, {_bin_sql('ng2', f'raw{_n}', _n)} as s from zs, bn", _n)
    _FULL[f"ng2_z_lossq{_n}"] = (f"select id, pos, {_bin_sql('z', f'zscore{_n}', _n)} as s from zs, bn", _n)
    _FULL[f"ng2_doc_rank{_n}"] = (f"select id, pos, {_state_rank('ng2', _n)} as s from zs", _n)
_FORMAL = {f"ng2_lossq{_n}": (f"select id, pos, {_bin_sql('ng2', f'raw{_n}', _n)} as s from zs, bn", _n) for _n in (3, 5, 7)}
_FORMAL |= {f"ng2_probrank{_n}": (f"select id, pos, {_state_rank('-ng2', _n)} as s from zs", _n) for _n in (3, 5, 7)}


def _own(m):
    own = f"(select id, case when max({m}) > min({m}) then quantile_cont({m}, {_Q(5)}) end as q from ls group by 1)"
    return {f"{m}_lossq": (f"select id, pos, {_bin_sql(m, 'q', 5)} as s from ls join {own} using (id)", 5), f"{m}_probrank": (f"select id, pos, {_state_rank('-' + m, 5)} as s from ls", 5)}


def _delta_cols():
    names = [f"trans_{i}_to_{j}" for i in range(5) for j in range(5)] + [s for s in X.SUMMARY if s != "transition_spectral_gap"]
    return [(f"{e}_{k}") for e in ("lossq", "probrank") for k in names]


def _scale_sql():
    """Long form: one row per id and metric with y0..y3, then the same formulas spelled out."""
    metrics = ("ppl", "loss_mean", "loss_std", "loss_cv", "loss_range", "loss_skewness", "loss_kurtosis", "top_10_percent_loss_mean", "bottom_10_percent_loss_mean")
    long = " union all ".join(f"select id, '{m}' as m, " + ", ".join(f"{s}_{m} as y{i}" for i, s in enumerate(NG)) + " from st" for m in metrics)
    long += " union all select id, 'gap' as m, " + ", ".join(f"{s}_top_10_percent_loss_mean - {s}_bottom_10_percent_loss_mean as y{i}" for i, s in enumerate(NG)) + " from st"
    fit = """select *, (y0 + y1 + y2 + y3) / 4 as my, (-1.5 * y0 - 0.5 * y1 + 0.5 * y2 + 1.5 * y3) / 5 as sl from lg"""
    fit2 = """select *, my - 1.5 * sl as ic, (y0 - my) ** 2 + (y1 - my) ** 2 + (y2 - my) ** 2 + (y3 - my) ** 2 as sst from f1"""
    fit3 = """select *, case when sst > 1e-8 then 1 - ((y0 - ic) ** 2 + (y1 - ic - sl) ** 2 + (y2 - ic - 2 * sl) ** 2 + (y3 - ic - 3 * sl) ** 2) / (sst + 1e-8) end as r2,
      (y0 + y1) / 2 + (y1 + y2) / 2 + (y2 + y3) / 2 as ar, [y1 - y0, (y2 - y0) / 2, (y3 - y1) / 2, y3 - y2] as g1, [y1 - y0, y2 - y1, y3 - y2] as dl, list_min([y0, y1, y2, y3]) as mn, list_max([y0, y1, y2, y3]) as mx from f2"""
    fit4 = """select *, (g1[2] - g1[1] + (g1[3] - g1[1]) / 2 + (g1[4] - g1[2]) / 2 + g1[4] - g1[3]) / 4 as cu, list_transform(list_filter(dl, lambda d: abs(d) > 1e-8), lambda d: sign(d)) as sg from f3"""
    sd = lambda a, b: f"({a}) / nullif(({b}) + 1e-8, 0)"
    per = {}
    for i in range(3):
        a, b = NG[i], NG[i + 1]
        per[f"slope_{a}_to_{b}"] = f"(y{i + 1} - y{i}) / (1 + 1e-8)"
        per[f"ratio_{a}_to_{b}"] = sd(f"y{i + 1}", f"y{i}")
        per[f"abs_delta_{a}_to_{b}"] = f"abs(y{i + 1} - y{i})"
        per[f"rel_delta_{a}_to_{b}"] = sd(f"y{i + 1} - y{i}", f"abs(y{i})")
    per |= {"global_slope": "sl", "global_intercept": "ic", "global_r2": "r2", "response_area": "ar", "normalized_area": "ar / (3 + 1e-8)", "response_curvature": "cu", "response_variance": "sst / 4",
            "response_range": "mx - mn", "min_scale_index": "case mn when y0 then 0 when y1 then 1 when y2 then 2 else 3 end", "max_scale_index": "case mx when y0 then 0 when y1 then 1 when y2 then 2 else 3 end",
            "monotonic_decrease_ratio": "((y1 < y0)::int + (y2 < y1)::int + (y3 < y2)::int) / 3.0::double", "monotonic_increase_ratio": "((y1 > y0)::int + (y2 > y1)::int + (y3 > y2)::int) / 3.0::double",
            "num_direction_changes": "case len(sg) when 0 then null when 1 then 0 when 2 then (sg[1] <> sg[2])::int else (sg[1] <> sg[2])::int + (sg[2] <> sg[3])::int end",
            "early_gain_ng1_ng2": "y0 - y1", "late_gain_ng3_ng4": "y2 - y3", "saturation_ng3_ng4": "abs(y2 - y3)", "saturation_ratio_ng3_ng4": sd("abs(y2 - y3)", "abs(y0 - y1)")}
    r = lambda name, v: R6(v, 3 if 'ratio' in name or 'rel_delta' in name or 'ppl' in name else 5)
    cols = [f"max(case when m = '{m}' then case when y0 is not null then {r(f'scale_{m}_{k}', v)} end end) as scale_{m}_{k}" for m in metrics for k, v in per.items()]
    one = lambda m, v: f"max(case when m = '{m}' then {v} end)"
    cols += [f"{r('ratio', sd(one(m, 'sl'), one('loss_mean', 'sl')))} as scale_{m}_loss_mean_global_slope_ratio" for m in ("ppl", "loss_std")]
    cols += [f"{r('', one('gap', f'y{i}'))} as scale_top_bottom_loss_gap_{s}" for i, s in enumerate(NG)] + [f"{r('', one('gap', 'sl'))} as scale_top_bottom_loss_gap_global_slope"]
    return f"with {STATS_SQL}, lg as ({long}), f1 as ({fit}), f2 as ({fit2}), f3 as ({fit3}), f4 as ({fit4}) select id, {', '.join(cols)} from f4 group by id"


ORACLES = {
    "token_losses": f"with {LOSS_SQL} select (pos - 1)::int as pos, count(*) as n, " + ", ".join(f"{R6(f'sum({m})', 3)} as {m}" for m in NG) + " from ls group by 1",
    "loss_records": f"""with {LOSS_SQL}, lm as (select id, pos, unnest(['ng1', 'ng2', 'ng3', 'ng4']) as model_name, unnest([ng1, ng2, ng3, ng4]) as x from ls),
      rk as (select *, (rank() over (partition by id, model_name order by -x) + (count(*) over (partition by id, model_name, x) - 1) / 2.0::double) / count(*) over (partition by id, model_name) as r from lm),
      ag as (select id, model_name, count(*) as c, sum(round(r, 8)) as rs, sum(exp(-least(x, 50))) as ps, max_by(round(r, 8), pos) as lr from rk group by 1, 2)
      select docs.id, m.m as model_name, coalesce(c, 0) as token_count, sha256(t) as text_hash, {R6('coalesce(rs, 0)', 3)} as rank_sum, {R6('coalesce(ps, 0)', 3)} as prob_sum, {R6('lr', 5)} as last_rank
      from docs cross join (select unnest(['ng1', 'ng2', 'ng3', 'ng4']) as m) m left join ag on ag.id = docs.id and ag.model_name = m.m""",
    "features_probability": f"with {STATS_SQL} select * from st",
    "features_contrast": f"with {STATS_SQL} select id, {_contrast_sql('ng1', 'ng2')}, {_contrast_sql('ng2', 'ng4')} from st",
    "features_scale_response": _scale_sql(),
    "loss_bins": f"""with {LOSS_SQL}, {BINS} """ + " union all ".join(f"select '{a}' as encoding, {n} as n_states, {i} as cut, {R6(f"{a}{n}[{i + 1}]", 5)} as value from bn" for a in ("raw", "zscore") for n in (3, 5, 7) for i in range(n - 1)),
    "transition_full": f"with {LOSS_SQL}, {BINS}, {_profiles_sql(_FULL)} {_joined(_FULL)}",
    "spectral_gap_three": f"with {LOSS_SQL}, {BINS}, " + ", ".join(f"{e}_src as ({sql}), {_gap_sql(e)}" for e, (sql, n) in _FULL.items() if n == 3) + " select docs.id, "
        + ", ".join(f"{R6(f'{e}.gap', 4)} as {e}_transition_spectral_gap" for e, (_, n) in _FULL.items() if n == 3) + " from docs " + " ".join(f"left join {e} using (id)" for e, (_, n) in _FULL.items() if n == 3),
    "transition_formal": f"with {LOSS_SQL}, {BINS}, {_profiles_sql(_FORMAL)} {_joined(_FORMAL)}",
    "transition_own": f"with {LOSS_SQL}, {_profiles_sql(_own('ng2'))} {_joined(_own('ng2'))}",
    "transition_delta": f"with {LOSS_SQL}, {_profiles_sql(_own('ng1') | _own('ng2'))}, al as ({_joined(_own('ng1') | _own('ng2'))}) select id, "
        + ", ".join(f"{R6(f'ng2_{c} - ng1_{c}')} as scale_transition_delta_{c}" for c in _delta_cols()) + " from al",
    "event_profiles": f"""with bn as (select quantile_cont(value, {_Q(3)}) as q3, quantile_cont(value, {_Q(5)}) as q5, quantile_cont(value, {_Q(7)}) as q7 from events),
      ev as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as pos from events),
      a as (select user_id, pos, {_bin_sql('value', 'q3', 3)} as s from ev, bn), b as (select user_id, pos, {_bin_sql('value', 'q5', 5)} as s from ev, bn), c as (select user_id, pos, {_bin_sql('value', 'q7', 7)} as s from ev, bn),
      {profile_sql('a', 'value_q3', 3, 'user_id')}, {profile_sql('b', 'value_q5', 5, 'user_id')}, {profile_sql('c', 'value_q7', 7, 'user_id')} select * from value_q3 join value_q5 using (user_id) join value_q7 using (user_id)""",
}

"""Queries over whole texts: cleaning, feature families, rewritings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.columns import clean_text, nudge, rounded, rounded_table
from ..functions.fixed_values import DOMAIN_TERMS, PHRASE_REPLACEMENTS, DROPPED_ADVERBS, TEMPLATE_PHRASES, TRANSITION_PHRASES
from ..operators.features import document_features
from .tables import documents, spread, table

TOK = r"[\x{4e00}-\x{9fff}]|[A-Za-z]+(?:''[A-Za-z]+)?|\d+(?:\.\d+)?"
TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
CLEAN = lambda x: TRIM(rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[ \t\r\f\x0b]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
TOKENS = lambda x: f"regexp_extract_all({x}, '{TOK}')"
SENTENCES = lambda x: (
    rf"list_filter(list_transform(string_split(regexp_replace({x}, '([。！？!?；;.])\s*', '\1' || chr(1), 'g'), chr(1)), "
    rf"lambda p: {TRIM('p')}), lambda p: p <> '')"
)
PARAGRAPHS = lambda x: rf"list_filter(list_transform(regexp_split_to_array({x}, '\n\s*\n|\n'), lambda p: {TRIM('p')}), lambda p: p <> '')"
RATIO = lambda a, b: f"(case when {b} is null or abs({b}) < 1e-12 then 0.0::double else ({a})::double / (({b})::double + 1e-12::double) end)"
R6 = lambda x, d=6: f"(round(({x})::double + {nudge(d)!r}::double, {d}) + 0.0::double)"
COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"

DOCS = f"""docs as (select * from (select cast(doc_id as varchar) as id, {CLEAN('text')} as t from documents) where length(t) > 0)"""

BURST_SQL = f"""
with {DOCS},
a as (select id, t, {TOKENS('t')} as tok,
  list_transform({SENTENCES('t')}, lambda s: len({TOKENS('s')})) as ss0,
  list_transform({PARAGRAPHS('t')}, lambda s: len({TOKENS('s')})) as ps0 from docs),
b as (select id, t, list_transform(tok, lambda w: lower(w)) as words, len(ss0) as ns, len(ps0) as np,
  case when len(ss0) = 0 then [0] else ss0 end as ss, case when len(ps0) = 0 then [0] else ps0 end as ps from a),
c as (select *, list_avg(ss) as sm, list_avg(ps) as pm, length(t) as n, len(words) as nw, len(list_distinct(words)) as dw,
  replace(t, ' ', '') as solid from b),
d as (select *, sqrt(list_avg(list_transform(ss, lambda x: (x - sm) * (x - sm)))) as sd,
  sqrt(list_avg(list_transform(ps, lambda x: (x - pm) * (x - pm)))) as pd,
  len(list_distinct(regexp_extract_all(solid, '(?s).'))) as dc from c),
wf as (select id, w, count(*)::double as f from (select id, unnest(words) as w from c) group by 1, 2),
rk as (select id, ln(f) as y, ln(row_number() over (partition by id order by f desc)) as x, count(*) over (partition by id) as k from wf),
ab as (select id, regr_slope(y, x) as sl, regr_intercept(y, x) as ic from rk where k >= 3 group by id),
zf as (select rk.id, avg(abs(y - (sl * x + ic))) as z from rk join ab on rk.id = ab.id group by 1)
select d.id, {R6('n')} as burst_text_length, {R6('n')} as burst_char_count, {R6('nw')} as burst_word_count,
 {R6('ns')} as burst_sentence_count, {R6('sm')} as burst_avg_sentence_length, {R6('sd')} as burst_std_sentence_length,
 {R6(RATIO('sd', 'sm'))} as burst_sentence_length_cv, {R6('list_max(ss)')} as burst_max_sentence_length,
 {R6('list_min(ss)')} as burst_min_sentence_length,
 {R6(RATIO(COUNT('t', '[，,。.!！?？；;：:、]'), 'n'))} as burst_punctuation_ratio,
 {R6(RATIO(COUNT('t', '[，,、]'), 'n'))} as burst_comma_ratio,
 {R6(RATIO(COUNT('t', '[。.!]'), 'n'))} as burst_period_ratio,
 {R6(RATIO(COUNT('t', '[?？]'), 'n'))} as burst_question_ratio,
 {R6(RATIO(COUNT('t', '[!！]'), 'n'))} as burst_exclamation_ratio,
 {R6('np')} as burst_paragraph_count, {R6('pm')} as burst_avg_paragraph_length, {R6('pd')} as burst_std_paragraph_length,
 {R6(RATIO('dw', 'nw'))} as burst_type_token_ratio,
 {R6(RATIO('length(solid) - dc', 'greatest(n, 1)'))} as burst_repeated_char_ratio,
 {R6(RATIO('nw - dw', 'greatest(nw, 1)'))} as burst_repeated_word_ratio,
 {R6('coalesce(z, 0)')} as burst_zipf_deviation_score
from d left join zf on d.id = zf.id
"""

_OCC = lambda x, ps: " + ".join(f"((length({x}) - length(replace({x}, '{p}', ''))) // {len(p)})" for p in ps)
_W = r"[^\p{L}\p{N}_]"
_DOUBLED = lambda x: rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
_CAP = rf"regexp_replace(t, '([^\p{{L}}\p{{N}}_\s])', '\1\1', 'g')"
STRUCT_SQL = f"""
with {DOCS},
a as (select id, t, lower(t) as lo, list_transform({TOKENS('t')}, lambda w: lower(w)) as words from docs),
b as (select *, len(words) as n, {_OCC('t', TEMPLATE_PHRASES)} + {COUNT('t', '为.*?提供参考')} as tc, {_OCC('t', TRANSITION_PHRASES)} as xc from a),
tk as (select id, generate_subscripts(words, 1) as i, unnest(words) as w from a),
g as (select id, i, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from tk window o as (partition by id order by i)),
b2 as (select id, sum(case when c > 1 then c else 0 end) as rep, max(c) as top, count(*) as uq, sum(c) as tot
  from (select id, w, w2, count(*) as c from g where w2 is not null group by all) group by id),
b3 as (select id, sum(case when c > 1 then c else 0 end) as rep, max(c) as top, count(*) as uq, sum(c) as tot
  from (select id, w, w2, w3, count(*) as c from g where w3 is not null group by all) group by id)
select b.id, {R6('tc')} as struct_template_phrase_count, {R6(RATIO('tc', 'n'))} as struct_template_phrase_ratio,
 {R6('xc')} as struct_transition_phrase_count, {R6(RATIO('xc', 'n'))} as struct_transition_phrase_ratio,
 {R6(RATIO('b2.rep', 'b2.tot'))} as struct_repeated_bigram_ratio, {R6('coalesce(b2.top, 0)')} as struct_top_bigram_frequency,
 {R6(RATIO('b2.uq', 'b2.tot'))} as struct_unique_bigram_ratio,
 {R6(RATIO('b3.rep', 'b3.tot'))} as struct_repeated_trigram_ratio, {R6('coalesce(b3.top, 0)')} as struct_top_trigram_frequency,
 {R6(RATIO('b3.uq', 'b3.tot'))} as struct_unique_trigram_ratio,
 0.0::double as struct_noun_ratio, 0.0::double as struct_verb_ratio, 0.0::double as struct_adjective_ratio,
 {R6(RATIO(COUNT(_DOUBLED('lo'), rf'(?:^|{_W})[\p{{L}}\p{{N}}_]+ly(?:$|{_W})'), 'n'))} as struct_adverb_ratio,
 {R6(RATIO(COUNT('t', r'\d+'), 'n'))} as struct_numeral_ratio,
 {R6(RATIO(COUNT(_DOUBLED('lo'), rf'(?:^|{_W})(?:i|we|you|he|she|they|我|我们|你|他们)(?:$|{_W})'), 'n'))} as struct_pronoun_ratio,
 0.0::double as struct_function_word_ratio,
 {R6(RATIO(COUNT('t', r'\d+(?:\.\d+)?'), 'n'))} as struct_number_density,
 {R6(RATIO(COUNT(_CAP, rf'(?:^|{_W})[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:$|{_W})'), 'n'))} as struct_english_capitalized_entity_density,
 {R6(RATIO(_OCC('lo', DOMAIN_TERMS), 'n'))} as struct_domain_term_density,
 {R6(RATIO(COUNT(_DOUBLED('lo'), rf'(?:^|{_W})[\p{{L}}\p{{N}}_]+ly(?:$|{_W})'), 'n'))} as struct_content_word_ratio
from b left join b2 on b.id = b2.id left join b3 on b.id = b3.id
"""


def _nest(x, pairs):
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_TIDY = lambda x: TRIM(f"regexp_replace(regexp_replace({x}, '[，,]{{2,}}', '，', 'g'), '[。.!！?？]{{2,}}', '。', 'g')")
VARIANTS_CTE = f"""{DOCS},
s as (select id, t, {SENTENCES('t')} as ss from docs),
v as (select id, t, [{_TIDY(_nest('t', PHRASE_REPLACEMENTS))}, {_TIDY(_nest('t', [(w, '') for w in DROPPED_ADVERBS]))},
  case when len(ss) > 1 then array_to_string(ss[1:greatest(1, floor(len(ss) * 0.8::double)::int)], '') end,
  case when {COUNT('t', '[，,；;]')} >= 2 then
    {_TIDY("regexp_replace(t, '^([^，,；;]*)([，,；;])([^，,；;]*)([，,；;])', '" + chr(92) + "3" + chr(92) + "2" + chr(92) + "1" + chr(92) + "4')")} end,
  {_TIDY('t')}] as vs from s),
u as (select id, t, list_distinct(list_filter(vs, lambda x: x is not null and x <> '' and x <> t)) as vs from v)"""
PERT_SQL = f"""
with {VARIANTS_CTE},
e as (select id, t, len(vs) as k, unnest(case when len(vs) = 0 then [null] else vs end) as x from u),
f as (select id, k, (length(x) - greatest(length(t), 1))::double / greatest(length(t), 1) as dl, list_distinct({TOKENS('t')}) as a, list_distinct({TOKENS('x')}) as b, x from e),
g as (select *, len(list_distinct(list_concat(a, b))) as un, len(list_intersect(a, b)) as it from f),
h as (select *, case when x is null then null when un = 0 then 1.0::double else {RATIO('it', 'un')} end as j from g)
select id, {R6('max(k)')} as pert_perturbation_count, {R6('coalesce(avg(dl), 0)')} as pert_avg_length_delta,
 {R6('coalesce(stddev_pop(dl), 0)')} as pert_std_length_delta, {R6('coalesce(avg(j), 0)')} as pert_avg_jaccard_similarity,
 {R6('coalesce(stddev_pop(j), 0)')} as pert_std_jaccard_similarity
from h group by id
"""


_rounded = rounded_table


def clean_documents(spark, sf):
    return documents(spark, sf).select("id", F.sha2(clean_text(F.col("text")), 256).alias("text_sha256"), F.length(clean_text(F.col("text"))).cast("long").alias("n_chars"))


def clean_pages(spark, sf):
    p = spread(table(spark, sf, "pages"), "page_id")
    c = clean_text(F.col("html"))
    return p.select("page_id", F.sha2(c, 256).alias("text_sha256"), F.length(c).cast("long").alias("n_chars"),
                    F.size(X.tokens(c)).cast("long").alias("n_tokens"), F.size(X.sentences(c)).cast("long").alias("n_sentences"),
                    F.size(X.paragraphs(c)).cast("long").alias("n_paragraphs"))


def burstiness(spark, sf):
    return _rounded(document_features(documents(spark, sf), ["burst"], compression=False))


def burstiness_whole(spark, sf):
    """The whole family, with the compression ratios that SQL cannot follow."""
    return _rounded(document_features(documents(spark, sf), ["burst"]))


def stability_whole(spark, sf):
    return _rounded(document_features(documents(spark, sf), ["pert"]))


def structure(spark, sf):
    return _rounded(document_features(documents(spark, sf), ["struct"]))


def stability(spark, sf):
    return _rounded(document_features(documents(spark, sf), ["pert"], compression=False))


def rewritings(spark, sf):
    d = X.cleaned(documents(spark, sf).select("id", "text"))
    v = d.select("id", F.explode(X.rewritten(F.col("text"))).alias("v"))
    return v.select("id", F.sha2("v", 256).alias("variant_sha256"), F.length("v").cast("long").alias("n_chars"))


def compression(spark, sf):
    d = X.cleaned(documents(spark, sf).select("id", "text"))
    d = d.withColumn("r", F.get(X.packed_ratios(F.array("text")), F.lit(0)))
    return d.select("id", F.get("r", F.lit(0)).alias("burst_compression_ratio_zlib"), F.get("r", F.lit(1)).alias("burst_compression_ratio_gzip"),
                    rounded(X.redundancy(F.col("text"))).alias("burst_shingle_redundancy"))


def shingle_redundancy(spark, sf):
    d = X.cleaned(documents(spark, sf).select("id", "text"))
    return d.select("id", rounded(X.redundancy(F.col("text"))).alias("burst_shingle_redundancy"))


QUERIES = {
    "clean_documents": clean_documents,
    "clean_pages": clean_pages,
    "features_burstiness": burstiness,
    "features_structure": structure,
    "features_stability": stability,
    "features_burstiness_whole": burstiness_whole,
    "features_stability_whole": stability_whole,
    "rewritings": rewritings,
    "features_compression": compression,
    "features_shingle_redundancy": shingle_redundancy,
}
ORACLES = {
    "clean_documents": f"select cast(doc_id as varchar) as id, sha256({CLEAN('text')}) as text_sha256, length({CLEAN('text')}) as n_chars from documents",
    "clean_pages": f"""with c as (select page_id, {CLEAN('html')} as t from pages)
      select page_id, sha256(t) as text_sha256, length(t) as n_chars, len({TOKENS('t')}) as n_tokens,
        len({SENTENCES('t')}) as n_sentences, len({PARAGRAPHS('t')}) as n_paragraphs from c""",
    "features_burstiness": BURST_SQL,
    "features_structure": STRUCT_SQL,
    "features_stability": PERT_SQL,
    "rewritings": f"with {VARIANTS_CTE} select id, sha256(x) as variant_sha256, length(x) as n_chars from (select id, unnest(vs) as x from u)",
    "features_shingle_redundancy": f"""with {DOCS}, g as (select id, length(t) - 3 as n, case when length(t) < 4 then [] else
      list_transform(generate_series(1, length(t) - 3), lambda i: substring(t, i, 4)) end as s from docs)
      select id, {R6('case when n < 1 then 0 else 1.0::double - len(list_distinct(s))::double / n end')} as burst_shingle_redundancy from g""",
}

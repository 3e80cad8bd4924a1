"""Queries over corpus rows: cleaning, dedup, splits, samples, counts, joins of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories as K
from ..functions.columns import clean_text, rounded
from ..functions.fixed_values import ATTACK_RULES, DOMAIN_PATH_RULES, DOMAIN_RULES, GENERATOR_RULES, SPLIT_PATH_RULES
from ..operators import corpus as C
from .documents import CLEAN, R6
from .tables import documents, labels, spread, table

META_SQL = """meta as (select cast(d.doc_id as varchar) as id, d.doc_id, l.quality as label, d.lang as source_dataset, d.lang as language, d.source as domain,
  case when l.quality = 0 then 'human' else 'unknown' end as generator, 'none' as attack_type, cast(null as varchar) as split
  from documents d left join labels l on d.doc_id = l.doc_id)"""
RANK_SQL = lambda groups: f"row_number() over (partition by {groups} order by md5(id || ':42'), id)"
SIZE_SQL = lambda groups: f"count(*) over (partition by {groups})"


def meta(spark, sf):
    """Corpus rows without their text."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("lang").alias("source_dataset"), F.col("source").alias("domain"))
    return d.join(labels(spark, sf).drop("toxic"), "id", "left").select(
        "id", "doc_id", "label", "source_dataset", F.col("source_dataset").alias("language"), "domain",
        F.when(F.col("label") == 0, "human").otherwise("unknown").alias("generator"), F.lit("none").alias("attack_type"), F.lit(None).cast("string").alias("split"))


def labelled(spark, sf):
    return meta(spark, sf).filter(F.col("label").isNotNull())


def _ordered(spark, sf):
    return documents(spark, sf).join(labels(spark, sf), "id", "left").withColumn("order", F.col("doc_id"))


def document_rows(spark, sf):
    d = documents(spark, sf).select("id", "text", F.col("source_dataset").alias("source"))
    return C.document_table(d).select("id", F.sha2("text", 256).alias("text_sha256"), "label", "type", "source", "topic")


def removal(spark, sf):
    return C.removal_reasons(_ordered(spark, sf)).withColumnRenamed("order", "doc_id")


def removal_counts(spark, sf):
    return C.removal_counters(C.removal_reasons(_ordered(spark, sf)))


def cleaned_corpus(spark, sf):
    return C.clean_corpus(_ordered(spark, sf), min_words=1, max_words=100000).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def first_texts(spark, sf):
    d = documents(spark, sf).select("doc_id", F.unhex(F.sha2(clean_text(F.col("text")), 256)).alias("k"))
    return C.keep_first(d, ["k"], "doc_id").select("doc_id")


def splits_80_20(spark, sf):
    return C.train_test_split(labelled(spark, sf)).select("id", "label", "split")


def splits_70_10_20(spark, sf):
    return C.resplit(labelled(spark, sf)).select("id", "source_dataset", "label", "split")


def splits_default(spark, sf):
    d = meta(spark, sf).withColumn("split", F.when(F.col("domain") == "src1", "Validation").when(F.col("domain") == "src2", "eval"))
    return C.default_split(d, held_out=("es",)).select("id", "split")


def capped(spark, sf):
    return C.cap_groups(meta(spark, sf), 5).select("id")


def balanced(spark, sf):
    return C.balanced_sample(labelled(spark, sf)).select("id", "source_dataset", "label")


def shared_sample(spark, sf):
    return C.share_sample(meta(spark, sf), 0.25, ["domain"]).select("id")


def development_rows(spark, sf):
    return C.row_cap(labelled(spark, sf), 100).select("id", "label")


def counts_by_field(spark, sf):
    return C.value_counts(meta(spark, sf))


def sizes_by_group(spark, sf):
    return C.group_sizes(C.resplit(labelled(spark, sf)))


def leak_report(spark, sf):
    a = C.resplit(labelled(spark, sf)).select("id", "split")
    b = C.train_test_split(labelled(spark, sf)).select("id", "split")
    return C.leaking_ids(a.unionByName(b))


def split_by_label(spark, sf):
    return C.split_label_table(C.resplit(labelled(spark, sf)))


def balance(spark, sf):
    b = C.class_balance(labelled(spark, sf), ["source_dataset"])
    return b.select("source_dataset", "n_positive", "n_negative", rounded(F.col("positive_rate")).alias("positive_rate"), rounded(F.col("scale_pos_weight")).alias("scale_pos_weight"))


def stats(spark, sf):
    return C.dataset_stats(meta(spark, sf), ["source_dataset"])


def sources_of(df):
    """The sources in a table: one short name each."""
    return sorted(r[0] for r in df.select("source_dataset").distinct().collect() if r[0] is not None)


def largest_sources(df, n):
    """The n sources with the most rows, the most first."""
    rows = df.groupBy("source_dataset").count().filter("source_dataset is not null").orderBy(F.desc("count"), "source_dataset").limit(n)
    return [r["source_dataset"] for r in rows.collect()]


def train_roles(spark, sf):
    d = C.resplit(labelled(spark, sf))
    a = C.assignments(d, C.train_definitions(sources_of(d)))
    return a.groupBy("train_name", "role").count()


def train_test_overlap(spark, sf):
    d = C.resplit(labelled(spark, sf))
    train = C.assignments(d, C.train_definitions(sources_of(d))).filter("role = 'train'")
    test = labelled(spark, sf).select(F.concat(F.col("domain"), F.lit("_all")).alias("test_name"), "id")
    return C.overlap(train, test)


def missing_ids(spark, sf):
    return meta(spark, sf).select("id").join(labels(spark, sf).select("id"), "id", "left_anti")


def common_ids(spark, sf):
    return meta(spark, sf).select("id").intersect(labels(spark, sf).filter("toxic = 0").select("id"))


def categories_from_urls(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    u, g = F.col("url"), F.regexp_extract("url", r"https?://([a-z]+)", 1)
    return p.select("page_id", K.domain(u).alias("domain"), K.domain_from_path(u).alias("path_domain"), K.generator(g, F.lit(1)).alias("generator"),
                    K.generator_from_path(u, F.lit(1)).alias("path_generator"), K.attack(g).alias("attack_type"), K.split(g).alias("split"),
                    K.split_from_path(u).alias("path_split"), K.external_label(F.regexp_extract("url", r"/(\d+)", 1)).alias("label"))


def labels_from_roles(spark, sf):
    c = table(spark, sf, "conversations")
    value = F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")).when(F.col("turn") % 3 == 1, F.col("role"))
    gen = F.when(F.col("role") == "user", "human").otherwise("")
    lab = K.label(value, gen, F.concat(F.lit("data/train/"), F.col("role"), F.lit("/ai.jsonl")))
    return c.select("conv_id", "turn", lab.alias("label")).groupBy("turn", "label").count()


QUERIES = {
    "document_table": document_rows, "removal_reasons": removal, "removal_counters": removal_counts, "clean_corpus": cleaned_corpus,
    "keep_first_text": first_texts, "split_80_20": splits_80_20, "split_70_10_20": splits_70_10_20, "split_default": splits_default,
    "cap_groups": capped, "balanced_sample": balanced, "share_sample": shared_sample, "row_cap": development_rows,
    "value_counts": counts_by_field, "group_sizes": sizes_by_group, "leaking_ids": leak_report, "split_label_table": split_by_label,
    "class_balance": balance, "dataset_stats": stats, "train_assignments": train_roles, "train_test_overlap": train_test_overlap,
    "missing_ids": missing_ids, "common_ids": common_ids, "category_rules": categories_from_urls, "label_rules": labels_from_roles,
}

_NOT_MISSING = "label is not null"
RESPLIT_CTE = f"""{META_SQL}, rs as (select *, case when r <= floor(n * 0.7::double + 0.5) then 'train' when r <= floor(n * 0.8::double + 0.5) then 'dev' else 'test' end as sp from
  (select *, {RANK_SQL('source_dataset, label')} as r, {SIZE_SQL('source_dataset, label')} as n from meta where {_NOT_MISSING}))"""
SPLIT2_CTE = f"""s2 as (select id, label, case when r <= floor(n * 0.8::double + 0.5) then 'train' else 'test' end as split from
  (select *, {RANK_SQL('label')} as r, {SIZE_SQL('label')} as n from meta where {_NOT_MISSING}))"""
REASON_CTE = """rz as (select d.doc_id, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') as t, l.quality as label from documents d left join labels l on d.doc_id = l.doc_id),
  rw as (select *, len(regexp_extract_all(t, '\\S+')) as w from rz),
  rf as (select *, case when t is null or t = '' or lower(t) = 'nan' then 'empty' when w < 50 then 'too_short' when w > 1000 then 'too_long'
     when label is null or label not in (0, 1) then 'invalid_label' end as f from rw),
  rr as (select doc_id, case when f is not null then f when row_number() over (partition by t, f order by doc_id) > 1 then 'duplicate' end as reason from rf)"""
FIELDS = ("source_dataset", "language", "domain", "generator", "attack_type", "label", "split")
DEFS_SQL = """so as (select distinct source_dataset from meta), defs as (select 'train_' || source_dataset as train_name, source_dataset from so
  union all select 'train_combined', source_dataset from so union all select 'train_leave_out_' || a.source_dataset, b.source_dataset from so a, so b where a.source_dataset <> b.source_dataset)"""


def _case(x, rules, exact=False):
    hit = lambda w: f"{x} = '{w}'" if exact else f"contains({x}, '{w}')"
    return "case " + " ".join(f"when {' or '.join(hit(w) for w in words)} then '{name}'" for name, words in rules) + " end"


def _slug(x, keep):
    return f"case when {{0}} = '' then 'unknown' else {{0}} end".format(f"regexp_replace(regexp_replace({x}, '[^{keep}]+', '_', 'g'), '^_+|_+$', '', 'g')")


from ..functions.fixed_values import GENERATOR_PATH_RULES, SPLIT_RULES  # noqa: E402

ORACLES = {
    "document_table": f"""select cast(doc_id as varchar) as id, sha256({CLEAN('text')}) as text_sha256, 0 as label, '' as type, lang as source, '' as topic
       from documents where length({CLEAN('text')}) > 0""",
    "removal_reasons": f"with {REASON_CTE} select * from rr",
    "removal_counters": f"""with {REASON_CTE} select count(*) as input_rows, count(*) filter (reason = 'empty') as empty_removed, count(*) filter (reason = 'too_short') as too_short_removed,
       count(*) filter (reason = 'too_long') as too_long_removed, count(*) filter (reason = 'invalid_label') as invalid_label_removed,
       count(*) filter (reason = 'duplicate') as duplicate_removed, count(*) filter (reason is null) as final_rows from rr""",
    "clean_corpus": """with z as (select d.doc_id, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') as t from documents d join labels l on d.doc_id = l.doc_id)
       select min(doc_id) as doc_id, sha256(t) as text_sha256 from z where t <> '' and lower(t) <> 'nan' group by t""",
    "keep_first_text": f"select min(doc_id) as doc_id from documents group by {CLEAN('text')}",
    "split_80_20": f"with {META_SQL}, {SPLIT2_CTE} select * from s2",
    "split_70_10_20": f"with {RESPLIT_CTE} select id, source_dataset, label, sp as split from rs",
    "split_default": f"""with {META_SQL}, k as (select *, case domain when 'src1' then 'dev' when 'src2' then 'test' end as kn, source_dataset = 'es' as o from meta),
       r as (select *, {RANK_SQL("source_dataset, (not o and kn is null)")} - 1 as r, {SIZE_SQL("source_dataset, (not o and kn is null)")} as n from k)
       select id, case when o then coalesce(kn, 'external_test') when kn is not null then kn when r < floor(n * 0.8::double) then 'train' when r < floor(n * 0.9::double) then 'dev' else 'test' end as split from r""",
    "cap_groups": f"with {META_SQL}, r as (select id, {RANK_SQL('source_dataset, domain, generator, attack_type, label')} as r from meta) select id from r where r <= 5",
    "balanced_sample": f"""with {META_SQL}, r as (select *, {RANK_SQL('source_dataset, label')} as r, {SIZE_SQL('source_dataset, label')} as n from meta where {_NOT_MISSING})
       select id, source_dataset, label from r where r <= (select min(n) from r)""",
    "share_sample": f"with {META_SQL}, r as (select id, {RANK_SQL('domain')} as r, {SIZE_SQL('domain')} as n from meta) select id from r where r <= greatest(1, floor(n * 0.25::double + 0.5))",
    "row_cap": f"""with {META_SQL}, r as (select id, label, {RANK_SQL('label')} as r, {SIZE_SQL('label')} as n, count(*) over () as t from meta where {_NOT_MISSING}),
      q as (select label, greatest(1, n * 100 // t) as q, (n * 100) % t as rest from r group by all),
      p as (select label, q + case when row_number() over (order by rest desc, label) <= 100 - sum(q) over () then 1 else 0 end as q from q)
      select r.id, r.label from r join p using (label) where r.r <= p.q""",
    "value_counts": f"with {META_SQL} " + " union all ".join(f"select '{f}' as field, cast({f} as varchar) as value, count(*) as count from meta group by 2" for f in FIELDS),
    "group_sizes": f"with {RESPLIT_CTE} select sp as split, label, domain, generator, count(*) as n from rs group by all",
    "leaking_ids": f"""with {RESPLIT_CTE}, {SPLIT2_CTE} select id, count(distinct s) as n_splits from (select id, sp as s from rs union all select id, split from s2) group by 1 having count(distinct s) > 1""",
    "split_label_table": f"with {RESPLIT_CTE} select sp as split, count(*) filter (label = 0) as label_0, count(*) filter (label = 1) as label_1 from rs group by 1",
    "class_balance": f"""with {META_SQL} select source_dataset, count(*) filter (label = 1) as n_positive, count(*) filter (label = 0) as n_negative,
       {R6('count(*) filter (label = 1)::double / count(*)')} as positive_rate, {R6('count(*) filter (label = 0)::double / greatest(count(*) filter (label = 1), 1)')} as scale_pos_weight
       from meta where {_NOT_MISSING} group by 1""",
    "dataset_stats": f"""with {META_SQL} select source_dataset, count(*) as rows, count(*) filter (label = 0) as label_0, count(*) filter (label = 1) as label_1,
       (bool_or(label = 0) and bool_or(label = 1)) as both_classes from meta group by 1""",
    "train_assignments": f"with {RESPLIT_CTE}, {DEFS_SQL} select train_name, sp as role, count(*) as count from rs join defs using (source_dataset) group by all",
    "train_test_overlap": f"""with {RESPLIT_CTE}, {DEFS_SQL} select train_name, domain || '_all' as test_name, count(*) as overlap_ids from rs join defs using (source_dataset) where sp = 'train' group by all""",
    "missing_ids": "select cast(doc_id as varchar) as id from documents where doc_id not in (select doc_id from labels)",
    "common_ids": "select cast(doc_id as varchar) as id from documents where doc_id in (select doc_id from labels where toxic = 0)",
    "category_rules": f"""with p as (select page_id, lower(trim(url)) as u, lower(regexp_extract(url, 'https?://([a-z]+)', 1)) as g, regexp_extract(url, '/(\\d+)', 1) as n from pages)
       select page_id, coalesce({_case('u', DOMAIN_RULES)}, {_slug('u', 'a-z0-9_')}) as domain, coalesce({_case('u', DOMAIN_PATH_RULES)}, 'unknown') as path_domain,
       case when g in ('', 'nan') then 'unknown' else coalesce({_case('g', GENERATOR_RULES)}, {_slug('g', 'a-z0-9._-')}) end as generator,
       coalesce({_case('u', GENERATOR_PATH_RULES)}, 'unknown') as path_generator,
       case when g in ('', 'nan') then 'none' else coalesce({_case('g', ATTACK_RULES)}, 'unknown') end as attack_type,
       {_case('g', [(n, (n, *w)) for n, w in SPLIT_RULES], True)} as split, {_case('u', SPLIT_PATH_RULES)} as path_split,
       case try_cast(n as integer) when 0 then 0 when 1 then 1 end as label from p""",
    "label_rules": """with v as (select turn, role, case when turn % 3 = 0 then cast(turn as varchar) when turn % 3 = 1 then role end as x from conversations),
       w as (select turn, case when x is not null and try_cast(x as double) is not null then case when x in ('0', '1') then cast(x as integer) end
          when role = 'user' then 0 else 1 end as label from v)
       select turn, label, count(*) as count from w group by all""",
}

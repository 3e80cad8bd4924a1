"""Corpus operators: required columns, cleaning with reasons, first-wins dedup, splits, samples, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import categories
from ..functions.columns import clean_text, strip_space
from ..functions.fixed_values import CAP_GROUP, DOCUMENT_COLUMNS, SUMMARY_FIELDS
from ..session import cut_lineage
from .ranking import hash_rank

SPLITS = ("train", "dev", "test")


def first_existing(columns: Sequence[str], synonyms: Sequence[str]) -> str | None:
    """The first synonym that names a column, whatever its case."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[s] for s in synonyms if s in by_lower), None)


def complete_columns(df: DataFrame, required: Sequence[str] = DOCUMENT_COLUMNS) -> DataFrame:
    """Add missing required columns: 0 for the label, else an empty string."""
    return df.withColumns({c: F.lit(0) if c == "label" else F.lit("") for c in required if c not in df.columns})


def document_table(df: DataFrame) -> DataFrame:
    """Required columns, cleaned non-empty text, string id, integer label (0 where unreadable)."""
    df = complete_columns(df).withColumn("text", clean_text(F.col("text"))).filter(F.length("text") > 0)
    number = F.coalesce(F.col("label").cast("string").try_cast("double"), F.lit(0.0))
    return df.withColumns({"id": F.col("id").cast("string"), "label": F.when(F.isnan(number), 0).otherwise(number.cast("int"))}).select(*DOCUMENT_COLUMNS)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, that with the smallest ``order``; of rows with the same order, which are copies, one.

    The minimum is combined map-side, so a key with very many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("_first"))
    names = {**{k: F.col(k) for k in keys}, **{c: F.col("_first")[c].alias(c) for c in (order, *rest)}}
    return firsts.select(*[names[c] for c in df.columns])


def removal_reasons(df: DataFrame, order: str = "order", min_words: int = 50, max_words: int = 1000) -> DataFrame:
    """(order, reason) for every row: empty, too_short, too_long, invalid_label, duplicate, or null for kept rows.

    Tests are applied in that order and duplicates are looked for among the rows that passed the others. Of rows with the same
    order, as ids made from contents may be, one counts as the first. The text leaves this function as a hash only.
    """
    text = strip_space(F.col("text").cast("string"))
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    first_fault = (
        F.when(F.col("text").isNull() | (text == "") | (F.lower(text) == "nan"), "empty")
        .when(words < min_words, "too_short")
        .when(words > max_words, "too_long")
        .when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "invalid_label")
    )
    # the number of a row is fixed by writing it
    rows = cut_lineage(df.select(order, first_fault.alias("_fault"), F.unhex(F.sha2(text, 256)).alias("_key"), F.monotonically_increasing_id().alias("_row")))
    firsts = rows.filter(F.col("_fault").isNull()).groupBy("_key").agg(F.min(F.struct(order, "_row")).alias("_m")).select(F.col("_m._row").alias("_row"), F.lit(True).alias("_first"))
    reason = F.coalesce(F.col("_fault"), F.when(F.col("_first").isNull(), F.lit("duplicate")))
    return rows.drop("_key").join(firsts, "_row", "left").select(order, reason.alias("reason"))


def clean_corpus(df: DataFrame, order: str = "order", min_words: int = 50, max_words: int = 1000) -> DataFrame:
    """Rows without a removal reason, text stripped; of equal rows with the same order one stays."""
    kept = removal_reasons(df, order, min_words, max_words).filter(F.col("reason").isNull()).select(order)
    return df.join(kept, order, "left_semi").select(*df.columns).dropDuplicates([order]).withColumn("text", strip_space(F.col("text")))


def removal_counters(reasons: DataFrame) -> DataFrame:
    """One row of counters plus input and kept rows."""
    names = ("empty", "too_short", "too_long", "invalid_label", "duplicate")
    return reasons.agg(
        F.count(F.lit(1)).alias("input_rows"),
        *[F.count_if(F.col("reason") == n).alias(f"{n}_removed") for n in names],
        F.count_if(F.col("reason").isNull()).alias("final_rows"),
    )


def value_counts(df: DataFrame, fields: Sequence[str] = SUMMARY_FIELDS) -> DataFrame:
    """(field, value, count) for several fields in one pass, null values included."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("_p")).select("_p.field", "_p.value").groupBy("field", "value").count()


def group_sizes(df: DataFrame, groups: Sequence[str] = ("split", "label", "domain", "generator")) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def leaking_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur in more than one split."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def assert_no_leak(df: DataFrame, key: str = "id") -> None:
    found = leaking_ids(df, key).limit(5).collect()
    if found:
        raise ValueError(f"ids in more than one split, e.g. {[r[key] for r in found]}")


def split_label_table(df: DataFrame, splits: Sequence[str] = SPLITS, label_values: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts per split and label, zero-filled."""
    return df.groupBy("split").agg(*[F.count_if(F.col("label") == v).alias(f"label_{v}") for v in label_values]).filter(
        F.col("split").isin(*splits)
    )


def class_balance(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.groupBy(*groups).agg(
        pos.alias("n_positive"),
        neg.alias("n_negative"),
        F.coalesce(F.try_divide(pos.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("positive_rate"),
        (neg / F.greatest(pos, F.lit(1)).cast("double")).alias("scale_pos_weight"),
    )


def dataset_stats(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"),
        (F.bool_or(F.col("label") == 0) & F.bool_or(F.col("label") == 1)).alias("both_classes"),
    )


def _quota(share: float) -> Column:
    return F.floor(F.col("group_rows") * F.lit(share) + F.lit(0.5))


def can_stratify(df: DataFrame, label: str = "label") -> bool:
    sizes = df.groupBy(label).count().agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("m")).first()
    return bool(sizes["k"] and sizes["k"] > 1 and sizes["m"] >= 2)


def train_test_split(df: DataFrame, key: str = "id", label: str = "label", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` = train or test with exact shares per label; unstratified if a label has fewer than two rows."""
    groups = [label] if can_stratify(df, label) else []
    return hash_rank(df, groups, key, seed).withColumn("split", F.when(F.col("rank") <= _quota(1 - test_share), "train").otherwise("test")).drop("rank", "group_rows")


def resplit(df: DataFrame, key: str = "id", source: str = "source_dataset", label: str = "label", seed: int = 42, shares: Sequence[float] = (0.7, 0.1)) -> DataFrame:
    """Train/dev/test per source and label; a source that already has all three splits keeps them."""
    has = [F.bool_or(F.lower(F.col("split")) == s) for s in SPLITS]
    complete = df.groupBy(source).agg((has[0] & has[1] & has[2]).alias("_complete")).filter("_complete").select(source, F.lit(True).alias("_keep"))
    ranked = hash_rank(df, [source, label], key, seed).join(complete, source, "left")
    train, dev = _quota(shares[0]), _quota(shares[0] + shares[1])
    fresh = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= dev, "dev").otherwise("test")
    return ranked.withColumn("split", F.when(F.col("_keep"), F.lower("split")).otherwise(fresh)).drop("rank", "group_rows", "_keep")


def default_split(df: DataFrame, key: str = "id", source: str = "source_dataset", seed: int = 42, held_out: Sequence[str] = ("raid",)) -> DataFrame:
    """Keep known splits; held-out corpora become external_test; the rest is shuffled 80/10/10 per corpus."""
    known = categories.split(F.col("split"))
    df = df.withColumn("_known", known)
    outside = F.col(source).isin(*held_out)
    attacked = F.coalesce(F.col("attack_type"), F.lit("unknown")) != "none"
    external = F.when(outside & attacked, F.lit("external_test")).otherwise(F.coalesce("_known", F.lit("external_test")))
    df = df.withColumn("_open", ~outside & F.col("_known").isNull())
    ranked = hash_rank(df, [source, "_open"], key, seed)
    at = F.col("rank") - 1
    fresh = (
        F.when(at < F.floor(F.col("group_rows") * F.lit(0.8)), "train")
        .when(at < F.floor(F.col("group_rows") * F.lit(0.9)), "dev")
        .otherwise("test")
    )
    chosen = F.when(outside, external).when(F.col("_open"), fresh).otherwise(F.col("_known"))
    return ranked.withColumn("split", chosen).drop("_known", "_open", "rank", "group_rows")


def cap_groups(df: DataFrame, cap: int = 1000, groups: Sequence[str] = CAP_GROUP, key: str = "id", seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per group, chosen by seeded hash order."""
    return hash_rank(df, groups, key, seed).filter(F.col("rank") <= cap).drop("rank", "group_rows")


def balanced_sample(df: DataFrame, groups: Sequence[str] = ("source_dataset", "label"), key: str = "id", seed: int = 42) -> DataFrame:
    """As many rows per group as the smallest group has."""
    smallest = df.groupBy(*groups).count().agg(F.min("count")).first()[0]
    return df.limit(0) if smallest is None else cap_groups(df, smallest, groups, key, seed)


def share_sample(df: DataFrame, share: float, groups: Sequence[str], key: str = "id", seed: int = 42) -> DataFrame:
    """A fixed share of every group, at least one row."""
    return hash_rank(df, groups, key, seed).filter(F.col("rank") <= F.greatest(F.lit(1), _quota(share))).drop("rank", "group_rows")


def row_cap(df: DataFrame, max_rows: int, key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """Development runs: exactly ``max_rows`` rows in label proportion; all rows if there are no more than that.

    Each label gets the whole part of its share, but one row at least, and the largest remainders get one more (the smaller label
    first where they are equal).
    """
    sizes = [(r[label], r["count"]) for r in df.groupBy(label).count().collect()]
    n = sum(c for _, c in sizes)
    if n <= max_rows:
        return df
    quota = {v: max(1, c * max_rows // n) for v, c in sizes}
    while sum(quota.values()) > max_rows:
        quota[max(quota, key=quota.get)] -= 1
    by_rest = sorted(sizes, key=lambda x: (-(x[1] * max_rows % n), x[0] is None, x[0]))
    for v, _ in by_rest[: max_rows - sum(quota.values())]:
        quota[v] += 1
    allowed = F.lit(0)
    for v, k in quota.items():
        allowed = F.when(F.col(label).eqNullSafe(F.lit(v)), F.lit(k)).otherwise(allowed)
    return hash_rank(df, [label], key, seed).filter(F.col("rank") <= allowed).drop("rank", "group_rows")


def per_label_sample(df: DataFrame, total: int, key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """``total`` rows shared equally between the labels."""
    kinds = max(df.select(label).distinct().count(), 1)
    return cap_groups(df, max(1, total // kinds), [label], key, seed)


def train_definitions(sources: Sequence[str]) -> dict[str, list[str]]:
    """Named source sets: each source alone, all together, and all but one."""
    out = {f"train_{s}": [s] for s in sources}
    out["train_combined"] = list(sources)
    out.update({f"train_leave_out_{s}": [x for x in sources if x != s] for s in sources})
    return out


def assignments(df: DataFrame, definitions: dict[str, Sequence[str]], key: str = "id", source: str = "source_dataset") -> DataFrame:
    """(train_name, id, role): which row plays which part in which train definition."""
    names = df.sparkSession.createDataFrame([(n, s) for n, members in definitions.items() for s in members], f"train_name string, {source} string")
    return df.select(key, source, F.col("split").alias("role")).join(F.broadcast(names), source).select("train_name", key, "role")


def overlap(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """Ids shared by each (train_name, test_name) pair."""
    both = train.select("train_name", key).distinct().join(test.select("test_name", key).distinct(), key)
    return both.groupBy("train_name", "test_name").agg(F.count(F.lit(1)).alias("overlap_ids"))


def coverage(wanted: DataFrame, cached: DataFrame, key: str = "id") -> bool:
    """Whether every wanted id is cached."""
    return wanted.select(key).join(cached.select(key), key, "left_anti").isEmpty()


def same_ids(a: DataFrame, b: DataFrame, key: str = "id") -> bool:
    """Whether two tables hold the same ids, so that one may be used for the other."""
    return a.count() == b.count() and coverage(a, b, key) and coverage(b, a, key)

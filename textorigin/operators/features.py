"""Feature-table jobs: families per document, joins of families, column cleaning, imputation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions import arrays as A, text as X
from ..functions.columns import finite, to_number
from ..functions.fixed_values import METADATA_COLUMNS, TextRules
from ..session import cut_lineage
from .ranking import medians  # noqa: F401

FAMILIES = {"burst": X.burstiness, "struct": X.structure, "pert": X.stability}


def document_features(
    corpus: DataFrame,
    families: Sequence[str] = ("burst", "struct"),
    rules: TextRules = TextRules(),
    compression: bool = True,
    key: str = "id",
    text: str = "text",
) -> DataFrame:
    """``key`` plus the columns of the chosen families, from one scan and without any shuffle."""
    df = X.add_layers(X.cleaned(corpus.select(key, text), text), text)
    for family in families:
        if family == "burst":
            df = X.burstiness(df, text, compression)
        elif family == "struct":
            df = X.structure(df, text, rules)
        elif family == "pert":
            df = X.stability(df, text, rules, compression)
        else:
            raise ValueError(f"unknown feature family {family!r}")
    wanted = [c for c in df.columns if c.startswith(tuple(f"{f}_" for f in families))]
    return df.select(key, *wanted)


# ---------------------------------------------------------------- columns

FEATURE_GROUPS = (
    ("burst_", "burstiness"), ("struct_", "structure"), ("pert_", "perturbation"), ("scale_", "scale_response"),
    ("bino_", "binoculars_style"), ("koopman_", "koopman"), ("deep_dmd_", "deep_dmd"), ("pool_", "trajectory"),
)


def numeric_features(df: DataFrame, metadata: Sequence[str] = METADATA_COLUMNS) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in metadata]


def feature_group(column: str, probability_prefixes: Sequence[str] = ("ng1", "ng2", "ng3", "ng4")) -> str:
    """Family of a column by its prefix."""
    for prefix, group in FEATURE_GROUPS:
        if column.startswith(prefix):
            return group
    model = next((p for p in probability_prefixes if column.startswith(f"{p}_")), None)
    if model is None:
        return "other"
    return f"transition_{model}" if any(k in column for k in ("lossq", "rank")) else f"probability_{model}"


def catalogue(df: DataFrame, metadata: Sequence[str] = METADATA_COLUMNS) -> DataFrame:
    """(feature, group) rows."""
    rows = [(c, feature_group(c)) for c in numeric_features(df, metadata)]
    return df.sparkSession.createDataFrame(rows, "feature string, group string")


def detect_groups(columns: Sequence[str], stated: dict[str, Sequence[str]] | None = None, fallback: dict[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Columns per group: a stated list if there is one, else prefix or known name endings; order kept, no repeats."""
    out: dict[str, list[str]] = {}
    for prefix, group in FEATURE_GROUPS:
        listed = [c for c in (stated or {}).get(group, ()) if c in columns]
        names = (fallback or {}).get(group, ())
        out[group] = listed or [c for c in columns if c.startswith(prefix) or c in names or any(c.endswith(f"_{n}") for n in names)]
    for c in columns:
        g = feature_group(c)
        if g.startswith(("probability_", "transition_")):
            out.setdefault(g, []).append(c)
    return {g: list(dict.fromkeys(cs)) for g, cs in out.items()} | {"all": list(columns)}


def column_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature: values, missing, infinite, smallest, largest, std; one pass in long form."""
    number = lambda c: f"cast(`{c}` as double)"
    pairs = ", ".join(f"'{c}', {number(c)}" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) as (feature, v)")
    infinite = F.abs(F.col("v")) == float("inf")
    known = finite(F.col("v"))
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(known).alias("finite_count"),
        F.count_if(F.col("v").isNull() | F.isnan("v")).alias("nan_count"),
        F.count_if(infinite).alias("inf_count"),
        F.min(known).alias("lowest"),
        F.max(known).alias("highest"),
        F.stddev_samp(known).alias("std"),
    )


def clean_columns(audit: DataFrame, order: Sequence[str], inf_rule: str = "any", placeholder: str | None = None) -> tuple[list[str], dict]:
    """Columns worth training on, and why the others were dropped.

    ``inf_rule``: drop columns with ``any`` infinity, only with ``all`` infinite values, or ``ignore`` them.
    """
    rows = {r["feature"]: r for r in audit.collect()}
    test = {"any": lambda r: r["inf_count"] > 0, "all": lambda r: r["rows"] > 0 and r["inf_count"] == r["rows"], "ignore": lambda r: False}[inf_rule]
    faults = {
        "dropped_all_nan": [c for c in order if rows[c]["finite_count"] == 0],
        "dropped_inf": [c for c in order if test(rows[c])],
        "dropped_constant": [c for c in order if rows[c]["finite_count"] > 0 and rows[c]["lowest"] == rows[c]["highest"]],
        "dropped_placeholder": [c for c in order if placeholder and placeholder in c.lower()],
    }
    gone = {c for cs in faults.values() for c in cs}
    kept = [c for c in order if c not in gone]
    return kept, {"initial_numeric_columns": len(order), **{k: sorted(v) for k, v in faults.items()}, "final_features": len(kept)}


def audit_report(df: DataFrame, used: Sequence[str], placeholder: str | None = None) -> dict:
    """Unused, missing, constant and placeholder columns of a trained feature list, with counts per family."""
    present = numeric_features(df)
    existing = [c for c in used if c in df.columns]
    kept, info = clean_columns(column_audit(df, existing), existing, "ignore", placeholder)
    rows = column_audit(df, existing).agg(F.count_if(F.col("nan_count") > 0).alias("n"), F.count_if(F.col("inf_count") > 0).alias("i")).first()
    groups: dict[str, int] = {}
    for c in existing:
        groups[feature_group(c)] = groups.get(feature_group(c), 0) + 1
    missing = [c for c in used if c not in df.columns]
    return {
        "unused": [c for c in present if c not in set(used)], "missing": missing, "nan_columns": rows["n"], "inf_columns": rows["i"],
        "constant": info["dropped_constant"], "placeholder": info["dropped_placeholder"],
        "drop_recommended": sorted({*info["dropped_constant"], *info["dropped_placeholder"], *missing}), "group_counts": groups,
    }


def renamed(df: DataFrame, key: str = "id", prefix: str = "", suffix: str = "") -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns if c != key])


# ---------------------------------------------------------------- joins


def merge_families(base: DataFrame, tables: Sequence[DataFrame], key: str = "id", metadata: Sequence[str] = METADATA_COLUMNS) -> DataFrame:
    """Left join of feature tables on id; their metadata and non-numeric columns are dropped.

    All sides are shuffled by the same key, so n joins need n + 1 exchanges and no re-shuffle in between.
    """
    out = base
    for t in tables:
        out = out.join(t.select(key, *numeric_features(t, metadata)), key, "left")
    return out


def join_one_to_one(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Left join that fails if the key repeats on either side."""
    for side, name in ((left, "left"), (right, "right")):
        twice = side.groupBy(key).count().filter("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"{name} side repeats {key}, e.g. {[r[key] for r in twice]}")
    return left.join(right, key, "left")


def without_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose features are all missing."""
    return df.filter(F.coalesce(*[F.col(c) for c in cols]).isNull())


def first_match(tables: Sequence[DataFrame], key: str = "id", last_wins: bool = False) -> DataFrame:
    """One row per id from tables in order of priority; differing columns are filled with null.

    The choice is a min/max aggregate with map-side combine, so an id with many copies stays cheap.
    """
    tagged = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    pool = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = [c for c in pool.columns if c not in (key, "_rank")]
    pick = F.max_by if last_wins else F.min_by
    return pool.groupBy(key).agg(pick(F.struct(*cols), F.col("_rank")).alias("_r")).select(key, "_r.*")


def pooled_left_join(base: DataFrame, tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    return base.join(first_match(tables, key), key, "left")


# ---------------------------------------------------------------- imputation


def sanitized(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers or null: text is parsed, infinities and NaN become null."""
    return df.withColumns({c: to_number(F.col(c)) for c in cols})


def imputed(df: DataFrame, cols: Sequence[str], medians: dict[str, float]) -> DataFrame:
    """Nulls, NaN and infinities replaced by the (training) medians, 0 where there is none."""
    fill = lambda c: f"case when `{c}` is null or isnan(`{c}`) or abs(`{c}`) = double('infinity') then {float(medians.get(c) or 0.0)!r}D else cast(`{c}` as double) end as `{c}`"
    rest = [f"`{c}`" for c in df.columns if c not in set(cols)]
    return df.selectExpr(*rest, *[fill(c) for c in cols])


def subset(features: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a bigger feature table for the given ids, in left-join fashion."""
    return ids.select(key).join(features, key, "left")


# ---------------------------------------------------------------- semantic stability


def semantic_stability(corpus: DataFrame, key: str = "id", text: str = "text", rules: TextRules = TextRules()) -> DataFrame:
    """Mean and std of the TF-IDF cosine between a text and its rewritings (0 without rewritings), exact by word.

    Document frequencies are those of the corpus. A row per (document, distinct word) holds the word's counts in the text and its at
    most five rewritings; all words of a document come from one task, so they are added up before the shuffle.
    """
    docs = X.cleaned(corpus.select(key, text), text).withColumn("_vs", X.rewritten(F.col(text), rules))
    versions = docs.select(key, F.posexplode(F.concat(F.array(F.col(text)), "_vs")).alias("_k", "_v"))
    words = versions.select(key, "_k", F.explode(F.transform(X.tokens(F.col("_v")), F.lower)).alias("_w"))
    texts = range(6)
    counts = cut_lineage(words.groupBy(key, "_w").agg(*[F.count_if(F.col("_k") == k).cast("double").alias(f"_n{k}") for k in texts]))
    total = docs.count()
    weight = F.log(F.lit(total + 1.0) / (F.count_if(F.col("_n0") > 0) + F.lit(1.0)))
    weighted = counts.join(counts.groupBy("_w").agg((weight * weight).alias("_i")), "_w")
    product = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_i"))
    sums = weighted.groupBy(key).agg(*[product("_n0", f"_n{k}").alias(f"_d{k}") for k in texts], *[product(f"_n{k}", f"_n{k}").alias(f"_s{k}") for k in texts])
    cosine = lambda k: F.coalesce(F.try_divide(F.col(f"_d{k}"), F.sqrt("_s0") * F.sqrt(f"_s{k}")), F.lit(0.0))
    joined = docs.select(key, F.size("_vs").alias("_m")).join(sums, key, "left")
    stats = joined.withColumn("_s", A.mean_std(F.slice(F.array(*[cosine(k) for k in texts[1:]]), F.lit(1), F.col("_m"))))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return stats.select(key, none(F.col("_s.mean")).alias("pert_semantic_similarity_mean"), none(F.col("_s.std")).alias("pert_semantic_similarity_std"))

"""Feature drift between a training set and test sets, extreme domains, per-row deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .features import imputed
from .ranking import medians, prefix_sums, quantiles


def _long(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(cols)}, {pairs}) as (feature, value)")


def feature_shift(train: DataFrame, tests: DataFrame, cols: Sequence[str], test_name: str = "test_name") -> DataFrame:
    """Mean, variance, standardised mean difference and two-sample KS per (test set, feature).

    Missing values take the training medians. KS needs sorted values: equal ones are counted first, all test
    sets run along in the same sorted pass, and features with very many values are split into ordered parts.
    """
    med = medians(train, cols)
    names = sorted(r[0] for r in tests.select(test_name).distinct().collect())
    rows = _long(imputed(train, cols, med).withColumn("_set", F.lit(-1)), ["_set"], cols).unionByName(
        _long(imputed(tests, cols, med).withColumn("_set", F.array_position(F.array(*[F.lit(n) for n in names]), F.col(test_name)).cast("int") - 1), ["_set"], cols))
    sets = range(-1, len(names))
    col = lambda i: f"c{i + 1}"
    counted = cut_lineage(rows.groupBy("feature", "value").agg(*[F.count_if(F.col("_set") == i).alias(col(i)) for i in sets]))
    total = lambda i: F.sum(col(i)).alias(f"n{i + 1}")
    v, c = F.col("value"), F.col
    sums = counted.groupBy("feature").agg(*[total(i) for i in sets], *[(F.sum(v * c(col(i))) / F.sum(col(i))).alias(f"m{i + 1}") for i in sets])
    # a few rows per feature: how many values, and the means to centre the squares on
    squares = counted.join(sums.select("feature", *[f"m{i + 1}" for i in sets]), "feature").groupBy("feature").agg(
        *[F.sum(F.col(col(i)) * (v - F.col(f"m{i + 1}")) * (v - F.col(f"m{i + 1}"))).alias(f"q{i + 1}") for i in sets])
    running = prefix_sums(counted, ["feature"], "value", {f"r{i + 1}": col(i) for i in sets})
    share = lambda i: F.col(f"r{i + 1}") / F.col(f"n{i + 1}")
    ks = running.join(sums, "feature").groupBy("feature").agg(*[F.max(F.abs(share(-1) - share(i))).alias(f"k{i + 1}") for i in range(len(names))])
    wide = sums.join(squares, "feature").join(ks, "feature")
    var = lambda i: F.try_divide(F.col(f"q{i + 1}"), (F.col(f"n{i + 1}") - 1).cast("double"))
    cells = F.array(*[
        F.struct(
            F.lit(n).alias(test_name), F.col("m0").alias("train_mean"), var(-1).alias("train_variance"), F.col(f"m{i + 1}").alias("test_mean"),
            var(i).alias("test_variance"),
            F.abs(F.try_divide(F.col(f"m{i + 1}") - F.col("m0"), F.sqrt(var(-1)))).alias("standardized_mean_difference"),
            F.col(f"k{i + 1}").alias("ks_statistic"))
        for i, n in enumerate(names)])
    return wide.select("feature", F.explode(cells).alias("_c")).select("feature", "_c.*")


def top_shifts(shift: DataFrame, n: int = 30, test_name: str = "test_name") -> DataFrame:
    """The ``n`` most shifted features per test set; a set has one row per feature, so its window is small."""
    order = Window.partitionBy(test_name).orderBy(F.desc_nulls_last("standardized_mean_difference"), F.desc_nulls_last("ks_statistic"), "feature")
    return shift.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def shift_summary(shift: DataFrame, test_name: str = "test_name") -> DataFrame:
    return shift.groupBy(test_name).agg(F.avg("standardized_mean_difference").alias("mean_smd"), F.avg("ks_statistic").alias("mean_ks"))


def domain_scores(df: DataFrame, cols: Sequence[str], domain: str = "domain", min_rows: int = 30) -> DataFrame:
    """Mean absolute standardised distance of each domain's means from the global ones; null below ``min_rows``."""
    x = imputed(df, cols, medians(df, cols))
    glob = x.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    per = x.groupBy(domain).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)])
    terms = [F.abs((F.col(f"a{i}") - F.lit(glob[f"m{i}"])) / F.lit(glob[f"s{i}"])) for i in range(len(cols)) if glob[f"s{i}"]]
    return per.select(domain, "n", F.when(F.col("n") >= min_rows, sum(terms, F.lit(0.0)) / F.lit(float(max(len(terms), 1)))).alias("score"))


def drop_extreme_domains(df: DataFrame, cols: Sequence[str], domain: str = "domain", min_rows: int = 30, keep_at_least: int = 100) -> DataFrame:
    """Rows of domains that are large enough and not among the 10 % most distant; everything if too little would remain."""
    if df.select(domain).where(F.col(domain).isNotNull()).distinct().limit(3).count() <= 2:
        return df
    scores = cut_lineage(domain_scores(df, cols, domain, min_rows))
    found = quantiles(scores.filter("score is not null"), ["score"], [0.9]).first()
    if found is None or found["quantiles"] is None:
        return df
    kept = df.join(scores.filter(F.col("score") <= found["quantiles"][0]).select(domain), domain, "left_semi").select(*df.columns)
    return kept if kept.limit(keep_at_least).count() >= keep_at_least else df


def reference_statistics(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(median, population std) per column; a handful of numbers."""
    med = medians(train, cols)
    row = train.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (med[c], row[f"s{i}"]) for i, c in enumerate(cols)}


def top_deviations(df: DataFrame, reference: dict[str, tuple[float, float]], importance: dict[str, float] | None = None, n: int = 5):
    """Array of the ``n`` features that stand out most in each row: |x - median| / std * importance. In-row."""
    usable = {c: (m, s) for c, (m, s) in reference.items() if s and c in df.columns}
    score = lambda c: F.abs(F.col(c) - F.lit(usable[c][0])) / F.lit(usable[c][1]) * F.lit(float((importance or {}).get(c, 1.0)))
    entries = F.array(*[F.struct(score(c).alias("score"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in usable])
    return F.slice(F.sort_array(F.filter(entries, lambda e: e["score"].isNotNull()), asc=False), 1, n)

import hashlib

import numpy as np
from pyspark.sql import functions as F

from textorigin.operators import corpus as C
from textorigin.operators.ranking import hash_rank, lagged, long_quantiles, prefix_sums, quantiles


def test_hash_rank_with_a_hot_and_a_null_group(spark):
    rows = [(str(i), "hot" if i % 10 else None if i % 20 else "cold") for i in range(500)]
    got = {r["id"]: (r["rank"], r["group_rows"]) for r in hash_rank(spark.createDataFrame(rows, "id string, g string"), ["g"], buckets=16).collect()}
    for g in ("hot", "cold", None):
        ids = sorted((i for i, x in rows if x == g), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]


def test_split_groups_give_the_same_running_sums(spark):
    df = spark.range(600).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") * 37 % 601).cast("double").alias("v"), F.col("id").alias("w"))
    for descending in (False, True):
        plain = prefix_sums(df, ["g"], "v", {"s": "w"}, descending).collect()
        split = prefix_sums(df, ["g"], "v", {"s": "w"}, descending, buckets=7).collect()
        key = lambda r: (r["g"], r["v"], r["w"], r["s"])
        assert sorted(map(key, plain)) == sorted(map(key, split))


def test_split_lag(spark):
    df = spark.range(300).select(F.lit("a").alias("g"), "id", (F.col("id") * 7 % 11).alias("v"))
    plain = {r["id"]: r["p"] for r in lagged(df, ["g"], "id", "v", "p").collect()}
    split = {r["id"]: r["p"] for r in lagged(df, ["g"], "id", "v", "p", buckets=5).collect()}
    assert plain == split and plain[0] is None and plain[1] == 0


def test_quantiles_agree_on_both_paths(spark):
    rng = np.random.default_rng(1)
    data = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(np.round(rng.normal(size=401), 1))]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    for got in (quantiles(df, ["v"], probs, ["g"]), long_quantiles(df, ["g"], "v", probs, buckets=3)):
        for r in got.collect():
            assert np.allclose(r["quantiles"], np.quantile([v for g, v in data if g == r["g"]], probs))


def test_splits_cover_and_are_disjoint(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7 == 0).cast("int").alias("label"), F.when(F.col("id") < 120, "x").otherwise("y").alias("source_dataset"), F.lit(None).cast("string").alias("split"))
    two = C.train_test_split(df)
    assert two.count() == 200 and two.filter("split = 'train'").count() == sum(int(np.floor(0.8 * n + 0.5)) for n in (29, 171))
    three = C.resplit(df)
    assert three.select("id").distinct().count() == 200 and C.leaking_ids(three).isEmpty()
    again = C.resplit(three)
    assert {tuple(r) for r in again.select("id", "split").collect()} == {tuple(r) for r in three.select("id", "split").collect()}
    lone = df.withColumn("label", F.when(F.col("id") == "3", 1).otherwise(0))
    assert C.train_test_split(lone).filter("split = 'train'").count() == 160


def test_cleaning_keeps_the_first_copy_and_counts_every_row(spark):
    words = " ".join(["w"] * 50)
    rows = [(0, words, 1), (1, f" {words} ", 0), (2, "", 1), (3, "nan", 1), (4, "short", 1), (5, " ".join(["w"] * 1001), 1), (6, words + " x", 2), (7, words + " x", None), (8, words + " y", 0)]
    df = spark.createDataFrame(rows, "order int, text string, label int")
    got = {r["order"]: r["reason"] for r in C.removal_reasons(df).collect()}
    assert got == {0: None, 1: "duplicate", 2: "empty", 3: "empty", 4: "too_short", 5: "too_long", 6: "invalid_label", 7: "invalid_label", 8: None}
    c = C.removal_counters(C.removal_reasons(df)).first()
    assert c["input_rows"] - c["final_rows"] == sum(c[k] for k in c.asDict() if k.endswith("_removed"))
    assert {r["order"] for r in C.clean_corpus(df).collect()} == {0, 8}


def test_one_text_copied_very_often(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("t"))
    assert C.keep_first(df, ["t"], "id").count() == 1001


def test_reuse_checks(spark):
    a, b = spark.range(5).toDF("id"), spark.range(6).toDF("id")
    assert C.coverage(a, b) and not C.coverage(b, a) and not C.same_ids(a, b) and C.same_ids(a, spark.range(5).toDF("id"))

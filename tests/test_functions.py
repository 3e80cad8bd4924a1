import gzip
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textorigin.functions import arrays as A, categories as K, text as X
from textorigin.functions.columns import clean_text, finite, ratio
from textorigin.operators.features import document_features

SEQUENCES = [[], [1.0], [2.0, 2.0, 2.0], [3.0, 1.0, 2.0, 1.0, 5.0], [0.5, 0.25, 9.0, -1.0, 0.25, 0.25, 4.0]]


def frame(spark, seqs=SEQUENCES):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, a array<double>")


def test_moments_and_std(spark):
    rows = frame(spark).select("a", A.moments(F.col("a")).alias("m"), A.mean_std(F.col("a")).alias("s")).collect()
    for r in rows:
        v = np.array(r["a"])
        if not len(v):
            assert r["m"]["mean"] is None and r["s"]["std"] is None
            continue
        assert math.isclose(r["m"]["mean"], v.mean()) and math.isclose(r["s"]["std"], v.std(), abs_tol=1e-12)
        assert math.isclose(r["m"]["m3"], ((v - v.mean()) ** 3).mean(), abs_tol=1e-9)
        assert math.isclose(r["m"]["m4"], ((v - v.mean()) ** 4).mean(), abs_tol=1e-9)


def test_tied_percent_rank(spark):
    for r in frame(spark).select("a", A.tied_percent_rank(F.col("a")).alias("r")).collect():
        assert np.allclose(r["r"], pd.Series(r["a"], dtype=float).rank(pct=True).to_numpy()) if r["a"] else r["r"] == []


def test_edge_mean_and_entropy(spark):
    rows = frame(spark).select("a", A.edge_mean(F.col("a"), 0.1, True).alias("t"), A.edge_mean(F.col("a"), 0.5, False).alias("b")).collect()
    for r in rows:
        v = sorted(r["a"])
        if v:
            assert r["t"] == max(v) and math.isclose(r["b"], np.mean(v[: max(1, math.ceil(len(v) * 0.5))]))
    got = spark.range(1).select(A.entropy(F.array(*[F.lit(x) for x in (1, 1, 2, 0)])).alias("e"), A.entropy(F.array(F.lit(0))).alias("z")).first()
    assert math.isclose(got["e"], 1.5) and got["z"] is None


def test_log_rank_deviation(spark):
    sizes = [9, 4, 4, 2, 1, 1]
    x, y = np.log(np.arange(1, 7)), np.log(sizes)
    slope, intercept = np.polyfit(x, y, 1)
    got = spark.range(1).select(A.log_rank_deviation(F.array(*[F.lit(s) for s in sizes])).alias("d"), A.log_rank_deviation(F.array(F.lit(3), F.lit(1))).alias("z")).first()
    assert math.isclose(got["d"], np.abs(y - slope * x - intercept).mean()) and got["z"] == 0.0


def test_text_traps(spark):
    raw = "　Hello\x0b world\t\t!\n\n\n\nπ is 3.14？！ Don't stop"
    row = spark.createDataFrame([(raw,)], "t string").select(clean_text(F.col("t")).alias("c")).select("c", X.tokens(F.col("c")).alias("w"), X.sentences(F.col("c")).alias("s"), X.paragraphs(F.col("c")).alias("p")).first()
    assert row["c"] == "Hello world !\n\nπ is 3.14？！ Don't stop"
    assert row["w"] == ["Hello", "world", "is", "3.14", "Don't", "stop"]
    assert row["s"] == ["Hello world !", "π is 3.", "14？", "！", "Don't stop"]
    assert row["p"] == ["Hello world !", "π is 3.14？！ Don't stop"]


def test_chinese_phrases_and_rewritings(spark):
    t = "综上所述，模型显著提升效率，不仅如此，而且为政策提供参考。第二句，很好！！第三句。"
    df = spark.createDataFrame([("1", t)], "id string, text string")
    f = document_features(df, ["struct", "pert"]).first()
    assert f["struct_template_phrase_count"] == 5.0  # four phrases and the pattern
    variants = df.select(X.rewritten(F.col("text")).alias("v")).first()["v"]
    assert len(variants) == len(set(variants)) == f["pert_perturbation_count"] and t not in variants
    assert variants[0].startswith("，模型提升效率") and "！！" not in variants[0]
    assert any(v.startswith("模型显著提升效率，综上所述，") for v in variants)


def test_compression_leaf(spark):
    t = "abc " * 50
    f = document_features(spark.createDataFrame([("1", t)], "id string, text string"), ["burst"]).first()
    raw = t.strip().encode()
    assert f["burst_compression_ratio_zlib"] == len(zlib.compress(raw)) / len(raw)
    assert f["burst_compression_ratio_gzip"] == len(gzip.compress(raw)) / len(raw)


def test_empty_documents_are_dropped(spark):
    df = spark.createDataFrame([("1", " \n\t "), ("2", None), ("3", "!")], "id string, text string")
    rows = document_features(df, ["burst", "struct", "pert"]).collect()
    assert [r["id"] for r in rows] == ["3"]
    assert rows[0]["burst_word_count"] == 0 and rows[0]["struct_unique_bigram_ratio"] == 0 and rows[0]["burst_type_token_ratio"] == 0


def test_numbers_and_categories(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(finite(F.col("v"))).collect()] == [None, None, None, 2.0]
    assert [r[0] for r in df.select(ratio(F.lit(1.0), F.when(F.col("v") == 2, F.col("v")))).collect()][:3] == [0.0, 0.0, 0.0]
    c = spark.createDataFrame([("GPT-3.5-turbo", None), ("My Model!", 1), ("x", 0), ("", None), ("nan", 1)], "g string, l int")
    assert [r[0] for r in c.select(K.generator(F.col("g"), F.col("l"))).collect()] == ["gpt3.5", "my_model", "human", "unknown", "unknown"]
    paths = spark.createDataFrame([("/data/train/x.jsonl",), ("/data/human/x",), ("/data/ai/x",)], "p string")
    none = F.lit(None).cast("string")
    assert [r[0] for r in paths.select(K.label(none, none, F.col("p"))).collect()] == [None, 0, 1]
    values = spark.createDataFrame([("1.0",), ("0",), ("2",), ("Machine",), ("?",), ("-0.5",)], "v string")
    assert [r[0] for r in values.select(K.label(F.col("v"), none, F.lit("/x"))).collect()] == [1, 0, None, 1, None, 0]

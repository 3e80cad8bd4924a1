"""Cut points and ranks of whole arrays in narrow passes, without a row per element."""

import numpy as np
from pyspark.sql import functions as F

from textorigin.operators import selection, surprise as L, transition as X

RNG = np.random.default_rng(3)


def test_quantiles_of_array_columns(spark):
    rows = [(RNG.normal(size=n).round(3).tolist(), RNG.random(n).tolist()) for n in (0, 1, 400, 700)]
    df = spark.createDataFrame([*rows, (None, None)], "a array<double>, b array<double>").repartition(3)
    got = selection.exact_quantiles(df, ["a", "b"], [0.0, 0.3, 0.5, 1.0])
    for i, c in enumerate("ab"):
        assert np.allclose(got["", c], np.quantile(np.concatenate([r[i] for r in rows]), [0.0, 0.3, 0.5, 1.0]))
    assert selection.exact_quantiles(df.filter("size(a) = 0"), ["a"], [0.5]) == {("", "a"): None}


def test_scores_of_finite_values(spark):
    rows = [[1.0, float("nan"), 3.0, None, 8.0], [2.0, 2.0], [], None, [float("inf"), 4.0]]
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>")
    found = X.with_z_scores(df, "x").collect()
    assert [r["raw"] for r in found] == [[1.0, 3.0, 8.0], [2.0, 2.0], [], [], [4.0]]
    want = [r["z"] for r in df.select(X.z_scores(F.coalesce(X.finite_values(F.col("x")), F.array().cast("array<double>"))).alias("z")).collect()]
    assert [r["zscore"] for r in found] == want
    assert "Generate" not in X.with_z_scores(df, "x")._jdf.queryExecution().toString()


def test_ranks_of_losses(spark):
    """As a rank of falling values with ties averaged, rounded half up to 8 digits."""
    rows = [RNG.integers(0, 40, n).astype(float).tolist() for n in (0, 1, 7, 512, 1024)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*rows, None])], "i int, x array<double>")
    ranked = df.select("i", "x", L.probability_rank(F.col("x")).alias("r"))
    want = df.select("i", F.transform(L.A.tied_percent_rank(F.transform("x", lambda x: -x)), lambda r: F.round(r, 8)).alias("w"))
    assert all(r["r"] == r["w"] for r in ranked.join(want, "i").collect())
    assert "ArrowEvalPython" in ranked._jdf.queryExecution().toString()

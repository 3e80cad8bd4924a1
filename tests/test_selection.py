import math

import numpy as np
import pytest

from textorigin.operators import ranking, selection


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, np.inf, np.nan])
    keys = selection.keys_of(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == len(x) - 1
    assert np.array_equal(selection.values_of(keys), x, equal_nan=True)


@pytest.mark.parametrize("few", [0, 3, 256])
def test_exact_quantiles(spark, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(5)
    n = 700
    table = {
        "a": rng.normal(0, 1, n).tolist(), "b": [None if i % 3 else float(i % 7) for i in range(n)], "c": [None] * n, "d": [2.5] * n,
        "e": (rng.integers(0, 3, n) * 1e-9 + 1).tolist(), "f": [-0.0 if i % 2 else 0.0 for i in range(n)], "g": [float(i) ** 9 * (-1) ** i for i in range(n)],
    }
    names = [["x", "y", "z"][i % 3] for i in range(n)]
    df = spark.createDataFrame(list(zip(names, *table.values())), "name string, " + ", ".join(f"{c} double" for c in table)).repartition(3)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.97, 1.0]

    def check(found, rows):
        for c, v in table.items():
            own = [v[i] for i in rows if v[i] is not None]
            assert (found[c] is None) == (not own)
            if own:
                assert np.allclose(found[c], np.quantile(own, probs), rtol=1e-12, atol=1e-15), c

    whole = selection.exact_quantiles(df, list(table), probs)
    check({c: whole["", c] for c in table}, range(n))
    parts = selection.exact_quantiles(df, list(table), probs, "name", ["x", "z", "none"])
    for g in ("x", "z"):
        check({c: parts[g, c] for c in table}, [i for i in range(n) if names[i] == g])
    assert all(parts["none", c] is None for c in table)
    assert selection.exact_quantiles(df.limit(0), ["a"], [0.5]) == {("", "a"): None}
    assert ranking.medians(df, ["a", "c"]) == {"a": pytest.approx(float(np.median(table["a"]))), "c": 0.0}
    assert ranking.medians_by(df, ["d"], "name", ["x"]) == {"x": {"d": 2.5}}


def test_no_cell_is_shuffled(spark):
    df = spark.range(1_000).selectExpr("cast(id as double) as a", "cast(id % 10 as double) as b")
    parts = df.selectExpr("0 as _g", "a", "b").mapInArrow(selection._counted(2, 0, 52, None), "cell long, key long, n long")
    assert parts.count() < 200 and math.isclose(selection.exact_quantiles(df, ["a"], [0.5])["", "a"][0], 499.5)

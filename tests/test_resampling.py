import numpy as np
import pytest
from pyspark.sql import functions as F

from textorigin.operators import metrics as M, resampling as R

SCHEMA = "id int, cell string, label int, ai_probability double"


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 700)
    p = np.clip(np.round(0.4 * y + rng.normal(0.3, 0.25, 700), 3), 0, 1)
    rows = [(i, "a" if i % 3 else None, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    rows += [(1000 + i, "one", 1, 0.5) for i in range(5)] + [(2000, "a", None, 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


def by_definition(rows):
    """Metrics of a replicate from its drawn rows, each repeated as often as drawn."""
    y = np.concatenate([[1] * r["pos"] + [0] * r["neg"] for r in rows])
    s = np.concatenate([[r["score"]] * (r["pos"] + r["neg"]) for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    ap = sum(((pos == t).mean()) * (y[s >= t] == 1).mean() for t in set(s))
    tp, fp = (pos >= 0.5).sum(), (neg >= 0.5).sum()
    return wins, ap, 2 * tp / (tp + fp + len(pos))


@pytest.mark.parametrize("block, width", [(65_536, 256), (64, 16)])
def test_replicates_against_definitions(spark, pred, monkeypatch, block, width):
    monkeypatch.setattr(R, "BLOCK", block)
    # slices are cut in the Python workers, which see the module as it is on disk; blocks on the driver
    got = {(r["cell"], r["replicate"]): r for r in R.multinomial_metrics(pred, ["cell"], 20).collect()}
    drawn = {}
    for r in R.multinomial_draws(pred, ["cell"], 20).collect():
        drawn.setdefault((r["cell"], r["replicate"]), []).append(r)
    sizes = {r["cell"]: r["count"] for r in pred.filter("label is not null").groupBy("cell").count().collect()}
    assert len(got) == len(drawn) == 60 and {k[0] for k in got} == {"a", "one", None}
    for key, r in got.items():
        assert r["n"] == sizes[key[0]] == sum(x["pos"] + x["neg"] for x in drawn[key])
        if key[0] == "one":
            assert (r["auroc"], r["auprc"], r["f1"]) == (None, None, 1.0)
        else:
            assert np.allclose([r["auroc"], r["auprc"], r["f1"]], by_definition(drawn[key]), atol=1e-12)
    assert len({r["auroc"] for k, r in got.items() if k[0] == "a"}) > 10


def test_slices_add_up(monkeypatch):
    """The tree's leaves add up to its root, in expectation to the counts, for slices smaller than the block."""
    import pandas as pd

    monkeypatch.setattr(R, "SLICE", 7)
    rng = np.random.default_rng(2)
    scores = pd.DataFrame({"score": np.arange(50) / 50, "pos": rng.integers(0, 9, 50), "neg": rng.integers(0, 9, 50)})
    scores["hat_pos"], scores["hat_neg"] = scores["pos"] // 2, scores["neg"]
    blocks = pd.DataFrame({"_b": [0], "pos": [scores["pos"].sum()], "neg": [scores["neg"].sum()]})
    root = R._roots(3000, 1)(("g",), blocks)
    slices = list(R._slices(1, ("g", 0), scores, root))
    assert len(slices) == 8
    pos, neg = (np.concatenate([s[k] for s in slices], axis=1) for k in (1, 2))
    assert (pos.sum(axis=(1, 2)) == root["pos"].iloc[0]).all() and (neg.sum(axis=(1, 2)) == root["neg"].iloc[0]).all()
    assert (pos.sum(axis=(1, 2)) + neg.sum(axis=(1, 2)) == scores["pos"].sum() + scores["neg"].sum()).all()
    down = scores.sort_values("score", ascending=False)
    assert np.abs(pos[:, :, 0].mean(axis=0) - down["hat_pos"]).max() < 0.3 and np.abs(neg.sum(axis=2).mean(axis=0) - down["neg"]).max() < 0.3
    # a multinomial count varies by about its mean, and two counts are hardly correlated
    assert abs(neg.sum(axis=2).var(axis=0).sum() / down["neg"].sum() - 1) < 0.1


def test_intervals_agree_with_poisson_weights(spark, pred):
    both = pred.filter("label is not null and coalesce(cell, '') <> 'one'")
    a, b = R.multinomial_intervals(both, ["cell"], 400), M.bootstrap_intervals(both, ["cell"], 400)
    assert a.columns == b.columns
    want = {r["cell"]: r for r in b.collect()}
    for r in a.collect():
        for m in ("auroc", "auprc", "f1"):
            width = want[r["cell"]][f"{m}_ci_high"] - want[r["cell"]][f"{m}_ci_low"]
            for side in ("low", "high"):
                assert abs(r[f"{m}_ci_{side}"] - want[r["cell"]][f"{m}_ci_{side}"]) < 0.25 * width


def test_reruns_draw_the_same_and_empty_tables_draw_nothing(spark, pred):
    first, again = (sorted(map(str, R.multinomial_metrics(p, ["cell"], 5).select("cell", "replicate", F.round("auroc", 9)).collect())) for p in (pred, pred.repartition(5, "id")))
    assert first == again
    assert R.multinomial_metrics(pred.limit(0), ["cell"], 5).count() == 0
    assert R.multinomial_metrics(pred, replicates=3).count() == 3

"""Many fits at once: shared fits give what separate ones give, and choices follow the stated order."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from textorigin.operators import models as M
from textorigin.plans import matrix as P

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        x = rng.normal(0, 1, 4) + y * np.array([1.0, 0.5, 0.0, 0.0])
        rows.append((str(i), y, "s" + str(i % 3), ["train", "train", "dev", "test"][i // 3 % 4], *[None if rng.random() < 0.1 else float(v) for v in x]))
    return spark.createDataFrame(rows, "id string, label int, source_dataset string, split string, a double, b double, c double, d double").cache()


def scores(detector, df):
    return {r["id"]: round(r["ai_probability"], 12) for r in detector.score(df).select("id", "ai_probability").collect()}


def test_beginning_of_boosting_is_the_smaller_fit(table):
    training = M.prepared(table.filter("split = 'train'"), COLS)
    jobs = [M.boosting(r, 3, 0.1, 0.7) for r in (3, 7)] + [M.boosting(3, 2, 0.1, 0.7), M.forest(5, 4), M.logistic()]
    together = M.fit_many(training, [(COLS, c) for c in jobs])
    assert [len(d.model.stages[-1].trees) for d in together[:3]] == [3, 7, 3]
    for c, d in zip(jobs, together):
        alone = M.fit_many(training, [(COLS, c)])[0]
        assert scores(alone, table) == scores(d, table), c
    assert isinstance(together[0].model, PipelineModel) and together[0].importance().keys() == set(COLS)


def test_grid_and_families():
    grid = M.tuning_grid()
    assert len(grid) == 84 and [sum(c.name == n for c in grid) for n in ("logistic_regression", "random_forest", "gradient_boosting")] == [4, 72, 8]
    assert len({c.family for c in grid if c.family}) == 4 and {c.size for c in grid if c.family} == {300, 600}


def test_choice():
    rows = {0: {"auprc": 0.5, "auroc": None}, 1: {"auprc": 0.7, "auroc": 0.2}, 2: {"auprc": 0.7, "auroc": 0.3}, 4: {"auprc": 0.7, "auroc": 0.3}}
    assert M.chosen_index(rows, 5, ("auprc", "auroc")) == 2 and M.chosen_index({}, 3, ("auprc",)) == 0 and M.chosen_index({1: {"auprc": None}}, 2, ("auprc",)) == 1


def test_selection_modes_share_one_ranking(table):
    train, dev = table.filter("split = 'train'"), table.filter("split = 'dev'")
    small = [M.logistic(), M.forest(5, 3)]
    mode, cols, found = M.choose_selection(train, dev, ["d"], ["a", "b", "c"], ("all", "top1", "top2", "l1"), small, trees=5)
    rows = {r["selection_mode"]: r for r in found.collect()}
    assert rows["all"]["n_features"] == 4 and rows["top1"]["n_features"] == 2 and rows["top2"]["n_features"] == 3 and mode in rows and "d" in cols
    for m in ("top1", "all"):
        alone = M.fit_select(train, dev, ["d", *M.select_features(train, ["a", "b", "c"], m, 5)], small, M.RANKING_WITH_TPR)[1].first()
        assert rows[m]["auprc"] == pytest.approx(alone["auprc"]) and rows[m]["model"] == alone["model"]


def test_matrix_of_definitions(spark, table):
    one_class = table.withColumn("label", F.when(F.col("source_dataset") == "s2", 1).otherwise(F.col("label")))
    tests = one_class.filter("split = 'test'").withColumn("test_name", F.col("source_dataset"))
    sets = P.train_sets(one_class, ["s0", "s1", "s2"])
    predictions, failed, detectors = P.run(one_class, sets, tests, COLS, [M.logistic(), M.boosting(4), M.forest(4, 3)])
    assert [r["train_name"] for r in failed.collect()] == ["train_s2"] and set(detectors) == set(sets) - {"train_s2"}
    cells = {(r["train_name"], r["test_name"]): r for r in P.matrix(predictions).collect()}
    assert len(cells) == 7 * 3 - 3 or len(cells) == (len(sets) - 1) * 3
    for (name, test), r in cells.items():
        assert r["n_train"] == sets[name][0].count() and r["n_test"] == tests.filter(F.col("test_name") == test).count() and r["n_features"] == 4
    medians = M.column_medians(sets["train_s0"][0], COLS)
    assert detectors["train_s0"].medians == pytest.approx(medians)


def test_column_sets(table):
    train, dev, test = (table.filter(F.col("split") == s) for s in ("train", "dev", "test"))
    got = P.combinations(train, dev, test.withColumn("test_name", F.lit("all")), {"one": ["a"], "two": ["a", "b"]}, [M.logistic(), M.forest(3, 2)])
    assert {(r["feature_set"], r["n_features"], r["n"]) for r in got.collect()} == {("one", 1, test.count()), ("two", 2, test.count())}
    out = M.ablation(train, test, {"x": ["a"], "y": COLS}, [M.logistic()])
    assert {(r["feature_set"], r["feature_count"]) for r in out.collect()} == {("x", 1), ("y", 4)}

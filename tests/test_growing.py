import pytest
from pyspark.sql import functions as F

from textorigin.operators import features as E
from textorigin.plans import growing as G, job, matrix


@pytest.fixture
def counted(spark):
    """A build that keeps the ids it was given."""
    seen = []

    def build(new):
        seen.append(sorted(r["id"] for r in new.select("id").collect()))
        return new.select("id", F.length("text").alias("n"))

    return seen, build


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def values(df):
    return {r["id"]: r["n"] for r in df.collect()}


def test_only_new_and_changed_rows_are_built(spark, tmp_path, counted):
    seen, build = counted
    rows = [(f"d{i:02}", "x" * i) for i in range(30)] + [("null", None), ("empty", "")]
    path = str(tmp_path / "t")
    assert values(G.grown(table(spark, rows), path, build)) == {i: None if t is None else len(t) for i, t in rows}
    files = G._read(spark, path, [0]).inputFiles()
    G.grown(table(spark, rows[::-1]), path, build)
    assert len(seen) == 1 and G._read(spark, path, G.generations(spark, path)).inputFiles() == files
    more = rows + [(f"e{i}", "y") for i in range(10)]
    assert len(values(G.grown(table(spark, more), path, build))) == 42 and seen[1:] == [[f"e{i}" for i in range(10)]]
    changed = [("d03", "longer text"), *[r for r in more if r[0] not in ("d03", "d04")]]
    got = values(G.grown(table(spark, changed), path, build))
    assert seen[2:] == [["d03"]] and got["d03"] == 11 and "d04" not in got and len(got) == 41
    # back to a text that is still there: nothing to build
    assert values(G.grown(table(spark, more), path, build))["d03"] == 3 and len(seen) == 3
    G.grown(table(spark, more), path, build, context="other rules")
    assert len(seen) == 4 and len(seen[3]) == 42


def test_compaction_and_broken_runs(spark, tmp_path, counted):
    seen, build = counted
    path = str(tmp_path / "t")
    for n in range(1, 6):
        assert len(values(G.grown(table(spark, [(str(i), "z" * i) for i in range(n)]), path, build, compact_after=2))) == n
    assert seen == [[str(i)] for i in range(5)] and len(G.generations(spark, path)) <= 2
    before = G.generations(spark, path)
    # a folder that never came into the log is not read, and is written again
    table(spark, [("lost", "w")]).write.parquet(f"{path}/generation={before[-1] + 1}")
    got = values(G.grown(table(spark, [(str(i), "z" * i) for i in range(6)]), path, build))
    assert got == {str(i): i for i in range(6)}
    few = G.grown(table(spark, [("1", "z")]), path, build)
    assert values(few) == {"1": 1} and len(G.generations(spark, path)) == 1


def test_empty_table_and_larger_table(spark, tmp_path, counted):
    seen, build = counted
    path = str(tmp_path / "t")
    assert G.grown(table(spark, []), path, build).count() == 0
    larger = table(spark, [(str(i), "z" * i) for i in range(9)]).select("id", F.length("text").alias("n"))
    assert values(G.grown(table(spark, [("3", "zzz"), ("4", "zzzz")]), path, build, larger=larger)) == {"3": 3, "4": 4} and len(seen) == 1


def test_families_grow_by_ten_documents(spark, tmp_path, monkeypatch):
    built = []
    plain = E.document_features
    monkeypatch.setattr(E, "document_features", lambda new, families, rules: built.append(new.count()) or plain(new, families, rules))
    rows = [(str(i), " ".join(f"w{(i * k) % 13}" for k in range(30)), "train" if i < 15 else "test") for i in range(40)]
    corpus = spark.createDataFrame(rows, "id string, text string, split string")
    out, families = str(tmp_path / "run"), ("struct", "probability", "contrast", "scale")
    job.feature_tables(corpus.filter("cast(id as int) < 30"), out, families)
    grown = job.feature_tables(corpus, out, families)
    fresh = job.feature_tables(corpus, str(tmp_path / "fresh"), families)
    assert built == [30, 10, 40]
    for name in families:
        assert grown[name].columns == fresh[name].columns
        a, b = ({r["id"]: [round(v, 9) if isinstance(v, float) else v for v in r] for r in t[name].collect()} for t in (grown, fresh))
        assert a == b and len(a) == 40
        assert G.generations(spark, f"{out}/features/{name}") == [0, 1]


def test_sequence_families_of_two_models(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(str(i), " ".join(words[(i * j + j // 3) % 6] for j in range(1, 45 if i % 5 else 3)), "train" if i % 3 else "test") for i in range(30)]
    corpus = spark.createDataFrame(rows, "id string, text string, split string")
    families = ("transition", "transition_delta", "dynamics", "multiscale", "global_dynamics")
    tables = job.feature_tables(corpus, str(tmp_path / "run"), families, models=("ng1", "ng2"))
    assert set(tables) == {"transition_ng1", "transition_ng2", "dynamics_ng1", "dynamics_ng2", "global_dynamics_ng1", "global_dynamics_ng2", "transition_delta_ng1_ng2", "multiscale_ng1_ng2"}
    assert {t.count() for t in tables.values()} == {30}
    columns = [c for t in tables.values() for c in t.columns if c != "id"]
    assert len(columns) == len(set(columns))
    one = {k: {r["id"]: r for r in t.collect()} for k, t in tables.items()}
    name = "raw_lossq3_self_transition_rate"
    a, b = (one[f"transition_{m}"]["1"][f"{m}_{name}"] for m in ("ng1", "ng2"))
    assert abs(one["transition_delta_ng1_ng2"]["1"][f"scale_transition_delta_ng1_ng2_{name}"] - (b - a)) < 1e-12
    mse = "deep_dmd_ng2_one_step_latent_prediction_mse"
    assert one["global_dynamics_ng2"]["0"][mse] is None and one["global_dynamics_ng2"]["1"][mse] >= 0


def test_named_sets():
    sets = matrix.named_sets(["f1", "f2"], "s", "l", {"s": ["ts"], "l": ["tl"]}, ["d"], {"s": ["ks"], "l": ["kl"]}, ["m"], ["p"])
    assert len(sets) == 15 and all(len(c) == len(set(c)) for c in sets.values())
    assert sets["full_plus_transition_plus_dynamics"] == ["f1", "f2", "ts", "tl", "ks", "kl", "m"] and sets["dynamics_both_multiscale"] == ["ks", "kl", "m"]

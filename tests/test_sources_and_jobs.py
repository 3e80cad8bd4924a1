import json

import pytest
from pyspark.sql import functions as F

from textorigin.operators import corpus as C, features as E, models as M, surprise as L
from textorigin.plans import job, scoring
from textorigin.sources import losses as SL, readers as R, sinks
from textorigin.streaming import incremental as T

WORDS = "the river was cold and we walked along it for hours talking about nothing".split()


def text(i):
    return " ".join(WORDS[(i * 7 + k * (1 + i % 5)) % len(WORDS)] + ("." if k % 9 == 8 else "") for k in range(30 + i % 40))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(str(i), text(i) if i % 2 else text(i) + " It is worth noting that this clearly works, really, truly." * 2, i % 2, "s" + str(i % 3), f"d{i % 4}") for i in range(150)]
    df = spark.createDataFrame(rows, "id string, text string, label int, source_dataset string, domain string")
    split = F.when(F.col("id").cast("int") % 10 < 7, "train").when(F.col("id").cast("int") % 10 < 8, "dev").otherwise("test")
    return df.withColumn("split", split).cache()


def test_readers_of_all_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,label\n1,"two\nlines, one ""cell""",1\n2,,0\n3,plain,x\n')
    (tmp_path / "b.tsv").write_text("id\ttext\n1\ttab\n")
    (tmp_path / "c.jsonl").write_text('{"text": "x"}\n{"text": "y"}\n')
    (tmp_path / "d.json").write_text('[{"text": "x"}, {"text": "y"}]')
    (tmp_path / "e.txt").write_text("one\ntwo")
    docs = {r["id"]: r for r in R.read_documents(spark, str(tmp_path / "a.csv")).collect()}
    assert docs["1"]["text"] == 'two\nlines, one "cell"' and docs["3"]["label"] == 0 and set(docs) == {"1", "3"}
    assert [R.read_table(spark, str(tmp_path / f)).count() for f in ("b.tsv", "c.jsonl", "d.json", "e.txt")] == [1, 2, 2, 1]


def test_corpus_loading(spark, tmp_path):
    m4 = tmp_path / "m4"
    m4.mkdir()
    lines = [json.dumps({"human_text": f"h {i}", "machine_text": f"m {i}", "source_id": i, "model": "davinci", "Domain": "Reddit"}) for i in range(12)]
    (m4 / "reddit_chats.jsonl").write_text("\n".join([*lines, "not json"]))
    (m4 / "other.jsonl").write_text(lines[0])
    rules = R.CORPORA["m4"]
    assert [r[0].rsplit("/", 1)[1] for r in R.discover_files(spark, str(m4), rules).collect()] == ["reddit_chats.jsonl"]
    rows = R.load_corpus(spark, str(m4), rules).collect()
    assert len(rows) == 24 and {r["generator"] for r in rows} == {"human", "davinci"} and {r["domain"] for r in rows} == {"reddit"} and {r["split"] for r in rows} <= {"train", "dev", "test"}
    assert R.sample_per_file(R.read_records(spark, str(m4), rules), 5).count() == 5
    raid = tmp_path / "raid"
    raid.mkdir()
    (raid / "x.csv").write_text("Generation,model,attack\nsome text,gpt4,paraphrase\nmore text,human,none\n")
    got = {r["text"]: r for r in R.load_corpus(spark, str(raid), R.CORPORA["raid"]).collect()}
    assert got["some text"]["label"] == 1 and got["some text"]["attack_type"] == "paraphrase" and got["more text"]["label"] == 0 and {r["split"] for r in got.values()} <= {"external_test", "test"}


def test_external_json(spark, tmp_path):
    items = [{"content": " one ", "is_ai": True, "model": "x"}, {"text": ""}, {"response": "one"}, {"input": "two", "class": "real", "category": None}]
    for i, doc in enumerate((items, {"data": items})):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps(doc, indent=1))
        rows = sorted(R.read_external(spark, str(p)).collect(), key=lambda r: r["id"])
        assert [(r["id"][-6:], r["text"], r["label"], r["domain"]) for r in rows] == [("000000", "one", 1, "unknown"), ("000003", "two", 0, "unknown")]


def test_loss_cache_resume(spark, corpus, tmp_path):
    losses = L.GramModel.fit(corpus).losses(corpus)
    records = L.loss_records(losses.select("id", "ng2"), corpus)
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        assert SL.pending(corpus, spark, path, "ng2", "d", fmt).count() == 150
        SL.write_losses(records.filter("cast(id as int) < 100"), path, "d", fmt)
        assert SL.pending(corpus, spark, path, "ng2", "d", fmt).count() == 50
        back = {r["id"]: r["loss_sequence"] for r in SL.read_losses(spark, path, fmt).collect()}
        assert back["7"] == losses.filter("id = '7'").first()["ng2"]
    text_form = losses.select("id", F.to_json("ng2").alias("q_losses_json"))
    assert SL.sequence_columns(text_form) == ["q_losses_json"]
    assert SL.profiles_of_columns(text_form, ["q_losses_json"], with_gap=False).filter("q_lossq_token_count is not null").count() == 150


def test_sinks(spark, corpus, tmp_path):
    sinks.write_document(spark, {"b": 1, "a": "ü"}, str(tmp_path / "doc"))
    assert sinks.read_document(spark, str(tmp_path / "doc")) == {"a": "ü", "b": 1}
    sinks.write_table(corpus, str(tmp_path / "csv"), "csv")
    assert R.read_table(spark, str(tmp_path / "csv"), "csv").count() == 150
    m = sinks.split_manifest(corpus)
    assert m["leaking_id_count"] == 0 and sum(v["0"] + v["1"] for v in m["labels_by_split"].values()) == 150


def test_feature_table_joins(spark):
    a = spark.createDataFrame([("1", 1.0), ("2", None), ("3", float("inf"))], "id string, f double")
    b = spark.createDataFrame([("1", 9.0, 5.0), ("4", 4.0, 2.0)], "id string, f double, g double")
    assert {r["id"]: (r["f"], r["g"]) for r in E.first_match([a, b]).collect()}["1"] == (1.0, None)
    assert {r["id"]: r["f"] for r in E.first_match([a, b], last_wins=True).collect()}["1"] == 9.0
    with pytest.raises(ValueError):
        E.join_one_to_one(a, b.unionByName(b))
    kept, info = E.clean_columns(E.column_audit(a.withColumn("k", F.lit(1.0)).withColumn("n", F.lit(None).cast("double")), ["f", "k", "n"]), ["f", "k", "n"], "ignore")
    assert info["dropped_constant"] == ["f", "k"] and info["dropped_all_nan"] == ["n"] and kept == []
    assert [r["f"] for r in E.imputed(a, ["f"], {"f": 7.0}).orderBy("id").collect()] == [1.0, 7.0, 7.0]


def test_detector_round_trip_and_scoring(spark, corpus, tmp_path):
    features = corpus.drop("text").join(E.document_features(corpus, ["burst", "struct"]), "id").cache()
    cols, _ = E.clean_columns(E.column_audit(features, E.numeric_features(features)), E.numeric_features(features))
    train, dev = features.filter("split = 'train'"), features.filter("split = 'dev'")
    best, table = M.fit_select(train, dev, cols, [M.logistic(), M.forest(5, 4)])
    assert table.count() == 2 and table.first()["model"] == best.name
    best.save(spark, str(tmp_path / "ckpt"))
    again = M.Detector.load(spark, str(tmp_path / "ckpt"))
    key = lambda df: {r["id"]: round(r["ai_probability"], 9) for r in df.collect()}
    assert key(best.score(features)) == key(again.score(features))
    answers = {r["id"]: r for r in scoring.score_texts(again, corpus).collect()}
    assert set(answers) == {str(i) for i in range(150)} and {r["answer"] for r in answers.values()} <= {"Yes", "No"}
    assert all(0 <= r["ai_probability"] <= 1 and 1 <= len(r["top_evidence"]) <= 5 for r in answers.values())
    unlabelled = features.withColumn("label", F.when(F.col("id") < "5", F.col("label")))
    scored, metrics = scoring.evaluate_external(again, unlabelled)
    assert scored.count() == 150 and metrics.first()["n"] == unlabelled.filter("label is not null").count()


def test_whole_run_isolates_bad_definitions(spark, corpus, tmp_path):
    one_class = corpus.withColumn("label", F.when(F.col("source_dataset") == "s0", 1).otherwise(F.col("label")))
    out = str(tmp_path / "run")
    results = job.run(one_class, out, ["burst"], [M.logistic()], replicates=5)
    assert [r["train_name"] for r in results["failures"].collect()] == ["train_s0"]
    cells = results["matrix"]
    assert cells.count() == 7 * 3 and cells.filter("auroc < 0 or auroc > 1").isEmpty()
    before = spark.read.parquet(f"{out}/features/burst").inputFiles()
    job.feature_tables(one_class, out, ["burst"])
    assert spark.read.parquet(f"{out}/features/burst").inputFiles() == before


def test_stream_equals_batch_and_repeats_nothing(spark, corpus, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    corpus.filter("cast(id as int) < 60").select("id", "text").coalesce(1).write.mode("append").parquet(src)
    run = lambda: T.incremental_features(T.document_stream(spark, src), out, state, ["burst"]).awaitTermination()
    run()
    corpus.filter("cast(id as int) >= 40").select("id", "text").coalesce(1).write.mode("append").parquet(src)
    run()
    stream = {r["id"]: r["burst_zipf_deviation_score"] for r in spark.read.parquet(out).collect()}
    batch = {r["id"]: r["burst_zipf_deviation_score"] for r in E.document_features(corpus, ["burst"]).collect()}
    assert stream == batch and spark.read.parquet(out).count() == 150
    features = corpus.select("id", "label").join(E.document_features(corpus, ["burst"], compression=False), "id")
    detector = M.fit(features, ["burst_word_count", "burst_type_token_ratio"], M.logistic())
    T.stream_scores(T.document_stream(spark, src), detector, str(tmp_path / "scores"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 170


def test_external_ids_beyond_a_million(spark):
    fields = F.create_map(F.lit("text"), F.concat(F.lit("text number "), F.col("id").cast("string")))
    records = spark.range(1_000_000, 1_000_020).select(F.col("id").alias("position"), fields.alias("fields"))
    rows = R.external_rows(records).collect()
    assert len({r["id"] for r in rows}) == len(rows) == 20


def test_external_folder_counts_on(spark, tmp_path):
    for name, texts in (("a", ["one", "two"]), ("b", ["three"])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"text": t} for t in texts]))
    rows = R.read_external(spark, str(tmp_path)).collect()
    assert sorted((r["id"][-2:], r["text"]) for r in rows) == [("00", "one"), ("01", "two"), ("02", "three")]


def test_equal_records_end_as_one_row(spark):
    text = "word " * 60
    fields = [{"text": text, "label": "1"}] * 3 + [{"text": "other " * 60, "label": "0"}]
    rows = R.generic_rows(spark.createDataFrame([("/c/x.jsonl", f) for f in fields], f"path string, fields {R.FIELDS}"), "c")
    assert C.removal_reasons(rows, "id").filter("reason = 'duplicate'").count() == 2
    assert C.clean_corpus(rows, "id").count() == 2
    assert C.keep_first(rows, ["text"], "id").count() == 2


def test_all_rows_of_a_corpus_stay(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"text": f"text {i}", "label": str(i % 2)}) + "\n" for i in range(1_500)))
    rules = R.CorpusRules("big")
    assert R.load_corpus(spark, str(tmp_path), rules).count() == 1_500
    assert R.load_corpus(spark, str(tmp_path), rules, max_per_group=100).count() < 1_500


def test_row_cap_adds_up(spark):
    rows = [(str(i), 0 if i < 3 else i % 2 + 1) for i in range(200)]
    capped = C.row_cap(spark.createDataFrame(rows, "id string, label int"), 50)
    assert capped.count() == 50 and {r["label"] for r in capped.select("label").distinct().collect()} == {0, 1, 2}


def test_new_split_rebuilds_losses(spark, tmp_path):
    rows = [(str(i), " ".join(f"w{(i * k) % 13}" for k in range(30)), i % 2, "train" if i < 15 else "test") for i in range(30)]
    corpus = spark.createDataFrame(rows, "id string, text string, label int, split string")
    tables = lambda df: job.feature_tables(df, str(tmp_path / "run"), ("probability",))["probability"].agg(F.sum("ng2_loss_mean")).first()[0]
    first = tables(corpus)
    again = tables(corpus)
    other = tables(corpus.withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train")))
    assert first == again and other != first

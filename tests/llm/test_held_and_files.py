"""What stays in a worker between operators, and in how many files small tables are written."""

from pathlib import Path

import pytest

from textorigin.llm import compression, decontamination, graph, held, minhash, queries, tokens
from textorigin.session import cut_lineage, scratch_mark, scratch_since


@pytest.fixture
def many_partitions(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def files(path):
    return len(list(Path(path).glob("part-*")))


def test_a_worker_keeps_things_of_one_operator():
    automata = held.only("decontamination").setdefault("automata", {})
    assert held.only("decontamination")["automata"] is automata
    assert held.only("tokens") == {} and held.only("decontamination") == {}


def test_operators_let_go_what_others_kept(spark, documents, sf):
    """Each operator's own tasks, one after the other in the same workers: only the last one's things are left."""
    few = documents.limit(40).coalesce(1).cache()

    def left(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([",".join(sorted(held._held))])], ["names"])

    names = lambda: {r.names for r in few.select("doc_id").mapInArrow(left, "names string").collect()}
    tokens.tokens(few.select("doc_id", "text"), queries.tokenizer_path(), 1).collect()
    minhash.op3(few).collect()
    assert "tokens" not in ",".join(names())
    decontamination.op1(few, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    compression.score(few, compression.Model(b"", b"", (0.0,) * 5, (1.0,) * 5, (0.0,) * 6)).collect()
    assert "decontamination" not in ",".join(names())
    few.unpersist()


def test_small_tables_go_to_few_files(spark, many_partitions):
    rows = spark.range(500).repartition(60, "id")
    most = spark.sparkContext.defaultParallelism
    mark = scratch_mark()
    assert sorted(r.id for r in cut_lineage(rows, 500).collect()) == list(range(500))
    assert cut_lineage(rows, 500, per_file=10).count() == 500
    few, more = map(files, scratch_since(mark))
    assert few <= most < more <= 50


def test_components_write_few_files(spark, many_partitions):
    mark = scratch_mark()
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 300)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(101)} | {i: 200 for i in range(200, 300)}
    assert max(map(files, scratch_since(mark))) <= spark.sparkContext.defaultParallelism
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

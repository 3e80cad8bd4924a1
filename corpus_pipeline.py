"""From documents to token files: quality, near-duplicates, benchmark passages, source mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textorigin.llm import compression, decontamination, minhash, mixing, tokens
from textorigin.llm.queries import splits, table, tokenizer_path
from textorigin.session import cut_lineage, drop_scratch, scratch_mark, scratch_since


def _own(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names of its own, so that no column can clash with what an operator adds; and the names."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*names.values()).toDF(*names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = compression.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), train=~compression.held_out("doc_id"))
    own, names = _own(docs)
    return _back(compression.score(own, model, text=names["text"]).filter("predicted = 1"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): that with the smallest id, null last."""
    own, names = _own(docs)
    # tells rows apart whatever their ids; written once, so it stays
    keyed = cut_lineage(own.withColumn("key", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(keyed, doc_id="key", text=names["text"]).select(F.col("doc_id").alias("key"), "component_id")
    id_ = F.col(names["doc_id"]).cast("long")
    order = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(F.col(names["text"]).cast("string")).alias("hash"), "key")
    rows = cut_lineage(found.join(keyed.select("key", order.alias("of")), "key"), keyed.count())
    first = rows.groupBy("component_id").agg(F.min("of").alias("of")).select(F.col("of.key").alias("key"))
    drop = rows.select("key").join(first, "key", "left_anti")
    return _back(keyed.join(drop, "key", "left_anti"), names)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    own, names = _own(docs)
    found = decontamination.decontaminate(own, table(spark, sf_dir, "benchmark"), text=names["text"], keep=list(names.values()))
    return _back(found.filter("n_hit = 0"), names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    own, names = _own(docs)
    return _back(mixing.mixed_documents(own, names["doc_id"], names["text"], names["source"]), names)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what reading them back gives per document."""
    return tokens.tokens(docs.select("doc_id", "text"), tokenizer_path(), splits(spark))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mixed),
    ("token output", token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        mark = scratch_mark()
        docs = cut_lineage(stage(spark, docs, sf_dir))
        # the stage is written, so nothing reads its intermediate tables or the stage before any more
        *done, _ = scratch_since(mark)
        drop_scratch(spark, done)
    return docs

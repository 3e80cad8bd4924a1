"""Corpus files of many shapes read into the unified corpus.

A record of any format becomes a map of its fields, so synonyms are resolved per record in one pass and no
schema is inferred from the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import categories as K
from ..functions.columns import strip_space
from ..functions.fixed_values import (
    ATTACK_SYNONYMS, CORPUS_COLUMNS, DOMAIN_SYNONYMS, EXTERNAL_DOMAIN, EXTERNAL_GENERATOR, EXTERNAL_LABEL, EXTERNAL_TEXT,
    GENERATOR_SYNONYMS, LABEL_SYNONYMS, SPLIT_SYNONYMS, TEXT_SYNONYMS,
)
from ..operators.corpus import cap_groups, default_split, document_table, keep_first
from ..operators.ranking import hash_rank

FORMATS = ("csv", "tsv", "jsonl", "json", "parquet", "txt")
FIELDS = "map<string,string>"


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One file or folder of a format; a text file is one row."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    reader = spark.read.option("recursiveFileLookup", True)
    if fmt in ("csv", "tsv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "txt":
        return reader.text(path, wholetext=True).withColumnRenamed("value", "text")
    raise ValueError(f"unsupported format {fmt!r}")


def read_documents(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The six-column document table: columns completed, text cleaned, empty rows dropped."""
    return document_table(read_table(spark, path, fmt))


@dataclass(frozen=True)
class CorpusRules:
    """Where a corpus lives and what is special about it."""

    name: str
    formats: Sequence[str] = ("csv", "tsv", "jsonl", "json", "parquet")
    any_of: Sequence[str] = ()
    none_of: Sequence[str] = ()
    paired: bool = False
    held_out: bool = False
    domain_for_unknown: str | None = None
    machine_names: Sequence[str] = field(default_factory=tuple)
    attack: str | None = None


# The known public corpora.
CORPORA = {
    "ghostbuster": CorpusRules("ghostbuster", formats=FORMATS, none_of=("logprobs",)),
    "m4": CorpusRules("m4", any_of=("arxiv_", "peerread_", "reddit_", "wikihow_", "wikipedia_"), paired=True),
    "raid": CorpusRules("raid", held_out=True),
    "hc3_plus": CorpusRules("hc3_plus", any_of=("/data/en/",), domain_for_unknown="qa", machine_names=("chatgpt", "gpt3.5", "gpt4"), attack="none"),
}


def _allowed(path: Column, rules: CorpusRules) -> Column:
    p = F.lower(path)
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    ok = F.lit(True)
    if rules.any_of:
        hits = [(p if "/" in w else name).contains(w) for w in rules.any_of]
        anyhit = hits[0]
        for h in hits[1:]:
            anyhit = anyhit | h
        ok = ok & anyhit
    for w in rules.none_of:
        ok = ok & ~p.contains(w)
    return ok


def discover_files(spark: SparkSession, root: str, rules: CorpusRules) -> DataFrame:
    """Paths below ``root`` that belong to the corpus; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(extension.isin(*rules.formats) & _allowed(F.col("path"), rules)).distinct()


def _field_map(df: DataFrame) -> Column:
    return F.create_map(*[x for c in df.columns if not c.startswith("_") for x in (F.lit(c), F.col(c).cast("string"))])


def read_records(spark: SparkSession, root: str, rules: CorpusRules, multi_line: bool = True) -> DataFrame:
    """(path, fields) for every record of the corpus; lines that are not JSON objects are skipped.

    Large corpora belong in parquet, jsonl, or csv without line ends in fields (``multi_line=False``): those files are split among
    tasks. A json or txt file, and a csv file with line ends in fields, is read by one task.
    """
    out = None
    for fmt in rules.formats:
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}")
        # formats with a schema cannot be read where there is no file; every other problem is the caller's to see
        if reader.format("binaryFile").load(root).select("path").limit(1).isEmpty():
            continue
        path = F.col("_metadata.file_path").alias("path")
        if fmt == "jsonl":
            lines = reader.text(root).select(path, "value")
            one = lines.select("path", F.from_json("value", FIELDS).alias("fields"))
        elif fmt == "json":
            whole = reader.text(root, wholetext=True).select(path, "value")
            one = whole.select("path", F.explode(json_list(F.col("value"))).alias("fields"))
        elif fmt == "txt":
            one = reader.text(root, wholetext=True).select(path, F.create_map(F.lit("text"), F.col("value")).alias("fields"))
        elif fmt == "parquet":
            table = reader.parquet(root)
            one = table.select(path, _field_map(table).alias("fields"))
        else:
            table = reader.option("header", True).option("multiLine", multi_line).option("escape", '"').option("sep", "\t" if fmt == "tsv" else ",").csv(root)
            one = table.select(path, _field_map(table).alias("fields"))
        one = one.filter(F.col("fields").isNotNull() & _allowed(F.col("path"), rules))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"path string, fields {FIELDS}")


def json_list(value: Column) -> Column:
    """The records of a JSON text that is a list or an object with a ``data`` list."""
    as_list = F.from_json(F.when(F.ltrim(value).startswith("["), value), f"array<{FIELDS}>")
    return F.coalesce(as_list, F.from_json(F.get_json_object(value, "$.data"), f"array<{FIELDS}>"))


def field_value(fields: Column, synonyms: Sequence[str]) -> Column:
    """Value of the first synonym the record has, whatever the case of its name."""
    entries = F.map_entries(fields)
    named = lambda s: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == s), F.lit(0))["value"]
    return F.coalesce(*[named(s) for s in synonyms])


def sample_per_file(records: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` records per file in seeded hash order, however large one file is."""
    keyed = records.withColumn("_key", F.md5(F.to_json(F.sort_array(F.map_entries("fields"))).cast("binary")))
    return hash_rank(keyed, ["path"], "_key", seed).filter(F.col("rank") <= limit).select("path", "fields")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _record_key() -> Column:
    """Stable record number: a hash of the record, so no file has to be numbered in order."""
    return F.substring(F.md5(F.to_json(F.sort_array(F.map_entries("fields"))).cast("binary")), 1, 16)


def paired_rows(records: DataFrame, name: str) -> DataFrame:
    """A record with a human and a machine text becomes two labelled rows."""
    get = lambda *s: field_value(F.col("fields"), s)
    path, stem = F.col("path"), _stem(F.col("path"))
    domain = K.domain(F.coalesce(field_value(F.col("fields"), DOMAIN_SYNONYMS), K.domain_from_path(path)))
    who = K.generator(F.coalesce(field_value(F.col("fields"), GENERATOR_SYNONYMS), stem), F.lit(1))
    key = F.concat(F.lit(f"{name}_"), stem, F.lit("_"), F.coalesce(strip_space(get("source_id")), _record_key()))
    sides = F.explode(F.array(
        F.struct(F.lit("_human").alias("end"), get("human_text").alias("text"), F.lit(0).alias("label"), F.lit("human").alias("generator")),
        F.struct(F.lit("_machine").alias("end"), get("machine_text").alias("text"), F.lit(1).alias("label"), who.alias("generator"))))
    rows = records.select(key.alias("k"), domain.alias("domain"), K.split(field_value(F.col("fields"), SPLIT_SYNONYMS)).alias("split"), sides.alias("s"))
    return rows.select(
        F.concat("k", "s.end").alias("id"), F.coalesce("s.text", F.lit("")).alias("text"), "s.label", F.lit(name).alias("source_dataset"),
        F.lit("en").alias("language"), "domain", "s.generator", F.lit("none").alias("attack_type"), "split")


def generic_rows(records: DataFrame, name: str, attack_hint: bool = False) -> DataFrame:
    """Any record with a text field becomes one row; metadata from synonyms, else from the path."""
    f, path = F.col("fields"), F.col("path")
    get = lambda synonyms: field_value(f, synonyms)
    label = K.label(get(LABEL_SYNONYMS), get(GENERATOR_SYNONYMS), path)
    domain = K.domain(F.coalesce(get(DOMAIN_SYNONYMS), K.domain_from_path(path)))
    rows = records.filter(get(TEXT_SYNONYMS).isNotNull()).select(
        F.concat(F.lit(f"{name}_"), _stem(path), F.lit("_"), _record_key()).alias("id"), get(TEXT_SYNONYMS).alias("text"), label.alias("label"),
        F.lit(name).alias("source_dataset"), F.lit("en").alias("language"), domain.alias("domain"),
        K.generator(F.coalesce(get(GENERATOR_SYNONYMS), K.generator_from_path(path, label)), F.coalesce(label, F.lit(1))).alias("generator"),
        K.attack(F.coalesce(get(ATTACK_SYNONYMS), _parent(path))).alias("attack_type"),
        F.coalesce(K.split(get(SPLIT_SYNONYMS)), K.split_from_path(path)).alias("split"), F.lower(path).alias("_path"))
    if attack_hint:
        hinted = (F.col("attack_type") == "none") & F.col("_path").contains("attack")
        rows = rows.withColumn("attack_type", F.when(hinted, F.lit("unknown")).otherwise(F.col("attack_type")))
    return rows.select(*CORPUS_COLUMNS)


def load_corpus(spark: SparkSession, root: str, rules: CorpusRules, max_per_group: int | None = None, seed: int = 42, multi_line: bool = True) -> DataFrame:
    """Read a corpus and give every row a split. All rows stay, unless ``max_per_group`` asks for at most so many rows per file of
    pairs, and per group."""
    records = read_records(spark, root, rules, multi_line)
    if rules.paired:
        rows = paired_rows(records if max_per_group is None else sample_per_file(records, max_per_group, seed), rules.name)
    else:
        rows = generic_rows(records, rules.name, rules.held_out)
    if rules.domain_for_unknown:
        rows = rows.withColumn("domain", F.when(F.col("domain") == "unknown", rules.domain_for_unknown).otherwise(F.col("domain")))
    if rules.machine_names:
        known = F.when(F.col("label") == 0, "human").when(F.col("generator").isin(*rules.machine_names), "chatgpt").otherwise("unknown_ai")
        rows = rows.withColumn("generator", known)
    if rules.attack:
        rows = rows.withColumn("attack_type", F.lit(rules.attack))
    placed = default_split(rows, held_out=(rules.name,) if rules.held_out else ())
    return (placed if max_per_group is None else cap_groups(placed, max_per_group, seed=seed)).select(*CORPUS_COLUMNS)


def external_rows(records: DataFrame, name: str = "external_all_samples") -> DataFrame:
    """(position, fields) records of an unlabelled or labelled external set as corpus rows, texts not empty, first copy kept."""
    get = lambda synonyms: field_value(F.col("fields"), synonyms)
    plain = lambda c: F.coalesce(F.nullif(strip_space(c), F.lit("")), F.lit("unknown"))
    rows = records.select(
        F.concat(F.lit(f"{name}_"), F.format_string("%012d", F.col("position").cast("long"))).alias("id"),
        strip_space(F.coalesce(get(EXTERNAL_TEXT), F.lit(""))).alias("text"), K.external_label(get(EXTERNAL_LABEL)).alias("label"),
        F.lit(name).alias("source_dataset"), F.lit("en").alias("language"), plain(get(EXTERNAL_DOMAIN)).alias("domain"),
        plain(get(EXTERNAL_GENERATOR)).alias("generator"), F.lit("unknown").alias("attack_type"), F.lit("external_test").alias("split"),
    ).filter(F.col("text") != "")
    return keep_first(rows.withColumn("_key", F.unhex(F.sha2("text", 256))), ["_key"], "id").drop("_key")


def read_external(spark: SparkSession, path: str, name: str = "external_all_samples") -> DataFrame:
    """An external JSON file: a list, or an object with a ``data`` list."""
    records = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(json_list(F.col("value"))).alias("at", "fields"))
    # in a folder the positions go on from file to file: one number per file, of its records
    sizes = records.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return external_rows(records.join(before, "path").select((F.col("before") + F.col("at")).alias("position"), "fields"), name)

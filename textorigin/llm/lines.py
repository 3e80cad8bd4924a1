"""Substring dedup by hashed lines and sentences: the earliest occurrence stays, long runs of later ones go, with their places in the original."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .hot import join_counted

SPAN = "array<struct<begin:int,end:int>>"
WHITE = r"\x20\x09-\x0D"
#: what a unit is, each from a character that is no white space on; a sentence ends at a line's end or behind a mark that white space follows
UNITS = {
    "sentence": rf"[^{WHITE}](?:[^.!?\n]+|[.!?]+[^{WHITE}.!?])*[.!?]*",
    "line": rf"[^{WHITE}][^\n]*",
    "paragraph": rf"[^{WHITE}](?:[^\n]+|\n[^\n])*",
}
#: words that neighbouring repeated units must have together to be removed
RUN_WORDS = 25


def _units(unit: str):
    find = re.compile(UNITS[unit]).finditer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                own, number, start, begin, end, words, digest = [], [], [], [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    at = 0
                    for k, m in enumerate(find(text or "")):
                        found = m.group().encode("utf-8", "surrogatepass").lower().split()
                        own.append(i)
                        number.append(k)
                        start.append(at)
                        begin.append(m.start())
                        end.append(at := m.end())
                        words.append(len(found))
                        digest.append(hashlib.md5(b" ".join(found)).digest())
                rows = pa.array(own, pa.int32())
                yield pa.record_batch(
                    [part.column(0).take(rows), part.column(1).take(rows), *(pa.array(x, pa.int32()) for x in (number, start, begin, end, words)), pa.array(digest, pa.binary())],
                    ["doc_id", "text_hash", "number", "start", "begin", "end", "words", "digest"],
                )

    return run


def _runs(units: list[dict], least: int) -> list[dict]:
    """Of a text's repeated units those in a run of neighbours with at least ``least`` words."""
    out: list[dict] = []
    run: list[dict] = []
    for u in [*units, None]:
        if run and (u is None or u["number"] != run[-1]["number"] + 1):
            if sum(x["words"] for x in run) >= least:
                out += run
            run = []
        if u is not None:
            run.append(u)
    return out


def _without(names: list[str], least: int):
    """Cut the runs out of the text, each unit with the white space before it."""

    def cut(text: str, spans: list[dict]) -> str:
        kept, at = [], 0
        for s in spans:
            kept.append(text[at : s["start"]])
            at = s["end"]
        return "".join(kept) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("_text")
        for batch in batches:
            spans = [_runs(x, least) for x in batch.column(len(names)).to_pylist()]
            done = [t if not s or t is None else cut(t, s) for t, s in zip(batch.column(at).to_pylist(), spans)]
            places = [[{"begin": u["begin"], "end": u["end"]} for u in x] for x in spans]
            removed = pa.array(places, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            yield pa.record_batch([*batch.columns[:at], pa.array(done, pa.string()), *batch.columns[at + 1 : len(names)], removed], [*names, "removed"])

    return run


def remove_repeats(docs: DataFrame, unit: str = "sentence", run_words: int = RUN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated units cut out of ``text``, and ``removed``: their begins and ends in characters of the original text.

    Units (:data:`UNITS`) are sentences within lines, whole lines, or paragraphs. They are equal if their bytes are after lower-casing A-Z and
    joining their words by one blank. Of equal units the earliest stays: the smallest doc_id (null last), then the earliest
    place. The others are removed where a run of neighbouring repeated units has ``run_words`` words or more; so a long passage goes although it
    begins or ends inside a line, and a short common line stays (1 removes every repeated unit). A unit goes with the white space before it. Rows with the same
    id and text count as one document and get the same result. A null text stays null, and it, an empty text and an empty table have no
    units. Other columns, also those named like the helper columns here, come back unchanged; ``removed`` is replaced.

    Digests are counted with a map-side combine. A digest with more than a thousandth of all repeated units finds its first place by
    a broadcast of at most a thousand rows, so no common unit ends in one task; the others meet it in a shuffle.
    """
    docs = docs.drop("removed")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    units = cut_lineage(named.mapInArrow(_units(unit), "doc_id long, text_hash long, number int, start int, begin int, end int, words int, digest binary"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "begin")
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("rows"))
    first = first.filter(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first", "rows")
    later = join_counted(units.withColumn("place", place), first, ["digest"]).filter(~F.col("place").eqNullSafe(F.col("first")))
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_hash")]
    again = F.sort_array(F.collect_set(F.struct("number", "start", "begin", "end", "words"))).alias("_again")
    repeated = later.select(*key, "number", "start", "begin", "end", "words").groupBy("_id", "_none", "_hash").agg(again)
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, own = F.col(names[docs.columns.index(doc_id)]).cast("long"), F.col(names[docs.columns.index(text)])
    plain = docs.toDF(*names).withColumns({"_id": F.coalesce(id_, F.lit(0)), "_none": id_.isNull(), "_hash": F.xxhash64(own.cast("string"))})
    joined = plain.join(repeated, ["_id", "_none", "_hash"], "left")
    order = [n if n != names[docs.columns.index(text)] else "_text" for n in names]
    empty = F.array().cast("array<struct<number:int,start:int,begin:int,end:int,words:int>>")
    given = joined.withColumn("_text", own.cast("string")).select(*order, F.coalesce("_again", empty).alias("_again"))
    fields = [T.StructField(f.name, f.dataType, True) for f in given.schema.fields[:-1]]
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return given.mapInArrow(_without(order, run_words), T.StructType([*fields, T.StructField("removed", span)])).toDF(*docs.columns, "removed")


def op9(docs: DataFrame) -> DataFrame:
    """The cut text of every document, and its removed places as text (begin-end, comma-joined)."""
    out = remove_repeats(docs.select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select(
        "doc_id", "text", F.size("removed").cast("long").alias("n_removed"), size.alias("removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",").alias("removed"),
    )

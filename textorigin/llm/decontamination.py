"""Benchmark decontamination with one Aho-Corasick automaton over all windows of the benchmark."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from . import held, words as W

WINDOW = 10
#: windows in one automaton: about 100 MB of nodes
BLOCK_WINDOWS = 40_000
#: bytes of normalised windows that one pass broadcasts; a larger benchmark takes more passes over the text
PASS_BYTES = 64 << 20
#: automata a worker keeps between batches
KEPT_AUTOMATA = 4

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:256] = True
#: lower case for A-Z, a blank for every other ASCII character outside words; one byte for one byte, so offsets stay
_FOLD = bytes(W.LOWER[b] if _IN_WORD[b] else 32 for b in range(256))


def _normal(text: bytes) -> tuple[int, str]:
    """The number of words, and the words between blanks."""
    found = text.translate(_FOLD).split()
    return len(found), (b" " + b" ".join(found) + b" ").decode("latin-1") if found else ""


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size, names = [], [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            found = (text or b"").translate(_FOLD).split()
            for i in range(max(1, len(found) - WINDOW + 1) if found else 0):
                part = found[i : i + WINDOW]
                out.append(b" " + b" ".join(part) + b" ")
                size.append(len(part))
                names.append(name)
        yield pa.record_batch([pa.array(out, pa.binary()), pa.array(size, pa.int32()), pa.array(names, pa.string())], ["window", "size", "item"])


def _automaton(block: str, patterns: list) -> ahocorasick.Automaton:
    built = held.only("decontamination").setdefault("automata", OrderedDict())
    if block not in built:
        while len(built) >= KEPT_AUTOMATA:
            built.popitem(last=False)
        made = ahocorasick.Automaton()
        for window, size, items in patterns:
            made.add_word(window.decode("latin-1"), (size, items))
        made.make_automaton()
        built[block] = made
    built.move_to_end(block)
    return built[block]


def _character(raw: bytes, places: list[int]) -> list[int]:
    """Byte places as places in characters."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.searchsorted(starts, places).tolist()


def _scan(shared, text_at: int, schema: pa.Schema):
    """For each batch: add what the windows of this pass hit to what earlier passes found."""

    def run(batches):
        for batch in batches:
            state = {n: batch.column(batch.schema.names.index(n)).to_pylist() for n in ("_hits", "_items")}
            raw = batch.column(text_at).cast(pa.large_binary()).to_pylist()
            normal = [_normal(x or b"") for x in raw]
            hits: dict[int, list] = {i: [tuple(h.values()) for h in x] for i, x in enumerate(state["_hits"]) if x}
            items: dict[int, set] = {i: set(x) for i, x in enumerate(state["_items"]) if x}
            for block, patterns in shared.value:
                automaton = _automaton(block, patterns)
                if not patterns:
                    continue
                for i, (_, text) in enumerate(normal):
                    if not text:
                        continue
                    blanks = None
                    for at, (size, ids) in automaton.iter(text):
                        if blanks is None:
                            blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                        last = int(np.searchsorted(blanks, at))
                        hits.setdefault(i, []).append((last - size, last))
                        items.setdefault(i, set()).update(ids)
            merged = []
            for i in range(len(raw)):
                own: list[tuple[int, int]] = []
                for a, b in sorted(hits.get(i, [])):
                    if own and a <= own[-1][1]:
                        own[-1] = (own[-1][0], max(b, own[-1][1]))
                    else:
                        own.append((a, b))
                merged.append(own)
            columns = {
                "_hits": [[{"begin": a, "end": b} for a, b in x] for x in merged],
                "_items": [sorted(items.get(i, ())) for i in range(len(raw))],
                "n_words": [n for n, _ in normal],
                "n_hit": [sum(b - a for a, b in x) for x in merged],
                "spans": [],
            }
            for text, own in zip(raw, merged):
                if not own:
                    columns["spans"].append([])
                    continue
                bytes_ = np.frombuffer(text, np.uint8)
                begin, end, _ = W.spans(bytes_, np.array([0, len(bytes_)]), _IN_WORD)
                places = _character(text, [int(x) for a, b in own for x in (begin[a], end[b - 1])])
                columns["spans"].append([{"begin": a, "end": b} for a, b in zip(places[::2], places[1::2])])
            made = [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(batch.schema.names.index(f.name)) for f in schema]
            yield pa.record_batch(made, schema=schema)

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (string ids, sorted), ``spans`` (begin and end in characters of the
    original text of every stretch of hit words), each found in one scan of the text by an Aho-Corasick automaton.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is 10 consecutive words of an item, or the
    whole of a shorter item; a document word inside any occurrence of a window is hit. A null or empty text has no words
    and no hits; an item without words has no window; the windows of an item with a null id hit, but name no item; items
    that repeat, or share windows, all count; an empty benchmark hits nothing. Rows are neither joined nor shuffled, so
    repeated documents stay as they are. Columns of ``docs`` named as the new ones are replaced; ``keep`` names the columns
    of ``docs`` to return (all, if not given).

    Windows go to the workers in blocks of BLOCK_WINDOWS, at most PASS_BYTES of them at a time (counted); a larger
    benchmark takes several passes, with a written table between them.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    found = rows.mapInArrow(_windows, "window binary, size int, item string").groupBy("window").agg(F.first("size").alias("size"), F.collect_set("item").alias("items"))
    counted = found.withColumn("bytes", F.length("window") + 40 * (1 + F.size("items")))
    total = counted.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    passes = 1 + int(total[0] or 0) // PASS_BYTES
    if passes > 1:
        counted = cut_lineage(counted)
    docs = docs.drop("_hits", "_items", "n_words", "n_hit", "items", "spans")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    state = docs.withColumns({"_hits": F.array().cast(span), "_items": F.array().cast("array<string>")})
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", span)]
    for p in range(passes):
        own = counted.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == p) if passes > 1 else counted
        patterns = [(bytes(r["window"]), r["size"], tuple(r["items"])) for r in own.select("window", "size", "items").collect()]
        patterns.sort()
        blocks = []
        for i in range(0, max(1, len(patterns)), BLOCK_WINDOWS):
            part = patterns[i : i + BLOCK_WINDOWS]
            blocks.append((hashlib.md5(repr(part).encode()).hexdigest(), part))
        fields = [f for f in state.schema.fields if f.name not in {x.name for x in extra}] + extra
        if keep is not None and p + 1 == passes:
            fields = [f for f in fields if f.name in {*keep, "_hits", "_items"}] + extra
        out = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        text_at = state.columns.index(text)
        state = state.mapInArrow(_scan(spark.sparkContext.broadcast(blocks), text_at, _arrow(out)), out)
        if p + 1 < passes:
            state = cut_lineage(state)
    return state.withColumnRenamed("_items", "items").drop("_hits")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One digest row per document."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

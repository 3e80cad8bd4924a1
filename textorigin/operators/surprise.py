"""Per-token surprise from n-gram models trained and applied by Spark, and the features drawn from it.

Models of order 1..4 play the part of language models of growing size. Documents are packed into slices of about half a million tokens. A slice
sends its distinct n-grams with their counts, packed, to the buckets of their hashes; a bucket adds the counts up and returns the sums in the order
in which the n-grams came. So neither a row per n-gram nor a hash of it is shuffled, and no context is a hot key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import arrays as A
from ..functions.columns import ratio
from ..functions.fixed_values import LOSS_STATISTICS
from ..functions.text import cleaned, tokens
from ..functions.batches import slices
from ..session import drop_scratch, free_shuffles, written

ORDERS = (1, 2, 3, 4)
FLOOR = 0.01


def model_name(order: int) -> str:
    return f"ng{order}"


def _words(corpus: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return cleaned(corpus.select(key, text, *more), text).select(key, F.transform(tokens(F.col(text)), F.lower).alias("_w"), *more)


#: fixed values: multipliers of the 64-bit mix
_SPREAD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a word sequence from the hash of its beginning and its last word."""
    x = before * _SPREAD + word
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: words of a slice, of a bucket and of a batch that leaves a task, about
SLICE, BUCKET, BATCH = 1 << 19, 1 << 21, 1 << 17
#: as many of the most frequent words, at most, are written as a number when n-grams are sent; others as their hashes
FREQUENT = 1 << 20


# ---------------------------------------------------------------- packed arrays


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed block: unsigned ones as narrow as they fit, the bytes of equal weight next to each other."""
    out = []
    for a in arrays:
        if a.dtype.kind == "u":
            a = a.astype(f"<u{next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 256**w)}")
        wide = a.dtype.itemsize
        small = pa.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, wide).T).tobytes(), codec="zstd", asbytes=True) if a.size else b""
        out += [np.array([a.size, len(small), wide], "<u8").tobytes(), small]
    return b"".join(out)


def _unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of a block; those of the kind ``u`` as narrow as they are."""
    out, at = [], 0
    for kind in kinds:
        size, small, wide = np.frombuffer(block, "<u8", 3, at).tolist()
        at += 24
        if not size:
            out.append(np.zeros(0, "<u1" if kind == "u" else kind))
            continue
        body = np.frombuffer(pa.decompress(block[at : at + small], size * wide, codec="zstd", asbytes=True), np.uint8)
        own = f"<u{wide}" if "u" in kind else kind
        out.append(np.array(body.reshape(wide, -1).T, order="C").view(own).ravel().astype(own if kind == "u" else kind, copy=False))
        at += small
    return out


def _ordered(columns: Sequence[np.ndarray], largest: int) -> np.ndarray:
    """The order of rows of numbers up to ``largest``, by the first column first; several columns make one sort key."""
    bits = max(int(largest).bit_length(), 1)
    per, keys = max(63 // bits, 1), []
    for i in range(0, len(columns), per):
        one = columns[i].astype(np.int64)
        for c in columns[i + 1 : i + per]:
            one = (one << bits) | c
        keys.append(one)
    return np.lexsort(keys[::-1])


def _starts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


# ---------------------------------------------------------------- slices


def _encoded(rows: DataFrame, key: str) -> DataFrame:
    """Documents (key, _w, learn, score) in slices: their keys, sizes and flags, the distinct words as hashes, and the places of the words among these."""
    hashes = rows.select(F.col(key), "learn", "score", F.transform("_w", lambda w: F.xxhash64(w)).alias("h1"), F.transform("_w", lambda w: F.xxhash64(F.lit(1), w)).alias("h2"))
    schema = T.StructType([
        T.StructField("slice", T.StringType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("learn", T.ArrayType(T.BooleanType())),
        T.StructField("score", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("at", T.BinaryType())])

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = pa.Table.from_batches(parts).combine_chunks().columns
        keys, learn, score, h1, h2 = (c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in columns)
        sizes = pc.list_value_length(h1).to_numpy(zero_copy_only=False).astype("<u4")
        a, b = (h.flatten().to_numpy(zero_copy_only=False).astype("<i8") for h in (h1, h2))
        order = np.lexsort((b, a))
        new = _starts([a[order], b[order]])
        at = np.empty(len(a), "<u4")
        at[order] = np.cumsum(new) - 1
        first = order[new]
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
        block = lambda *arrays: pa.array([_pack(*arrays)], pa.binary())
        return pa.record_batch([pa.array([uuid.uuid4().hex]), *map(whole, (keys, learn, score)), block(sizes), block(a[first], b[first]), block(at)], [f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for low, high in slices(batch.column(3), SLICE):
                part = batch.slice(low, high - low)
                more = pc.sum(pc.list_value_length(part.column(3))).as_py() or 0
                if held and many + more > SLICE:
                    yield made(held)
                    held, many = [], 0
                held.append(part)
                many += more
        if held:
            yield made(held)

    return hashes.mapInArrow(run, schema)


def _word_counts(encoded: DataFrame) -> DataFrame:
    """(h1, h2, n, learned): how often each word occurs, in all documents and in those to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for learn, sizes, words, at in zip(*(c.to_pylist() for c in batch.columns)):
                (sizes,), (a, b), (at,) = _unpack(sizes, "<u4"), _unpack(words, "<i8", "<i8"), _unpack(at, "<u4")
                known = np.repeat(np.array(learn, bool), sizes)
                yield pa.record_batch([pa.array(a), pa.array(b), *(pa.array(np.bincount(x, minlength=len(a))) for x in (at, at[known]))], ["h1", "h2", "n", "learned"])

    rows = encoded.select("learn", "sizes", "words", "at").mapInArrow(run, "h1 long, h2 long, n long, learned long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))


def _numbers_of(counts: DataFrame) -> Broadcast:
    """The most frequent words, at most :data:`FREQUENT`: sorted hashes and their numbers, 1 for the most frequent word."""
    sizes = sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True)
    least, many = float("inf"), 0
    for n, words in sizes:
        many += words
        if many > FREQUENT:
            break
        least = n
    found = counts.filter(F.col("n") >= F.lit(float(least))).select("h1", "h2", "n").toArrow()
    a, b, n = (found.column(i).to_numpy() for i in range(3))
    order = np.lexsort((b, a, -n))
    number = np.empty(len(a), "<u4")
    number[order] = np.arange(1, len(a) + 1)
    by_hash = np.lexsort((b, a))
    return counts.sparkSession.sparkContext.broadcast((a[by_hash], b[by_hash], number[by_hash]))


def _numbered(encoded: DataFrame, numbers: Broadcast) -> DataFrame:
    """Slices whose distinct words are numbers, in their order, and then the hashes of words without one; ``at`` counts from 1."""
    schema = T.StructType([f for f in encoded.schema if f.name != "words"] + [T.StructField("known", T.BinaryType()), T.StructField("others", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, number = numbers.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (a, b), (at,) = _unpack(row["words"][0].as_py(), "<i8", "<i8"), _unpack(row["at"][0].as_py(), "<u4")
                place = np.minimum(np.searchsorted(h1, a), max(len(h1) - 1, 0))
                there = (h1[place] == a) & (h2[place] == b) if len(h1) else np.zeros(len(a), bool)
                known, others = np.flatnonzero(there), np.flatnonzero(~there)
                own = number[place[known]]
                by_number = np.argsort(own)
                moved = np.empty(len(a), "<u4")
                moved[np.append(known[by_number], others)] = np.arange(1, len(a) + 1)
                blocks = {"at": _pack(moved[at]), "known": _pack(own[by_number]), "others": _pack(a[others], b[others])}
                yield pa.record_batch([pa.array([blocks[f.name]], pa.binary()) if f.name in blocks else row[f.name] for f in schema], [f.name for f in schema])

    return encoded.mapInArrow(run, schema)


class _Slice:
    """A slice's distinct n-grams, in the order in which they are sent to each bucket."""

    def __init__(self, sizes: bytes, at: bytes, known: bytes, others: bytes, learn: list, score: list, buckets: int, highest: int):
        (self.sizes,), (at,), (self.known,), self.others = _unpack(sizes, "<u4"), _unpack(at, "<u4"), _unpack(known, "<u4"), _unpack(others, "<i8", "<i8")
        self.sizes = self.sizes.astype(np.int64)
        self.buckets, self.highest, self.words = buckets, highest, len(self.known) + len(self.others[0])
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.pos = np.arange(len(of)) - (np.cumsum(self.sizes) - self.sizes)[of]
        self.learn, self.score = (np.array(f, bool)[of] for f in (learn, score))
        self.more = self.pos + 1 < self.sizes[of]
        self.at = at.astype(np.int64)
        code = np.append(self.known.astype(np.uint64), self.others[0].view(np.uint64))
        self.code = np.append(np.uint64(0), _chained(np.append(np.zeros(len(self.known), np.uint64), np.ones(len(self.others[0]), np.uint64)), code))

    def back(self, steps: int, places: np.ndarray) -> np.ndarray:
        """The word so many steps before each place, 0 before the beginning."""
        return np.where(self.pos[places] >= steps, self.at[places - steps], 0)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """The distinct ``k``-grams, for the longest together with the word before: the places of all, for each the number of its n-gram, the
        n-grams' words, the buckets they go to. They are ordered by bucket."""
        places = np.flatnonzero(self.pos >= k - 1)
        columns = [self.back(s, places) for s in range(k - 1, -1, -1)] + ([self.back(k, places)] if k == self.highest - 1 else [])
        order = _ordered(columns, self.words)
        new = _starts([c[order] for c in columns])
        first = order[new]
        columns = [c[first] for c in columns]
        code = np.zeros(len(first), np.uint64)
        for c in columns[:k]:
            code = _chained(code, self.code[c])
        bucket = (code % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        moved = np.empty(len(first), np.int64)
        moved[by_bucket] = np.arange(len(first))
        gram = np.empty(len(places), np.int64)
        gram[order] = moved[np.cumsum(new) - 1] if len(order) else moved
        return places, gram, [c[by_bucket] for c in columns], bucket[by_bucket]


def _kinds(highest: int) -> range:
    """Lengths of the n-grams that are sent: the longest go with those one shorter."""
    return range(1, max(highest - 1, 1) + 1)


def _sent(numbered: DataFrame, buckets: int, highest: int) -> DataFrame:
    """(bucket, slice, block): the n-grams of a slice that belong to a bucket, how often they occur, and end a text, where to learn from, and whether their counts are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *given in zip(*(c.to_pylist() for c in batch.columns)):
                s = _Slice(*given, buckets, highest)
                value = np.append(np.append(0, s.known.astype(np.int64)), np.zeros(len(s.others[0]), np.int64))
                message = [[] for _ in range(buckets)]
                for k in _kinds(highest):
                    places, gram, columns, bucket = s.grams(k)
                    n = len(bucket)
                    learn = s.learn[places]
                    seen, ends = (np.bincount(gram[m], minlength=n).astype("<u4") for m in (learn, learn & ~s.more[places]))
                    wanted = np.zeros(n, "<u1")
                    wanted[gram[s.score[places]]] = 1
                    border = np.searchsorted(bucket, np.arange(buckets + 1))
                    for b in range(buckets):
                        low, high = border[b], border[b + 1]
                        message[b].append(([c[low:high] for c in columns], seen[low:high], ends[low:high], wanted[low:high]))
                blocks = []
                for parts in message:
                    # words without a number go along as hashes
                    used = np.unique(np.concatenate([c[c > len(s.known)] for columns, *_ in parts for c in columns]))
                    value[used] = -1 - np.arange(len(used))
                    arrays = [h[used - 1 - len(s.known)] for h in s.others]
                    for columns, *counts in parts:
                        own = [value[c].astype("<i4") for c in columns]
                        arrays += [np.diff(own[0], prepend=np.int32(0)).astype("<i4"), *own[1:], *counts]
                    blocks.append(_pack(*arrays) if any(len(p[1]) for p in parts) else None)
                there = [b for b in range(buckets) if blocks[b] is not None]
                yield pa.record_batch([pa.array(there, pa.int32()), pa.array([name] * len(there)), pa.array([blocks[b] for b in there], pa.binary())], ["bucket", "slice", "block"])

    return numbered.select("slice", "sizes", "at", "known", "others", "learn", "score").mapInArrow(run, "bucket int, slice string, block binary")


def _added(sent: DataFrame, numbers: int, highest: int) -> DataFrame:
    """(slice, bucket, block): the sums over all slices for the n-grams that a slice wants to know, in its order. There are ``numbers`` words with a number."""
    widths = {k: k + (k == highest - 1) for k in _kinds(highest)}
    layout = ["<i8", "<i8"] + [t for w in widths.values() for t in ["<i4"] * w + ["<u4", "<u4", "<u1"]]

    def added(table: pa.Table) -> pa.Table:
        # in one order for every run
        table = table.sort_by("slice")
        opened = [_unpack(b.as_py(), *layout) for b in table["block"]]
        names = table["slice"].to_pylist()
        h1, h2 = (np.concatenate([o[i] for o in opened]) for i in (0, 1))
        order = np.lexsort((h2, h1))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(_starts([h1[order], h2[order]]))
        begin = np.cumsum([0] + [len(o[0]) for o in opened])
        replies, at = [[] for _ in opened], 2
        for k, width in widths.items():
            parts = []
            for i, o in enumerate(opened):
                own, ranks = [np.cumsum(o[at], dtype=np.int32), *o[at + 1 : at + width]], rank[begin[i] : begin[i + 1]]
                for c in own:
                    other = c < 0
                    c[other] = numbers + ranks[-1 - c[other]]
                parts.append(own)
                o[at : at + width] = [None] * width
            columns = [np.concatenate([p[j] for p in parts]) for j in range(width)]
            seen, ends, wanted = (np.concatenate([o[at + width + j] for o in opened]) for j in range(3))
            border = np.cumsum([0] + [len(p[0]) for p in parts])
            at += width + 3
            del parts
            order = _ordered(columns, numbers + len(rank))
            ordered = [c[order] for c in columns]
            del columns

            def total(v: np.ndarray, same: list[np.ndarray]) -> np.ndarray:
                """The sum of ``v`` over equal rows, for each row as it came."""
                of = np.cumsum(_starts(same)) - 1
                out = np.empty(len(order), "<u8")
                out[order] = np.bincount(of, v[order]).astype(np.int64)[of] if len(of) else 0
                return out

            sums = [total(seen, ordered[:k]), total(ends, ordered[:k])] + ([total(seen, ordered)] if width > k else [])
            for i in range(len(opened)):
                low, high = border[i], border[i + 1]
                asked = wanted[low:high] > 0
                replies[i] += [v[low:high][asked] for v in sums]
            del ordered, order, sums
        there = [i for i, r in enumerate(replies) if any(len(v) for v in r)]
        pa.default_memory_pool().release_unused()
        return pa.table({"slice": pa.array([names[i] for i in there], pa.string()), "bucket": pa.array([table["bucket"][i].as_py() for i in there], pa.int32()),
                         "block": pa.array([_pack(*replies[i]) for i in there], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(added, "slice string, bucket int, block binary")


def _joined(numbered: DataFrame, added: DataFrame, buckets: int, highest: int) -> DataFrame:
    """The scored documents of a slice: their keys, learn flags and sizes, the places of their words among its distinct words (``at``), for each of
    these how often it occurs and ends a text (``words``), and the same for the longer n-grams that end at each place (``grams``)."""
    kinds = _kinds(highest)
    layout = ["<u8"] * sum(2 + (k == highest - 1) for k in kinds)
    blocks = ("sizes", "at", "words", "grams")
    schema = T.StructType([numbered.schema["keys"], numbered.schema["learn"], *(T.StructField(n, T.BinaryType()) for n in blocks)])

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        given = {n: left[n][0].as_py() for n in ("sizes", "at", "known", "others", "learn", "score")}
        s = _Slice(*given.values(), buckets, highest)
        opened = [_unpack(b.as_py(), *layout) for b in right.sort_by("bucket")["block"]]
        sums = iter([np.concatenate([o[i] for o in opened]) if opened else np.zeros(0, "<u8") for i in range(len(layout))])
        words, grams = [], []
        for k in kinds:
            places, gram, columns, _ = s.grams(k)
            mine = s.score[places]
            asked = np.zeros(len(columns[0]), bool)
            asked[gram[mine]] = True
            for _ in range(2 + (k == highest - 1)):
                v = next(sums)
                if k == 1 and len(words) < 2:
                    words.append(np.zeros(s.words + 1, "<u8"))
                    words[-1][columns[0][asked]] = v
                else:
                    grams.append(np.zeros(len(s.at), "<u8"))
                    grams[-1][places[mine]] = v[(np.cumsum(asked) - 1)[gram[mine]]]
        scored = pa.array(given["score"], pa.bool_())
        kept = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (left[n][0].values.filter(scored) for n in ("keys", "learn"))]
        arrays = ([s.sizes[np.array(given["score"], bool)].astype("<u8")], [s.at[s.score].astype("<u4")], words, [v[s.score] for v in grams])
        return pa.table([*kept, *(pa.array([_pack(*a)], pa.binary()) for a in arrays)], [f.name for f in schema])

    wanted = numbered.filter(F.exists("score", lambda x: x))
    return wanted.groupBy("slice").cogroup(added.groupBy("slice")).applyInArrow(joined, schema)


@dataclass(frozen=True)
class PackedLosses:
    """Slices of documents with the counts that their losses follow from, a few bytes for each token; ``vocabulary`` counts the distinct
    words that were learned, ``total`` all of them."""

    table: DataFrame
    orders: tuple[int, ...]
    vocabulary: int
    total: int

    def unpacked(self, key: str = "id", learned: bool = False) -> DataFrame:
        """``key`` plus one array of losses per order, of all documents or of those that were ``learned`` from; one narrow pass."""
        orders, highest, total, floor = self.orders, max(self.orders), float(max(self.total, 1)), FLOOR / (self.vocabulary + 1.0)
        names = [model_name(n) for n in orders]
        layout = ["u"] * (sum(2 + (k == highest - 1) for k in _kinds(highest)) - 2)
        schema = T.StructType([T.StructField(key, self.table.schema["keys"].dataType.elementType), *(T.StructField(m, T.ArrayType(T.DoubleType())) for m in names)])

        def values(at: np.ndarray, pos: np.ndarray, words: list[np.ndarray], grams: list[np.ndarray]) -> list[np.ndarray]:
            here = np.flatnonzero(pos >= 1)
            before = here - 1
            # how often the n-gram at a place occurs, and how often it goes on
            counted, goes_on = {1: lambda p: words[0][at[p]].astype(float)}, {1: lambda p: (words[0] - words[1])[at[p]].astype(float)}
            rest = iter(grams)
            for n in range(2, highest):
                counted[n], goes_on[n] = (lambda p, v=next(rest): v[p].astype(float)), None
                goes_on[n] = lambda p, c=counted[n], v=next(rest): c(p) - v[p]
            if highest > 1:
                counted[highest] = lambda p, v=next(rest): v[p].astype(float)
            own = {1: counted[1](here) / total}
            for n in range(2, highest + 1):
                of = np.where(pos[here] >= n - 1, goes_on[n - 1](before), 0)
                own[n] = np.divide(counted[n](here), of, out=np.zeros(len(here)), where=of > 0)
            out = []
            for n in orders:
                mixed = np.full(len(here), floor)
                for k in orders:
                    if k <= n:
                        mixed += (1 - FLOOR) * 2.0 ** (k - 1) / (2.0**n - 1) * own[k]
                out.append(np.round(-np.log(mixed), 6) + 0.0)
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    keys, learn = (batch[n][i].values for n in ("keys", "learn"))
                    (sizes,), (at,), words, grams = (_unpack(batch[n][i].as_py(), *kinds) for n, kinds in (("sizes", ["<u8"]), ("at", ["<u4"]), ("words", ["<u8"] * 2), ("grams", layout)))
                    begins = np.append(0, np.cumsum(sizes.astype(np.int64)))
                    tokens_of = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(at))
                    for low, high in slices(tokens_of, BATCH):
                        own = slice(begins[low], begins[high])
                        some = sizes[low:high].astype(np.int64)
                        pos = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
                        ends = pa.array(np.append(0, np.cumsum(np.maximum(some - 1, 0))).astype(np.int32))
                        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values(at[own], pos, words, [g[own] for g in grams])]
                        part = pa.record_batch([keys.slice(low, high - low), *lists], [key, *names])
                        yield part.filter(learn.slice(low, high - low)) if learned else part

        return self.table.mapInArrow(run, schema)


def packed_losses(rows: DataFrame, key: str, orders: Sequence[int] = ORDERS) -> PackedLosses:
    """Packed losses, written once, of documents (key, _w, learn, score): n-grams are learned from those to ``learn``, and those to ``score`` are scored.

    Each table goes as soon as the next one is written.
    """
    spark = rows.sparkSession

    def kept(build: Callable[[], DataFrame], *last: str, shuffled: bool = True) -> tuple[DataFrame, str]:
        table, path = written(build())
        drop_scratch(spark, list(last))
        if shuffled:
            free_shuffles(spark)
        return table, path

    encoded, plain = kept(lambda: _encoded(rows, key))
    counts, counted = kept(lambda: _word_counts(encoded), shuffled=False)
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("learned"), F.lit(0)).alias("learned"), F.count_if(F.col("learned") > 0).alias("words")).first()
    numbers = _numbers_of(counts)
    numbered, known = kept(lambda: _numbered(encoded, numbers), plain, counted, shuffled=False)
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-sizes["n"] // BUCKET))
    highest = max(orders)
    added, sums = kept(lambda: _added(_sent(numbered, buckets, highest), len(numbers.value[0]), highest))
    out, _ = kept(lambda: _joined(numbered, added, buckets, highest), known, sums)
    numbers.unpersist()
    return PackedLosses(out, tuple(orders), sizes["words"], sizes["learned"])


def _once(rows: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """``rows`` with one scored text of at least two words per key: of a key that repeats the longest one is scored, and all are learned from."""
    same = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_again"))
    if same.limit(1).count() == 0:
        return rows
    again = F.col(key).eqNullSafe(F.col("_again"))
    long, first = F.size("_w") >= 2, Window.partitionBy(key).orderBy(F.size("_w").desc(), F.xxhash64("_w").desc())
    repeated = rows.filter(long).join(same, again, "left_semi").withColumn("score", F.col("score") & (F.row_number().over(first) == 1))
    return rows.filter(~long).unionByName(rows.filter(long).join(same, again, "left_anti")).unionByName(repeated)


def packed_within(corpus: DataFrame, learn: str, key: str = "id", text: str = "text", orders: Sequence[int] = ORDERS) -> PackedLosses:
    """Packed losses of a corpus whose own rows with ``learn`` are those that n-grams are learned from."""
    rows = _words(corpus, key, text, learn).select(key, "_w", F.col(learn).alias("learn"), F.lit(True).alias("score"))
    return packed_losses(_once(rows, corpus, key), key, orders)


class GramModel:
    """Interpolated n-gram probabilities of a training corpus: conditional frequencies of its n-grams."""

    def __init__(self, words: DataFrame, orders: Sequence[int] = ORDERS):
        self.words, self.orders = words, tuple(orders)

    @classmethod
    def fit(cls, corpus: DataFrame, key: str = "id", text: str = "text", orders: Sequence[int] = ORDERS) -> "GramModel":
        """All n-grams of the (training) corpus; they are counted together with those that are asked for."""
        return cls(_words(corpus, key, text).select("_w"), orders)

    def losses(self, corpus: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """``key`` plus one array of losses per order; whole texts, first token excluded, empty below two tokens."""
        rows = _words(corpus, key, text).select(key, "_w", F.lit(False).alias("learn"), F.lit(True).alias("score"))
        none = F.lit(None).cast(rows.schema[key].dataType)
        train = self.words.select(none.alias(key), "_w", F.lit(True).alias("learn"), F.lit(False).alias("score"))
        return packed_losses(_once(rows, corpus, key).unionByName(train), key, self.orders).unpacked(key)


def token_probability(losses: Column) -> Column:
    return F.transform(losses, lambda x: F.exp(-F.least(x, F.lit(50.0))))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _ranked(losses: pa.Array) -> pa.Array:
    """Ranks from the largest loss on, ties averaged, over the length of the array."""
    parts = []
    for low, high in slices(losses, BATCH):
        part = losses.slice(low, high - low)
        sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x, of = part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((-x, of))
        first = np.flatnonzero(_starts([of[order], x[order]]))
        many = np.diff(np.append(first, len(x)))
        owner = of[order][first]
        before = first - (np.cumsum(sizes) - sizes)[owner]
        rank = np.empty(len(x))
        # half up, as Spark rounds
        rank[order] = np.repeat(np.floor((before * 2 + many + 1) / 2.0 / sizes[owner] * 1e8 + 0.5) / 1e8, many)
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(rank), mask=part.is_null() if part.null_count else None))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))


def probability_rank(losses: Column) -> Column:
    """Percent rank of the probability: 1 for the least surprising token, ties averaged."""
    return _ranked(losses)


def loss_records(losses: DataFrame, corpus: DataFrame, key: str = "id", text: str = "text", max_length: int | None = None) -> DataFrame:
    """One token-loss record per document and model, as kept in the cache."""
    names = [c for c in losses.columns if c != key]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("loss_sequence")) for m in names]))
    hashes = cleaned(corpus.select(key, text), text).select(key, F.sha2(text, 256).alias("text_hash"))
    return (
        losses.select(key, pairs.alias("r"))
        .select(key, "r.model_name", F.size("r.loss_sequence").alias("token_count"), "r.loss_sequence")
        .withColumns({
            "rank_sequence": probability_rank(F.col("loss_sequence")),
            "prob_sequence": token_probability(F.col("loss_sequence")),
            "max_length": F.lit(max_length).cast("int"),
            "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        })
        .join(hashes, key)
    )


def loss_statistics(losses: DataFrame, key: str = "id", models: Sequence[str] | None = None) -> DataFrame:
    """The 12 probability features per model; null for an empty or missing sequence."""
    models = models or [c for c in losses.columns if c != key]
    clean = losses.select(key, *[F.filter(m, lambda x: x.isNotNull() & ~F.isnan(x)).alias(m) for m in models])
    staged = clean.withColumns({f"_m_{m}": A.moments(F.col(m)) for m in models})
    out = []
    for m in models:
        a, s = F.col(m), F.col(f"_m_{m}")
        std = F.sqrt(s["m2"])
        flat = (s["m2"] == 0) | s["m2"].isNull()
        values = {
            "ppl": F.exp(F.least(s["mean"], F.lit(50.0))),
            "loss_mean": s["mean"],
            "loss_std": std,
            "loss_cv": ratio(std, s["mean"]),
            "loss_min": F.array_min(a),
            "loss_max": F.array_max(a),
            "loss_range": F.array_max(a) - F.array_min(a),
            "loss_skewness": F.when((s["n"] < 3) | flat, F.lit(0.0)).otherwise(F.try_divide(s["m3"], s["m2"] * std)),
            "loss_kurtosis": F.when((s["n"] < 4) | flat, F.lit(0.0)).otherwise(F.try_divide(s["m4"], s["m2"] * s["m2"]) - 3.0),
            "top_10_percent_loss_mean": A.edge_mean(a, 0.10, largest=True),
            "bottom_10_percent_loss_mean": A.edge_mean(a, 0.10, largest=False),
            "token_count_used": F.size(a).cast("double"),
        }
        out += [F.when(F.size(a) > 0, values[k]).alias(f"{m}_{k}") for k in LOSS_STATISTICS]
    return staged.select(key, *out)


def contrast(stats: DataFrame, observer: str, performer: str, key: str = "id") -> DataFrame:
    """Two models compared on the same document (prefix ``bino_observer_performer``)."""
    p = f"bino_{observer}_{performer}"
    o, q = (lambda k: F.col(f"{observer}_{k}")), (lambda k: F.col(f"{performer}_{k}"))
    known = o("ppl").isNotNull() & q("ppl").isNotNull()
    out = {
        "ppl_observer": o("ppl"), "ppl_performer": q("ppl"), "loss_mean_observer": o("loss_mean"), "loss_mean_performer": q("loss_mean"),
        "loss_std_observer": o("loss_std"), "loss_std_performer": q("loss_std"),
        "ppl_ratio": F.when(known, ratio(o("ppl"), q("ppl"))),
        "loss_mean_diff": o("loss_mean") - q("loss_mean"),
        "loss_std_diff": o("loss_std") - q("loss_std"),
        "binoculars_style_score": F.when(known, ratio(o("loss_mean"), q("loss_mean"))),
    }
    return stats.select(key, *[v.alias(f"{p}_{k}") for k, v in out.items()])


def contrasts(stats: DataFrame, pairs: Sequence[tuple[str, str]], key: str = "id") -> DataFrame:
    """Several pairs side by side; ids of any pair are kept."""
    out = None
    for observer, performer in pairs:
        one = contrast(stats, observer, performer, key)
        out = one if out is None else out.join(one, key, "full_outer")
    return out

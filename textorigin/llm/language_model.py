"""Scoring of whole documents by a recurrent language model, beside a smoothed count of their tokens over the whole corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import recurrent as R
from . import words as W
from .compression import held_out

#: words that are items of their own; all others share RARE items, told apart by their last three bytes
VOCABULARY, RARE_BITS = 2047, 6
RARE = 1 << RARE_BITS
#: most frequent words whose counts every worker holds (16 bytes each); the others' counts come by a join
KNOWN_WORDS = 1 << 18
#: documents of the starting point and the characters that these have together: what the driver holds of texts
FIT_DOCUMENTS, FIT_CHARACTERS, FIT_PASSES = 3_000, 1 << 26, 2
#: rate of the pass over all training texts, in all tasks at once
REFINE_RATE = 0.004
#: weights in one row of the sums over tasks
WEIGHTS_PER_ROW = 1 << 10
#: distinct words that a counting task gathers before it passes them on
GATHERED = 1 << 20

_U = np.uint64


def token_hashes(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) and their number per text. The lowest RARE_BITS bits depend on the last bytes only."""
    begin, end, at = W.spans(raw, borders)
    h, folded = W.hashes(raw, begin, end), W.LOWER[raw].astype(np.uint64)
    if not len(begin):
        return h, np.diff(at)
    size, tail = end - begin, folded[end - 1]
    for k in (2, 3):
        tail = tail + np.where(size >= k, folded[np.maximum(end - k, 0)] << _U(8 * (k - 1)), _U(0))
    return (h & ~_U(RARE - 1)) | (W.mix(tail) >> _U(64 - RARE_BITS)), np.diff(at)


def _sliced(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, borders = W.texts(column)
    for low, high in W.slices(borders):
        yield low, high, *token_hashes(raw[borders[low] : borders[high]], borders[low : high + 1] - borders[low])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def out():
        return pa.record_batch([pa.array(held[0].view(np.int64)), pa.array(held[1])], ["h", "c"])

    for batch in batches:
        for _, _, h, _ in _sliced(batch.column(0)):
            words, counts = np.unique(h, return_counts=True)
            both = np.concatenate([held[0], words])
            order = np.argsort(both, kind="stable")
            sums = np.concatenate([held[1], counts])[order]
            words, places = np.unique(both[order], return_index=True)
            held = (words, np.add.reduceat(sums, places) if len(places) else sums)
            if len(held[0]) >= GATHERED:
                yield out()
                held = (held[0][:0], held[1][:0])
    yield out()


def count_words(train: DataFrame) -> DataFrame:
    """(h, c) of every word of the column ``text``; tasks add up what they read before the shuffle."""
    return cut_lineage(train.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts above the lowest count that no more than KNOWN_WORDS words reach, by falling count."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    # at most about a thousand levels
    levels = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for l, n in levels:
        total += n
        if total > KNOWN_WORDS:
            break
        least = l
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.filter(level >= least).select("h", "c").toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


class _Places:
    """Where words stand among sorted distinct ones: by their leading bits, then a few steps upwards."""

    def __init__(self, words: np.ndarray):
        bits = min(max(len(words), 1).bit_length() + 1, 24)
        self.shift = _U(64 - bits)
        self.words = np.append(words, _U((1 << 64) - 1))
        self.first = np.concatenate([[0], np.cumsum(np.bincount((words >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``h`` a place (also beyond the last word), and whether it stands there."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        own = self.words[at]
        behind = np.flatnonzero(own < h)
        while len(behind):
            at[behind] += 1
            own[behind] = self.words[at[behind]]
            behind = behind[own[behind] < h[behind]]
        found = own == h
        found &= at < len(self.words) - 1
        return at, found


class Vocabulary:
    """What the workers need besides the network: items, counts of frequent words, and totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int, rare: list[tuple[int, int]], total: int, distinct: int):
        self.total, self.distinct, self.ends = total, distinct, ends
        self.rare_sum = np.array([c + n + 1 for c, n in rare], float)
        own = words[:VOCABULARY]
        item_counts = np.concatenate([counts[:VOCABULARY], [c for c, _ in rare]]).astype(float)
        order = np.argsort(-item_counts, kind="stable")
        item = np.empty(len(order), np.int32)
        item[order] = np.arange(1, len(order) + 1)
        self.counts = np.concatenate([[max(ends, 1)], item_counts[order]])
        self.rare_item = item[len(own) :]
        by = np.argsort(own)
        self.own, self.own_item = _Places(own[by]), np.append(item[: len(own)][by], np.int32(0))
        by = np.argsort(words)
        self.words, self.word_counts = _Places(words[by]), np.append(counts[by], 0)

    def items(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item of each word, and whether it is one of its own."""
        at, alone = self.own(h)
        return np.where(alone, self.own_item[at], self.rare_item[(h & _U(RARE - 1)).astype(np.int64)]), alone

    def known(self, h: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        at, found = self.words(h)
        return np.where(found, self.word_counts[at], 0)


def _with_ends(items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    borders = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(borders[-1]), R.END, np.int32)
    inner = np.ones(len(out), bool)
    inner[borders[1:] - 1] = False
    out[inner] = items
    return out, borders


def _streams(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    parts = [(vocabulary.items(h)[0], sizes) for _, _, h, sizes in _sliced(texts)]
    none = [np.zeros(0, np.int32)]
    return _with_ends(np.concatenate(none + [p for p, _ in parts]), np.concatenate([np.zeros(0, np.int64)] + [s for _, s in parts]))


def fit(train: DataFrame, vocabulary: Vocabulary) -> R.Network:
    """A network that has learned from every training text, whole: each task continues from a common starting point over its part of
    them, and the weights are averaged by their numbers of tokens. The starting point is fitted on the driver to the first
    FIT_DOCUMENTS texts by md5 of the id, as far as these have FIT_CHARACTERS together."""
    net = R.start(vocabulary.counts)
    rank = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = train.select("doc_id", rank.alias("r")).orderBy("r").limit(FIT_DOCUMENTS)
    last = first.agg(F.max("r")).first()[0]
    if last is None:
        return net
    some = train.filter(rank <= last).select(rank.alias("r"), "text").orderBy("r", "text").limit(FIT_DOCUMENTS)
    ends = np.cumsum([r[0] for r in some.select(F.length("text")).collect()])
    held = int(np.searchsorted(ends, FIT_CHARACTERS, "right"))
    if held:
        net = R.train(net, *_streams(some.limit(held).toArrow().column("text"), vocabulary), passes=FIT_PASSES)
    shared = train.sparkSession.sparkContext.broadcast((net, vocabulary))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = shared.value
        weight = 0
        for batch in batches:
            tokens, borders = _streams(batch.column(0), words)
            if len(tokens):
                own = R.train(own, tokens, borders, rate=REFINE_RATE)
                weight += len(tokens)
        if weight:
            flat = np.concatenate([getattr(own, k).ravel() for k in R.WEIGHTS]).astype(np.float64) * weight
            rows = [flat[i : i + WEIGHTS_PER_ROW].tobytes() for i in range(0, len(flat), WEIGHTS_PER_ROW)]
            yield pa.record_batch([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows, pa.binary()), pa.array(np.full(len(rows), float(weight)))], ["i", "w", "n"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = {}, {}
        for batch in batches:
            for i, w, n in zip(*batch.columns):
                i, w = i.as_py(), np.frombuffer(w.as_buffer())
                sums[i], weights[i] = (sums[i] + w, weights[i] + n.as_py()) if i in sums else (w, n.as_py())
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([(sums[i] / weights[i]).tobytes() for i in sums], pa.binary())], ["i", "w"])

    rows = train.select("text").mapInArrow(refine, "i int, w binary, n double").repartition("i").mapInArrow(mean, "i int, w binary")
    parts = {r["i"]: r["w"] for r in rows.collect()}
    if not parts:
        return net
    flat = np.concatenate([np.frombuffer(parts[i]) for i in sorted(parts)])
    made, at = {}, 0
    for k in R.WEIGHTS:
        shape = getattr(net, k).shape
        n = math.prod(shape)
        made[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return replace(net, **made)


def score(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score; learned from ``train`` (doc_id, text).

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text after lower-casing A-Z, and one end. ``base_score`` adds
    log10((c + 1) / (N + V + 1)) with c the token's count, N all and V distinct tokens of the training texts. ``score`` is the
    recurrent model's log10 probability of the whole text: of the words' items, and for words that share an item, of the word
    among them, (c + 1) over the sum of c + 1 and one unknown word. A null or empty text is just an end; repeated rows
    get equal scores up to rounding; an empty table gives no rows; without training texts N and V are 0 and every item
    is about equally likely.

    Words are told apart by 64-bit hashes. All counts cover all training texts. A worker holds the counts of the KNOWN_WORDS
    most frequent words; those of all others are joined to the documents that have them, by word, and no such word is a hot key.
    """
    spark = docs.sparkSession
    train = train.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = count_words(train)
    ends = train.count()
    words, known = _frequent(counts)
    items = spark.createDataFrame([(int(x),) for x in words[:VOCABULARY].view(np.int64)] or [(0,)], "h long")
    if not len(words):
        items = items.limit(0)
    others = counts.join(F.broadcast(items), "h", "left_anti").groupBy(F.col("h").bitwiseAND(RARE - 1).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    rare = {r["b"]: (r["c"], r["n"]) for r in others}
    total = counts.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).first()
    n_all, distinct = int(total["c"] or 0) + ends, total["n"] + (ends > 0)
    vocabulary = Vocabulary(words, known, ends, [rare.get(b, (0, 0)) for b in range(RARE)], n_all, distinct)
    net = fit(train, vocabulary)
    shared = spark.sparkContext.broadcast((net, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, voc = shared.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, items, base, seen, inner, rare_h, rare_n, cut = [], [], [], [], [], [], [], [0]
            for low, high, h, sizes in _sliced(batch.column(1)):
                item, alone = voc.items(h)
                c = voc.known(h)
                doc = np.repeat(np.arange(high - low), sizes)
                logs = np.log10(c + 1.0)
                base.append(np.bincount(doc, logs, high - low))
                seen.append(np.bincount(doc, c > 0, high - low).astype(np.int64))
                # words of shared items: their part of the item, for now with a count of 0 where it is not known here
                inner.append(np.bincount(doc[~alone], logs[~alone] - np.log10(voc.rare_sum)[(h[~alone] & _U(RARE - 1)).astype(np.int64)], high - low))
                items.append(item)
                n.append(sizes)
                off = c == 0
                order = np.lexsort((h[off], doc[off]))
                d, g = doc[off][order], h[off][order]
                fresh = np.ones(len(d), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
                at = np.flatnonzero(fresh)
                rare_h.append(g[at].view(np.int64))
                rare_n.append(np.diff(np.append(at, len(d))))
                cut.extend((np.cumsum(np.bincount(d[at], minlength=high - low)) + cut[-1]).tolist())
            if not n:
                continue
            sizes = np.concatenate(n)
            tokens, borders = _with_ends(np.concatenate(items), sizes)
            by_model = R.log_probabilities(own, tokens, borders) / math.log(10)
            end = math.log10(voc.ends + 1.0)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(rare_h)), pa.array(np.concatenate(rare_n).astype(np.int32))], ["h", "n"])
            columns = [
                pa.array(uid + np.arange(len(sizes))), batch.column(0), pa.array(sizes + 1), pa.array(np.concatenate(seen) + (voc.ends > 0)),
                pa.array(np.concatenate(base) + end - (sizes + 1) * math.log10(voc.total + voc.distinct + 1)), pa.array(by_model + np.concatenate(inner)),
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs),
            ]
            uid += len(sizes)
            yield pa.record_batch(columns, ["uid", "doc_id", "n_tokens", "known", "base", "model", "rare"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = cut_lineage(given.mapInArrow(run, "uid long, doc_id long, n_tokens long, known long, base double, model double, rare array<struct<h:long,n:int>>"))
    asked = rows.select("uid", F.explode("rare").alias("r")).select("uid", "r.h", "r.n")
    found = asked.join(counts, "h")
    log = F.log10(F.col("c") + F.lit(1.0))
    more = found.groupBy("uid").agg(F.sum(F.col("n") * log).alias("more"), F.sum("n").alias("more_known"))
    zero = F.lit(0.0)
    return rows.drop("rare").join(more, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"), (F.col("model") + F.coalesce("more", zero)).alias("score"),
    )


def op10(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = held_out("doc_id", 7, 2)
    return score(docs, docs.filter(~out)).withColumn("held_out", out)

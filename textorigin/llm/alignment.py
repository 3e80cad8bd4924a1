"""Cross-tokenizer alignment: token pairs of two vocabularies in inverted document bitmaps, whose counts go back to the documents.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). For each pair of ids whose tokens overlap somewhere
there are postings: bitmaps over the documents of a container of DOCUMENTS neighbouring rows, one for each binary digit of the
number of links that a document has of the pair (multiplicity planes). A bitmap is compressed: a list of 16-bit numbers, or all its bits where
that is shorter. Bitmaps of a container that come from different batches are OR-merged, their bits counted, and the counts
summed over containers; then every posting returns its pair's score to its documents.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import words as W
from .tokens import _white as white

#: documents of a container, as a power of two
SHIFT = 12
DOCUMENTS = 1 << SHIFT
#: bytes of a bitmap that is not a list
FULL = DOCUMENTS // 8
#: bytes of text handled at once, and entries (document, pair) that a task holds before it writes their bitmaps
SLICE, ENTRIES = 2 << 20, 2_000_000
#: pieces of text that a worker remembers (about 150 MB in all)
KEPT_PIECES = 400_000
#: containers of a pair that may meet in one task, as one of so many parts of all
SALTS = 64
#: what follows an id in the text of the groups: inside a group's side, after the side of A, after a group, at the end
SIGNS = (",", "|", ";", "")

MADE = (
    "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " container long, a int, b int, plane int, bits binary"
)
_DOC = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_POSTING = ("container", "a", "b", "plane", "bits")


def _byte_characters() -> dict[str, int]:
    """What stands for each byte in a byte-level vocabulary: printable characters themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(others)}}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after the other, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Vocabulary:
    """The bytes of each token, one after the other."""

    def __init__(self, spelled: list[bytes]):
        self.sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def spells(self, ids: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """For each text whether its tokens' joined bytes are the text; ``ids`` has the texts' tokens, ``sizes`` their numbers."""
        long, n = self.sizes[ids], np.arange(len(raw))
        wide = np.fromiter(map(len, raw), np.int64, len(raw))
        of = np.repeat(n, sizes)
        same = np.bincount(of, long, len(raw)).astype(np.int64) == wide
        kept = same[of]
        long, begin = long[kept], self.begins[ids[kept]]
        steps = np.repeat(begin - (np.cumsum(long) - long), long) + np.arange(long.sum())
        text = np.frombuffer(b"".join(itertools.compress(raw, same)), np.uint8)
        off = np.flatnonzero(self.data[steps] != text)
        same[np.repeat(n[same], wide[same])[off]] = False
        return same


class Aligner:
    """Tokens of pieces of text in both vocabularies, and how they overlap.

    A text is cut where no token of either vocabulary can reach across: before a blank or line end between two characters that are no white
    space. That holds for A, whose splitting step joins at most one blank to what follows and keeps a line end apart, and for B if no
    piece has its blank sign behind another character, and none holds a line end besides other characters; both are checked
    on the vocabularies, and without them texts are not cut. So the tokens of a piece, its groups and its links are the same
    wherever it stands; they are found once per worker for the first KEPT_PIECES pieces.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        own = json.loads(self.a.to_str())
        byte = _byte_characters()
        added = {t["content"] for t in own.get("added_tokens") or []}
        spelled = {i: t.encode() if t in added else bytes(byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.in_a = Vocabulary([spelled.get(i, b"") for i in range(max(spelled) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.in_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        before = own.get("pre_tokenizer") or {}
        a_cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not own.get("normalizer")
        b_cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode("x", out_type=str)[0].startswith("▁")
        self.blank = a_cuts and b_cuts
        self.line = self.blank and not any("\n" in p and len(p) > 1 for p in pieces)
        self.blank_id = self.b.piece_to_id("▁")
        self.numbers: dict[int, int] = {}
        self.counts = np.zeros((1024, 5), np.int64)  # per piece: tokens of A, of B, groups, links, 1 if the bytes agree
        self.shown: list[str] = []
        self.pairs, self.pair_at, self.filled = np.zeros(1 << 16, np.uint64), np.zeros(1025, np.int64), 0

    def _b_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of B. A text that begins with a blank loses it, as B adds one; one that begins with a line end gets a blank of its own, which goes again."""
        got = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, got)]

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Numbers for new pieces, all aligned at once: their tokens' ends are counted through the whole batch."""
        at, n = len(self.shown), len(texts)
        while at + n > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.pair_at = np.concatenate([self.pair_at, np.zeros(len(self.pair_at) - 1, np.int64)])
        raw = [t.encode() for t in texts]
        a, size_a = _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        b, size_b = _flat(self._b_ids(texts))
        good = self.in_a.spells(a, size_a, raw) & self.in_b.spells(b, size_b, raw)
        a, b = a[np.repeat(good, size_a)], b[np.repeat(good, size_b)]
        size_a, size_b = np.where(good, size_a, 0), np.where(good, size_b, 0)
        stop_a, stop_b = np.cumsum(self.in_a.sizes[a]), np.cumsum(self.in_b.sizes[b])
        piece_a, piece_b = np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)
        # what lies between neighbouring ends of either kind is in one token of A and one of B: a link
        stops = np.union1d(stop_a, stop_b)
        of_a, of_b = np.searchsorted(stop_a, stops), np.searchsorted(stop_b, stops)
        pairs = a[of_a].astype(np.uint64) << np.uint64(32) | b[of_b].astype(np.uint64)
        linked = np.bincount(piece_a[of_a], minlength=n)
        both = np.intersect1d(stop_a, stop_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, stop_a), np.searchsorted(both, stop_b)
        groups = np.bincount(piece_a[np.searchsorted(stop_a, both)], minlength=n)
        self.counts[at : at + n] = np.column_stack([size_a, size_b, groups, linked, good])
        # the ids of A and then of B of each group, each with the sign that follows it
        last_a, last_b = group_a != np.append(group_a[1:], -1), group_b != np.append(group_b[1:], -1)
        end = piece_b != np.append(piece_b[1:], -1)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = np.concatenate([a, b])[order].tolist()
        sign = np.concatenate([np.where(last_a, 1, 0), np.where(end, 3, np.where(last_b, 2, 0))])[order].tolist()
        piece = np.concatenate([piece_a, piece_b])[order]
        parts = [f"{i}{SIGNS[k]}" for i, k in zip(shown, sign)]
        whole, ends = "".join(parts), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        borders = ends[np.searchsorted(piece, np.arange(n + 1))].tolist()
        self.shown += [whole[x:y] for x, y in zip(borders, borders[1:])]
        while self.filled + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[self.filled : self.filled + len(pairs)] = pairs
        self.pair_at[at + 1 : at + n + 1] = self.filled + np.cumsum(linked)
        self.filled += len(pairs)
        return np.arange(at, at + n)

    def _forget(self, count: int) -> None:
        self.filled = int(self.pair_at[count])
        del self.shown[count:]

    def _cuts(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Begins of the pieces; every text begins one."""
        cut = np.zeros(len(raw), bool)
        if self.blank and len(raw) > 2:
            apart = ~white(raw)
            own = (raw == 32) | (raw == 10) if self.line else raw == 32
            cut[1:-1] = own[1:-1] & apart[:-2] & apart[2:]
            cut[borders[1:] - 1] = False  # the neighbour on the right is another text
        cut[borders[:-1]] = True
        return np.flatnonzero(cut)

    def texts(self, raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts (each with the blank in front): counts per text, digests of groups, and (text, pair, links) of all pairs."""
        begin = self._cuts(raw, borders)
        end = np.append(begin[1:], len(raw))
        keys, first, which = np.unique(W.hashes(raw, begin, end, W.SAME), return_index=True, return_inverse=True)
        numbers = np.fromiter((self.numbers.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        kept, new = len(self.shown), np.flatnonzero(numbers < 0)
        if len(new):
            data = raw.tobytes()
            numbers[new] = self._learn([data[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())])
            if kept < KEPT_PIECES:
                self.numbers.update(zip(keys[new].tolist(), numbers[new].tolist()))
        piece = numbers[which.reshape(-1)]
        at = np.searchsorted(begin, borders)
        counts = np.add.reduceat(self.counts[piece], at[:-1], axis=0)
        good = counts[:, 4] == np.diff(at)
        counts[~good] = 0
        shas = []
        flat = piece.tolist()
        for ok, low, high in zip(good.tolist(), at[:-1].tolist(), at[1:].tolist()):
            shas.append(hashlib.sha256(";".join([self.shown[i] for i in flat[low:high]]).encode()).hexdigest() if ok else "")
        # links by text and pair, from the pieces of each text
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        inside = good[text]
        own, times = np.unique(text[inside] * len(self.shown) + piece[inside], return_counts=True)
        of, kind = np.divmod(own, len(self.shown))
        wide = self.pair_at[kind + 1] - self.pair_at[kind]
        steps = np.repeat(self.pair_at[kind] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        text, pair, times = np.repeat(of, wide), self.pairs[steps], np.repeat(times, wide)
        order = np.lexsort((pair, text))
        text, pair, times = text[order], pair[order], times[order]
        edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])]) if len(text) else np.zeros(0, np.int64)
        links = np.add.reduceat(times, edge) if len(text) else times
        if kept >= KEPT_PIECES:
            self._forget(kept)
        return counts, shas, text[edge], pair[edge], links


@lru_cache(1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _borders(*sorted_: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal rows in columns that are sorted together, and the end."""
    n = len(sorted_[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), n)


def bitmaps(runs: np.ndarray, low: np.ndarray) -> pa.Array:
    """The documents ``low`` (ascending within each run) as one compressed bitmap for each run."""
    sizes = np.diff(runs)
    full = sizes * 2 >= FULL
    if not full.any():  # lists lie one after the other already
        offsets = pa.py_buffer((runs * 2).astype("<i4").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(low.astype("<u2").tobytes())])
    out = []
    for a, b, whole in zip(runs[:-1].tolist(), runs[1:].tolist(), full.tolist()):
        if whole:
            bits = np.zeros(DOCUMENTS, bool)
            bits[low[a:b]] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            out.append(low[a:b].astype("<u2").tobytes())
    return pa.array(out, pa.binary())


def documents_of(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, document) of all set bits."""
    sizes = pc.binary_length(bits).to_numpy(zero_copy_only=False).astype(np.int64)
    full = sizes == FULL
    lists, whole = np.flatnonzero(~full), np.flatnonzero(full)
    flat = b"".join(bits.take(pa.array(lists)).to_pylist())
    of, low = np.repeat(lists, sizes[lists] // 2), np.frombuffer(flat, "<u2").astype(np.int64)
    if len(whole):
        raw = np.frombuffer(b"".join(bits.take(pa.array(whole)).to_pylist()), np.uint8).reshape(len(whole), FULL)
        k, at = np.nonzero(np.unpackbits(raw, axis=1, bitorder="little"))
        of, low = np.concatenate([of, whole[k]]), np.concatenate([low, at])
    return of, low


def _postings(container: int, low: np.ndarray, pair: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one container's entries, one row for each pair and plane."""
    order = np.lexsort((low, pair))
    low, pair, links = low[order], pair[order], links[order]
    for plane in range(int(links.max(initial=0)).bit_length()):
        here = np.flatnonzero(links >> plane & 1)
        own = pair[here]
        runs = _borders(own)
        if len(runs) > 1:
            key = own[runs[:-1]]
            n = len(key)
            yield _made(container=pa.array(np.full(n, container)), a=pa.array((key >> np.uint64(32)).astype(np.int32)), b=pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                        plane=pa.array(np.full(n, plane, np.int32)), bits=bitmaps(runs, low[here]))


def _made(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"kind": pa.int32(), "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(), "bits": pa.binary()}
    names = ("kind", *_DOC, *_POSTING)
    columns["kind"] = pa.array(np.full(n, int("bits" in columns), np.int32))
    return pa.record_batch([columns.get(c, pa.nulls(n, types.get(c, pa.int64()))).cast(types.get(c, pa.int64())) for c in names], list(names))


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(a_path, b_path)
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for container, parts in held.items():
                yield from _postings(container, *(np.concatenate(x) for x in zip(*parts)))
            held.clear()

        for batch in batches:
            raw, borders = W.texts(batch.column(2))
            rows = batch.column(0).to_numpy()
            for low, high in W.slices(borders, SLICE):
                filled = np.flatnonzero(borders[low + 1 : high + 1] > borders[low:high])
                counts, shas = np.zeros((high - low, 4), np.int64), np.full(high - low, "", object)
                if len(filled):
                    at = borders[low : high + 1] - borders[low]
                    part = np.insert(raw[borders[low] : borders[high]], at[:-1][filled], 32)
                    edges = np.append(at[:-1][filled] + np.arange(len(filled)), len(part))
                    got, names, text, pair, links = own.texts(part, edges)
                    counts[filled], shas[filled] = got[:, :4], names
                    place = rows[low:high][filled][text]
                    for container in np.unique(place >> SHIFT).tolist():
                        here = place >> SHIFT == container
                        held.setdefault(container, []).append((place[here] & (DOCUMENTS - 1), pair[here], links[here]))
                    size += len(pair)
                yield _made(row=pa.array(rows[low:high]), doc_id=batch.column(1).slice(low, high - low), **{c: pa.array(counts[:, i]) for i, c in enumerate(_DOC[2:6])},
                            groups_sha256=pa.array(shas, pa.string()))
                # rows come in order, so earlier containers are whole; of one that is too large for memory, bitmaps are written as far as they are
                now = int(rows[high - 1]) >> SHIFT
                if size > ENTRIES or any(c != now for c in held):
                    done = {c: held.pop(c) for c in list(held) if size > ENTRIES or c != now}
                    for container, parts in done.items():
                        size -= sum(len(p[1]) for p in parts)
                        yield from _postings(container, *(np.concatenate(x) for x in zip(*parts)))
        yield from flush()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OR of the bitmaps of each row (columns: keys, array of bitmaps), and how many bits it has."""
    for batch in batches:
        parts = batch.column(4)
        of, low = documents_of(parts.flatten())
        row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[of]
        both = np.unique(row * DOCUMENTS + low)
        row, low = both // DOCUMENTS, both % DOCUMENTS
        runs = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.record_batch([*batch.columns[:4], bitmaps(runs, low), pa.array(np.diff(runs))], [*_POSTING, "documents"])


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the postings of a batch give back to each document: the sum of its links' counts, and its links with a best count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of, low = documents_of(batch.column(2))
        container, plane, count, best = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
        rows, which = np.unique((container[of] << SHIFT) + low, return_inverse=True)
        times = np.int64(1) << plane[of].astype(np.int64)
        sums = np.zeros((2, len(rows)), np.int64)
        np.add.at(sums[0], which.reshape(-1), times * count[of])
        np.add.at(sums[1], which.reshape(-1), times * best[of])
        yield pa.record_batch([pa.array(rows), *map(pa.array, sums)], ["row", "count_sum", "n_best"])


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents and pairs of ``docs`` under the vocabularies of the two files (byte-level A, pieces B).

    Documents, one per row of ``docs``: doc_id, n_a, n_b (tokens of each kind), n_groups (between byte offsets where tokens of both end), n_links
    (token occurrences whose bytes overlap), n_best (links whose pair has the highest count of its id of B, ties
    included), count_sum (of the counts of its links' pairs) and groups_sha256. Pairs: a, b, links (the pair's count), documents, best.

    A blank is put before each text. Special tokens' strings are plain text. Texts that are null, empty, or not given back by the tokens of one
    kind have no tokens: zeros and ''. Repeated rows count each; a row with a null doc_id counts like any other; an empty table gives no rows;
    other columns are not used. Texts are handled whole, in slices of about SLICE bytes; a longer text is a slice of its own.

    One pass over the text writes documents and postings; a posting's container is a range of rows of one task. Shuffles move compressed
    bitmaps. A pair of which all documents have links is spread by container until its bits are counted, and its score
    goes back by SALTS ways.
    """
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = cut_lineage(given.mapInArrow(_align(a_path, b_path), MADE))
    documents = made.filter("kind = 0").select(*_DOC)
    keys = ["container", "a", "b", "plane"]
    parts = made.filter("kind = 1").groupBy(*keys).agg(F.collect_list("bits").alias("bits"))
    whole = parts.mapInArrow(_merged, "container long, a int, b int, plane int, bits binary, documents long")
    postings = cut_lineage(whole.withColumn("salt", F.pmod(F.xxhash64("container"), F.lit(SALTS)).cast("int")))
    links = F.sum(F.col("documents") * F.expr("shiftleft(1L, plane)"))
    salted = cut_lineage(postings.groupBy("a", "b", "salt").agg(links.alias("links")))
    total = salted.groupBy("a", "b").agg(F.sum("links").alias("links"))
    best = total.groupBy("b").agg(F.max("links").alias("most"))
    scored = cut_lineage(total.join(best, "b").select("a", "b", "links", (F.col("links") == F.col("most")).cast("long").alias("best")))
    named = salted.select("a", "b", "salt").join(scored, ["a", "b"])
    back = postings.join(named, ["a", "b", "salt"]).select("container", "plane", "bits", "links", "best")
    # rows of a container next to each other, so that a batch has few documents
    given_back = back.repartition("container", F.shiftright(F.hash("bits"), 30)).sortWithinPartitions("container").mapInArrow(_returned, "row long, count_sum long, n_best long")
    sums = given_back.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    none = F.lit(0).cast("long")
    out = documents.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
    # the union of a pair's planes in a container are its documents there
    held = postings.groupBy("container", "a", "b").agg(F.collect_list("bits").alias("bits")).select("container", "a", "b", F.lit(0).alias("plane"), "bits")
    counted = held.mapInArrow(_merged, "container long, a int, b int, plane int, bits binary, documents long").groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    return out, scored.join(counted, ["a", "b"]).select("a", "b", "links", "documents", F.col("best").cast("boolean").alias("best"))


def op11(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return align(docs, a_path, b_path)[0]

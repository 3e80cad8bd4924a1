"""Near-duplicates by SimHash: fingerprints go to shards that share bits, and each shard's BK-tree finds those within the radius."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .graph import components
from .hot import join_counted

BITS, SEED = 64, 42
#: fingerprints of a shard, about, and at most; a tree of MOST nodes takes about 1.2 MB
ABOUT, MOST = 512, 4_096
#: queries that walk a tree at a time; the walk holds at most SLICE * MOST pairs
SLICE = 256
#: shingles hashed at a time
PIECE = 1 << 16


def fingerprint(raw: bytes, words: int = 4, seed: int = SEED) -> int:
    """Bit i is 1 if it is in over half of the hashes of the text's shingles, repeats included; no words give 0."""
    found = raw.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(sizes + 1) - 1
    begins, ends = (stops - sizes)[: len(found) - words + 1].tolist(), stops[words - 1 :].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(begins), PIECE):
        own = np.array([digest(joined[a:b], seed) for a, b in zip(begins[i : i + PIECE], ends[i : i + PIECE])], "<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begins), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            own = np.fromiter((fingerprint(column[i].as_py() or b"", words) for i in range(len(column))), np.uint64, len(column))
            yield pa.record_batch([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "fingerprint"])

    return run


class Tree:
    """A BK-tree over distinct fingerprints: a node's children are keyed by their distance to it, one child for each distance.

    The tree grows level by level: all fingerprints that are not placed yet go from their present node to its child at their
    distance; the first that finds none becomes it.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        n = len(prints)
        parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rest, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(rest):
            away = np.bitwise_count(prints[rest] ^ prints[at]).astype(np.int64)
            _, first, which = np.unique(at * (BITS + 1) + away, return_index=True, return_inverse=True)
            child = rest[first]
            parent[child], edge[child] = at[first], away[first]
            placed = np.zeros(len(rest), bool)
            placed[first] = True
            at, rest = child[which.reshape(-1)][~placed], rest[~placed]
        # children by parent and distance, and for each node and distance the first child from there on
        keys = parent[1:] * (BITS + 1) + edge[1:]
        order = np.argsort(keys, kind="stable")
        self.children = order + 1
        self.first = np.searchsorted(keys[order], np.arange(n * (BITS + 1) + 1)).astype(np.int32)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, number of the node) of all pairs within the radius, all queries walking down together."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        out = []
        while len(query):
            away = np.bitwise_count(queries[query] ^ self.prints[node]).astype(np.int64)
            near = away <= radius
            out.append((query[near], node[near]))
            # a match below a child differs from this node by the child's distance, give or take the radius
            low = self.first[node * (BITS + 1) + np.maximum(away - radius, 0)]
            high = self.first[node * (BITS + 1) + np.minimum(away + radius, BITS) + 1]
            wide = (high - low).astype(np.int64)
            steps = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            query, node = np.repeat(query, wide), self.children[np.repeat(low, wide) + steps]
        return np.concatenate([q for q, _ in out] or [query]), np.concatenate([x for _, x in out] or [node])


def joined(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct fingerprints of a shard the smallest number of one that it reaches over links inside the shard."""
    tree, label = Tree(prints), np.arange(len(prints))
    for low in range(0, len(prints), SLICE):
        query, node = tree.within(prints[low : low + SLICE], radius)
        query = query + low
        a, b = query[query < node], node[query < node]
        while len(a):
            least = np.minimum(label[a], label[b])
            if (least == label[a]).all() and (least == label[b]).all():
                break
            # hook the larger label of both ends under the smaller one, then shorten
            for side in (label[a], label[b], a, b):
                np.minimum.at(label, side, least)
            while (label[label] != label).any():
                label = label[label]
    return label


def _shard_links(radius: int):
    """Sorted rows (shard, bits, fingerprint) to links that join each shard's components: from each fingerprint to its component's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            borders = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]) if len(keys) else np.zeros(1, np.int64)
            a, b = [], []
            for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
                if high - low > 1:
                    own = prints[low:high]
                    label = joined(own, radius)
                    moved = np.flatnonzero(label != np.arange(len(own)))
                    a.append(own[label[moved]])
                    b.append(own[moved])
            flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
            return pa.record_batch([pa.array(x.view(np.int64)) for x in flat], ["a", "b"])

        for batch in batches:
            keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            prints = batch.column(2).to_numpy().view(np.uint64)
            if held:
                keys, prints = np.concatenate([held[0][0], keys]), np.concatenate([held[0][1], prints])
            # the last shard of a batch may go on in the next; a shard has at most MOST members
            cut = int(np.flatnonzero((keys != keys[-1]).any(1))[-1]) + 1 if len(keys) and (keys != keys[-1]).any() else 0
            if cut:
                yield links(keys[:cut], prints[:cut])
            held = [(keys[cut:], prints[cut:])] if len(keys) else []
        if held:
            yield links(*held[0])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(known: int, parts: int) -> list[list[int]]:
    """The bits outside ``known``, dealt into ``parts`` runs of nearly equal length."""
    free = [b for b in range(BITS) if not known >> b & 1]
    borders = [len(free) * k // parts for k in range(parts + 1)]
    return [free[a:b] for a, b in zip(borders, borders[1:])]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def shards(prints: DataFrame, radius: int) -> DataFrame:
    """(mask, bits, fingerprint): each fingerprint in several shards of at most MOST members that agree in the bits of ``mask``.

    Two fingerprints within the radius differ in at most ``radius`` bits, so of radius + 1 runs of bits one is equal in both: they meet in the shard of that
    run. At first only as many bits of each run count as make shards of about ABOUT members. A shard with too many goes on with the whole run;
    if that is too many still, its members agree in that run and are dealt again by runs of the remaining bits, for which
    the same holds. Every pair within the radius thus meets, and as 2^12 fingerprints at most differ in 12 bits, it ends.
    """
    spark = prints.sparkSession
    n = prints.count()
    width = min(BITS // (radius + 1), max(0, math.ceil(math.log2(max(n, 1) / ABOUT))))
    runs = _parts(0, radius + 1)
    # what is shared in a shard, and what is shared once the whole run is
    rules = [(_mask(r[:width]), _mask(r)) for r in runs] if width else [(0, 0)]

    def dealt(rows: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
        table = spark.createDataFrame([tuple(map(_signed, r)) for r in rules], "of long, mask long, whole long")
        # rules: radius + 1 for each mask of the level before, 5, 25, 125 ...
        return rows.join(F.broadcast(table), "of").select("mask", "whole", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bits"), "fingerprint")

    found, known = None, {w for _, w in rules}
    level = cut_lineage(dealt(prints.withColumn("of", F.lit(0).cast("long")), [(0, m, w) for m, w in rules]))
    while True:
        sizes = level.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("members"))
        large = cut_lineage(sizes.filter(F.col("members") > MOST).select("mask", "bits"))
        good = level.join(large, ["mask", "bits"], "left_anti").select("mask", "bits", "fingerprint")
        found = good if found is None else found.unionByName(good)
        if large.limit(1).count() == 0:
            return found
        rest = level.join(large, ["mask", "bits"], "left_semi")
        short = rest.filter("mask != whole").select(F.col("whole").alias("of"), "fingerprint")
        full = rest.filter("mask = whole").select("whole", "fingerprint")
        narrow = [(w, w, w) for w in known]
        deeper = [(w, w | _mask(r), w | _mask(r)) for w in known for r in _parts(w, radius + 1) if r]
        first = dealt(short, narrow)
        level = cut_lineage(first.unionByName(dealt(full.withColumnRenamed("whole", "of"), deeper)))
        known |= {w for _, _, w in deeper}


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (64 bits as a signed long) and component_id (smallest doc_id reachable over links).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles of ``words`` words, joined by one blank, repeats included, are hashed with XXH64
    (seed 42); fewer words are one shingle. A fingerprint's bit is 1 if it is set in over half the hashes. Null and empty texts
    have the fingerprint 0 and are linked like any other. Fingerprints that differ in ``radius`` bits or fewer are linked.
    Repeated rows and copies share a fingerprint and thus a component; a null doc_id counts for no component's name, and a component without
    any other id has a null name; an empty table gives no rows; other columns are not used.

    Equal fingerprints become one node first, with a map-side combine. Nodes are dealt to shards (:func:`shards`); a task builds the BK-tree of each of
    its shards and walks it with the shard's fingerprints, following only edges within the radius, and returns at most one link per
    member: those that join the shard's components. A tree goes where its shard's fingerprints are by the shuffle: sent from the driver, the trees together would be
    all fingerprints.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = cut_lineage(given.mapInArrow(_fingerprints(words), "doc_id long, fingerprint long"))
    nodes = cut_lineage(base.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")))
    dealt = shards(nodes.select("fingerprint"), radius).repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fingerprint")
    found = components(cut_lineage(dealt.mapInArrow(_shard_links(radius), "a long, b long").distinct()))
    named = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    names = join_counted(named.select("fingerprint", "component", "rows"), least.join(sizes, "component"), ["component"]).select("fingerprint", "component_id", "rows")
    return join_counted(base, names, ["fingerprint"]).select("doc_id", "fingerprint", "component_id")


def op12(docs: DataFrame) -> DataFrame:
    """Contract: shingles of four words."""
    out = near_duplicates(docs, words=4)
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))

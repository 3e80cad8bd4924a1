"""Near-duplicates by b-bit MinHash: band keys from full minima, packed low bits to estimate, full shingle sets to confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import held, words as W
from .graph import components

#: 24 bands of 5 minima: a pair with a similarity of 0.85 misses all bands with a probability below 1e-6
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: low bits of each minimum that are kept to estimate with
BITS = 4
#: five standard deviations of the estimate lie between a pair at the threshold and one that is not confirmed
MARGIN = 5.0
#: rows with a text's set, or what is left of it, that one file takes
SETS_PER_FILE = 5_000
#: members of an open bucket that are compared with as many others at a time
CHUNK = 512

_U = np.uint64
_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 1 << 62, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PART = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(raw: np.ndarray, borders: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per text its distinct shingles of ``size`` words as ascending 64-bit hashes; fewer words are one shingle; none, an empty set."""
    begin, end, at = W.spans(raw, borders)
    h = W.hashes(raw, begin, end)
    joined = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        joined = joined * _PART[0] + W.mix(h[k : k + len(joined)] ^ _PART[1])
    joined = W.mix(joined)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in h[a:b]:
                short = short * _PART[2] + x
            yield W.mix(short)
        else:
            yield np.zeros(0, np.uint64)


def minima(own: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function, as 32-bit numbers."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(own), 2048):
        values = (own[None, i : i + 2048] * _MUL[:, None] + _ADD[:, None]) >> _U(32)
        np.minimum(out, values.min(axis=1).astype(np.uint32), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64) * _PART[3]
    for k in range(ROWS):
        keys = W.mix(keys * _PART[0] + low.reshape(BANDS, ROWS)[:, k].astype(np.uint64))
    return keys.view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The low BITS of every minimum, two to a byte."""
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (bits[0::2] | (bits[1::2] << 4)).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis), corrected for low bits that agree by chance."""
    x = a ^ b
    same = HASHES - (((x & 15) != 0).sum(-1) + ((x >> 4) != 0).sum(-1))
    chance = 1 / (1 << BITS)
    return (same / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * threshold
    return threshold - MARGIN * np.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.only("minhash")
        for batch in batches:
            raw, borders = W.texts(batch.column(1))
            n, node, keys, bits = [], [], [], []
            for low, high in W.slices(borders):
                for own in shingles(raw[borders[low] : borders[high]], borders[low : high + 1] - borders[low], size):
                    n.append(len(own))
                    if len(own):
                        m = minima(own)
                        node.append(_node(own))
                        keys.append(band_keys(m).tolist())
                        bits.append(packed(m))
                    else:
                        node.append(None), keys.append(None), bits.append(None)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "node", "bands", "bits"],
            )

    return run


def _node(own: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    total = W.mix(own ^ _PART[2]).sum(keepdims=True) + np.array([len(own)], np.uint64) * _PART[1]
    return int(W.mix(total).view(np.int64)[0])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.only("minhash")
        for batch in batches:
            raw, borders = W.texts(batch.column(1))
            wanted, names, out = batch.column(0).to_pylist(), [], []
            for low, high in W.slices(borders):
                part = shingles(raw[borders[low] : borders[high]], borders[low : high + 1] - borders[low], size)
                for node, own in zip(wanted[low:high], part):
                    if len(own) and _node(own) == node:  # an id may stand for several texts
                        names.append(node)
                        out.append(own.tobytes())
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(out, pa.large_binary())], ["node", "shingles"]).cast(
                pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
            )

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.only("minhash")
        for batch in batches:
            good, last = [], (None, None)
            x, y = batch.column(2), batch.column(3)
            for i, a in enumerate(batch.column(0).to_pylist()):
                if last[0] != a:
                    last = (a, np.frombuffer(x[i].as_buffer(), np.uint64))
                p, q = last[1], np.frombuffer(y[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], ["a", "b"])

    return run


def _sides(pdf):
    """The two chunks of a group: names, components, packed bits and band keys of their members, and whether they are the same chunk."""
    held.only("minhash")
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    pdf = pdf.sort_values("node", ignore_index=True)
    parts = [pdf[pdf["chunk"] == c] for c in ((i,) if i == j else (i, j))]
    read = [(p, p["component"].to_numpy(), np.frombuffer(b"".join(p["bits"]), np.uint8).reshape(len(p), -1), np.stack(list(p["bands"])) if len(p) else np.zeros((0, BANDS), np.int64)) for p in parts]
    return read[0], read[-1], i == j


def _partners(k: int, left, right, same: bool, bucket: int, least: float, component: np.ndarray, own: int) -> np.ndarray:
    """Members of the right chunk that may be linked with the k-th of the left: apart so far, alike by their bits, and with this
    bucket as the first that both are in, so that a pair is looked at once."""
    rest = slice(k + 1, None) if same else slice(None)
    found = np.flatnonzero((component[rest] != own) & (estimate(left[2][k], right[2][rest]) >= least)) + (k + 1 if same else 0)
    if not len(found):
        return found
    first = (right[3][found] == left[3][k]).argmax(1)
    return found[left[3][k][first] == bucket]


OPEN = "bucket long, i int, j int, chunk int, node long, component long, bits binary, bands array<long>"


def _open_members(least: float):
    """The members of a group that are in any pair still to be counted."""

    def run(pdf):
        left, right, same = _sides(pdf)
        bucket, open_ = int(pdf["bucket"].iloc[0]), [np.zeros(len(left[0]), bool), np.zeros(len(right[0]), bool)]
        for k in range(len(left[0])):
            found = _partners(k, left, right, same, bucket, least, right[1], left[1][k])
            open_[0][k] |= len(found) > 0
            open_[1][found] = True
        if same:
            return left[0][open_[0] | open_[1]]
        import pandas as pd

        return pd.concat([left[0][open_[0]], right[0][open_[1]]])

    return run


def _links(least: float, percent: int):
    """Links between members of a group that are apart, counted on full sets; of those that join the same two components one is enough."""

    def run(pdf):
        import pandas as pd

        left, right, same = _sides(pdf)
        bucket, out = int(pdf["bucket"].iloc[0]), []
        sets = [[np.frombuffer(x, np.uint64) for x in side[0]["shingles"]] for side in (left, right)]
        mine, theirs = left[1].copy(), right[1] if not same else None
        theirs = mine if same else theirs.copy()
        for k in range(len(sets[0])):
            found = _partners(k, left, right, same, bucket, least, theirs, mine[k])
            if not len(found):
                continue
            own, others = sets[0][k], [sets[1][f] for f in found]
            sizes = np.array([len(x) for x in others])
            flat = np.concatenate(others)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for f in found[100 * both >= percent * (len(own) + sizes - both)].tolist():
                if theirs[f] != mine[k]:
                    a, b = int(left[0]["node"].iloc[k]), int(right[0]["node"].iloc[f])
                    out.append((min(a, b), max(a, b)))
                    low, high = mine[k], theirs[f]
                    mine[mine == high] = low
                    theirs[theirs == high] = low
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text's set is that of its distinct shingles of ``words`` words. Texts are linked
    if 100 * intersection >= percent * union, counted on full sets (64-bit hashes of shingles). Null and empty texts
    have an empty set and are linked with nothing; repeated rows share a component; an empty table gives no rows; a row with a
    null doc_id has a null component if nothing with an id is linked to it, and kept is then true.

    Equal sets become one node first, so copies are never paired. Of each bucket one member, drawn by hash, is compared with all
    others: one pair per member. Where members of a bucket of three or more are still apart after that, its members are
    compared in chunks by their packed bits; those with a likely partner meet again with their full sets, and what a
    group returns is no list of pairs, but as many links as join its components. No pair is left out, whatever its bucket's size.
    """
    least = least_estimate(percent / 100)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    given = given.withColumn("text_hash", F.xxhash64("text"))
    base = cut_lineage(given.mapInArrow(_signatures(words), "doc_id long, text_hash long, n_shingles long, node long, bands array<long>, bits binary"))
    rows = base.count()
    one_text = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = cut_lineage(
        base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), one_text.alias("of"), F.first("bands").alias("bands"), F.first("bits").alias("bits")),
        rows, SETS_PER_FILE,
    )
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    centre = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node")).alias("c"))
    centre = centre.filter("members > 1").select("bucket", "members", F.col("c.node").alias("centre"))
    member = cut_lineage(member.join(centre, "bucket"), rows * BANDS)

    bits = nodes.select("node", "bits")
    stars = member.filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    likely = _likely(stars, bits, least)
    # sets of everything that shares a bucket, as these may be asked for again
    wanted = member.select("node").distinct().join(nodes.select("node", F.col("of.doc_id").alias("of_id"), F.col("of.text_hash").alias("of_text")), "node")
    theirs = given.join(wanted, given["doc_id"].eqNullSafe(wanted["of_id"]) & (given["text_hash"] == wanted["of_text"])).select("node", "text")
    sets = cut_lineage(theirs.mapInArrow(_sets(words), "node long, shingles binary").dropDuplicates(["node"]), rows, SETS_PER_FILE)
    links = cut_lineage(_counted(likely, sets, percent), rows * BANDS)
    found = components(links)

    # buckets whose members are not all together yet
    labelled = member.filter("members > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("bucket")
    still = cut_lineage(labelled.join(apart, "bucket", "left_semi").select("bucket", "node", "members", "component"), rows * BANDS)
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    marked = still.join(nodes.select("node", "bits", "bands"), "node").withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("node"), chunks).cast("int")})
    spread = marked.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": F.least("chunk", "k"), "j": F.greatest("chunk", "k")})
    dealt = spread.select("bucket", "i", "j", "chunk", "node", "component", "bits", "bands")
    open_ = cut_lineage(dealt.groupBy("bucket", "i", "j").applyInPandas(_open_members(least), OPEN))
    more = open_.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(_links(least, percent), "a long, b long")
    found = components(links.unionByName(cut_lineage(more)))

    # names of components: the smallest doc_id of any row with one of its sets
    named = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = named.select("node", "component").join(smallest, "component").select("node", "component_id")
    out = base.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _likely(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """Pairs whose packed bits agree in enough places."""
    both = pairs.join(bits.withColumnRenamed("node", "a").withColumnRenamed("bits", "x"), "a").join(
        bits.withColumnRenamed("node", "b").withColumnRenamed("bits", "y"), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.only("minhash")
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                good = pa.array(estimate(x, y) >= least)
                yield pa.record_batch([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    first, second = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 85)

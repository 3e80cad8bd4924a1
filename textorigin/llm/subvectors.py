"""Centroid clustering over subvector dictionaries: distinct subvectors of dimension blocks, their exact distances once a round, sums by code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage

#: dimensions of a block; wider blocks have more distinct subvectors, and soon as many as vectors
WIDTH = 2
#: vectors that share dictionaries; a code then fits 16 bits, and a chunk of 64 dimensions takes about 1 MB
CHUNK = 8_192
#: a component's largest size as an integer, so that sums of 64 squared differences fit 64 bits
LARGEST = 1 << 27

CHUNKS = "ids array<long>, codes binary, sizes array<int>, entries binary"


def _kept(vector: Column, dimensions: int) -> Column:
    """True for vectors of the right length without null, NaN and infinite components."""
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _integers(vector: Column, scale: int) -> Column:
    bound = F.when(F.abs(vector) < LARGEST / scale, F.floor(vector * scale))
    return bound.otherwise(F.raise_error(F.lit(f"a component of {LARGEST // scale} or more: squared distances would not fit 64 bits"))).cast("long")


def _encode(dimensions: int, width: int):
    """Rows of (id, integers) to chunks: per block the distinct subvectors, and each vector's codes."""

    def chunk(ids: list[int | None], values: np.ndarray) -> pa.RecordBatch:
        codes, sizes, entries = [], [], []
        for low in range(0, dimensions, width):
            distinct, which = np.unique(values[:, low : low + width], axis=0, return_inverse=True)
            codes.append(which.reshape(-1).astype("<u2").tobytes())
            sizes.append(len(distinct))
            entries.append(distinct.astype("<i4").tobytes())
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(codes)], pa.binary()), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(entries)], pa.binary())]
        return pa.record_batch(columns, ["ids", "codes", "sizes", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0
        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimensions)
            for low in range(0, batch.num_rows, CHUNK):
                part = own[low : low + CHUNK]
                if held + len(part) > CHUNK:
                    yield chunk(ids, np.concatenate(values))
                    ids, values, held = [], [], 0
                ids += batch.column(0)[low : low + CHUNK].to_pylist()
                values.append(part)
                held += len(part)
        if held:
            yield chunk(ids, np.concatenate(values))

    return run


def _blocks(row: dict, width: int, dimensions: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, dictionary, codes) of every block of a chunk."""
    n, at = len(row["ids"]), 0
    for k, low in enumerate(range(0, dimensions, width)):
        own = min(width, dimensions - low)
        size = row["sizes"][k] * own
        entries = np.frombuffer(row["entries"], "<i4", size, 4 * at).reshape(-1, own).astype(np.int64)
        at += size
        yield low, entries, np.frombuffer(row["codes"], "<u2", n, 2 * n * k)


def _nearest(row: dict, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, per vector of a chunk."""
    total = np.zeros((len(row["ids"]), len(centroids)), np.int64)
    for low, entries, codes in _blocks(row, width, centroids.shape[1]):
        off = entries[:, None, :] - centroids[None, :, low : low + entries.shape[1]]
        total += (off * off).sum(2)[codes]
    best = total.argmin(1)  # the first of equal ones
    return best, total[np.arange(len(best)), best]


def _sums(shared, width: int):
    """Per centroid of a task's vectors: their number (dimension -1) and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        k, dimensions = centroids.shape
        sums, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                best, _ = _nearest(row, centroids, width)
                count += np.bincount(best, minlength=k)
                for low, entries, codes in _blocks(row, width, dimensions):
                    of = np.bincount(best * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
                    sums[:, low : low + entries.shape[1]] += of @ entries
        flat = np.column_stack([count, sums]).reshape(-1)
        at = np.arange(len(flat))
        yield pa.record_batch([pa.array(at // (dimensions + 1), pa.int32()), pa.array(at % (dimensions + 1) - 1, pa.int32()), pa.array(flat)], ["cluster", "dimension", "total"])

    return run


def _assign(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                best, distance = _nearest(row, shared.value, width)
                yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


RESULT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
    T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType())),
])


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1, width: int = WIDTH,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per kept row of ``vectors``: vec_id, cluster, distance (squared), cluster_inertia, inertia and ``centroid`` (its components).

    Kept are vectors of ``dimensions`` components, none null, NaN or infinite; a null vector is not kept. Component x becomes the integer
    floor(scale * x). Centroids start as the ``clusters`` rows with the smallest sha256 of ``seed:vec_id`` (null ids last, equal
    ids by their components); fewer rows give fewer centroids. Each round assigns every vector to its nearest centroid (ties: the smaller number) and moves each
    centroid that has vectors to the exact floor of their mean; at the end they are assigned once more. A row with a null id takes part and comes back with
    it; repeated rows are rows of their own; an empty table gives no rows; other columns, whatever their names, are not
    returned. A component of 2^27 / scale or more in size is an error, as squared distances would not fit the result.

    Vectors are encoded once, without loss: a chunk of up to CHUNK rows of a task keeps, per block of ``width`` dimensions, its distinct
    subvectors and a 16-bit code per row. A round computes the distances of the distinct subvectors to all centroids, sums them by
    code, and gets the sums of the components from counts of codes. No vector is shuffled; a round moves clusters * (dimensions + 1)
    numbers per task, combined before the shuffle, and the driver holds the centroids only. Chunks are written to the shared folder, so a lost executor costs
    a re-read.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).filter(_kept(F.col("e"), dimensions))
    given = given.select("vec_id", F.transform("e", lambda x: _integers(x, scale)).alias("e"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = given.withColumn("h", name).orderBy(F.col("h").asc_nulls_last(), "e").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r["e"] for r in first], np.int64)
    chunks = cut_lineage(given.mapInArrow(_encode(dimensions, width), CHUNKS))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)  # clusters * dimensions numbers
        parts = chunks.mapInArrow(_sums(shared, width), "cluster int, dimension int, total long")
        got = parts.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r["cluster"], r["dimension"]): int(r["total"]) for r in got}
        centroids = np.array([[total[k, d] // total[k, -1] for d in range(dimensions)] if total[k, -1] else c.tolist() for k, c in enumerate(centroids)], np.int64)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(centroids)
    assigned = cut_lineage(chunks.mapInArrow(_assign(shared, width), "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["x"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    rows = [(k, inertia.get(k, 0), sum(inertia.values()), c.tolist()) for k, c in enumerate(centroids)]
    of = spark.createDataFrame(rows, "k int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(of), F.col("cluster") == F.col("k")).drop("k")  # one row per centroid


def digest(components: Column) -> Column:
    return F.sha2(F.array_join(F.transform(components, lambda x: x.cast("string")), ","), 256)


def op13(vectors: DataFrame) -> DataFrame:
    return cluster(vectors).withColumn("centroid_sha256", digest(F.col("centroid"))).drop("centroid")

"""Exact quantiles of many columns by radix selection: a few narrow passes count the leading bits of the values, no cell is shuffled.

A double becomes a 64-bit key of the same order. The first pass counts the values of each column by the key's first 12 bits; that
tells the bucket of every wanted rank. Each further pass counts, inside these buckets only, by the next 13 bits, until
few values are left in them; these are fetched. What a pass returns is bounded by columns x ranks x buckets, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.batches import slices

FIRST, NEXT = 12, 13
#: a bucket with so many values is fetched instead of being cut further
FEW = 256
#: elements of arrays that are counted at a time
ELEMENTS = 1 << 16
_TOP = np.uint64(1 << 63)


def keys_of(values: np.ndarray) -> np.ndarray:
    """64-bit unsigned keys in the order of the values; NaN is the largest, and both zeros are one."""
    x = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def values_of(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys & _TOP, keys ^ _TOP, ~keys).view(np.float64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of plain rows: of columns of arrays, equally long in a row, each element is one."""
    for batch in batches:
        if not pa.types.is_list(batch.column(1).type):
            yield batch
            continue
        for low, high in slices(batch.column(1), ELEMENTS):
            part = batch.slice(low, high - low)
            of = pc.list_parent_indices(part.column(1))
            yield pa.record_batch([part.column(0).take(of), *(c.flatten() for c in part.columns[1:])], batch.schema.names)


def _matrix(batch: pa.RecordBatch, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group numbers, keys (rows x columns) and where there is a value."""
    group = batch.column(0).to_numpy()
    there = np.column_stack([batch.column(i + 1).is_valid().to_numpy(zero_copy_only=False) for i in range(columns)])
    values = np.column_stack([batch.column(i + 1).fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(columns)])
    return group, keys_of(values), there


def _counted(columns: int, bits: int, shift: int, wanted: np.ndarray | None):
    """Rows (cell = group x columns + column, key, n): the values of each cell by their leading bits, inside the ``wanted`` prefixes if given.

    ``wanted`` has for each group, column and rank the prefix of ``bits`` bits that counts; a shift of -1 returns whole keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            if not batch.num_rows:
                continue
            group, keys, there = _matrix(batch, columns)
            if wanted is not None:
                prefix = keys >> np.uint64(64 - bits)
                inside = np.zeros(keys.shape, bool)
                for rank in range(wanted.shape[2]):
                    inside |= prefix == wanted[group, :, rank]
                there &= inside
            row, column = np.nonzero(there)
            cell = group[row].astype(np.int64) * columns + column
            key = keys[row, column] >> np.uint64(max(shift, 0))
            order = np.lexsort((key, cell))
            cell, key = cell[order], key[order]
            new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])]) if len(cell) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(cell)))
            yield pa.record_batch([pa.array(cell[new]), pa.array(key[new].view(np.int64)), pa.array(n)], ["cell", "key", "n"])

    return run


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], group: str | None = None, groups: Sequence[str] = ("",)) -> dict[tuple[str, str], list[float] | None]:
    """{(group, column): interpolated quantiles, or None without values}, on the driver: meant for few groups, named in ``groups``.

    Nulls do not count, NaN is the largest value. Without ``group`` all rows are one group, named ''. Columns may be arrays, all of them and of
    equal lengths in a row: then their elements are the values.
    """
    groups = list(groups) if group else [""]
    number = F.array_position(F.lit(groups), F.col(group)).cast("int") - 1 if group else F.lit(0)
    lists = any(df.schema[c].dataType.typeName() == "array" for c in cols)
    given = df.select(number.alias("_g"), *[F.col(c).cast("array<double>" if lists else "double").alias(f"c{i}") for i, c in enumerate(cols)])
    if group:
        given = given.filter("_g >= 0")
    width, cells = len(cols), len(groups) * len(cols)

    def counts(bits: int, shift: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = given.mapInArrow(_counted(width, bits, shift, wanted), "cell long, key long, n long").groupBy("cell", "key").agg(F.sum("n").alias("n")).toArrow()
        cell, key, n = (found.column(i).to_numpy() for i in range(3))
        key = key.view(np.uint64)
        order = np.lexsort((key, cell))
        return cell[order], key[order], n[order]

    if not cells:
        return {}
    cell, key, n = counts(0, 64 - FIRST, None)
    total = np.bincount(cell, n, cells).astype(np.int64)
    # the ranks below and above each quantile's place
    place = [[(t - 1) * float(p) for p in probs] for t in total.tolist()]
    rank = np.array([[r for h in own for r in (max(0, math.floor(h)), max(0, math.ceil(h)))] for own in place], np.int64).reshape(cells, -1)
    prefix, bits = np.zeros(rank.shape, np.uint64), FIRST

    def settle(cell: np.ndarray, key: np.ndarray, n: np.ndarray, parents: np.ndarray | None, step: int) -> np.ndarray:
        """Move each rank to its bucket among those of its parent, which has ``step`` bits less; returns how many values the buckets hold."""
        held = np.zeros(rank.shape, np.int64)
        borders = np.searchsorted(cell, np.arange(cells + 1))
        for c in range(cells):
            own, size = key[borders[c] : borders[c + 1]], n[borders[c] : borders[c + 1]]
            above = own >> np.uint64(step)
            for j in range(rank.shape[1] if total[c] else 0):
                low, high = 0, len(own)
                if parents is not None:
                    low, high = (np.searchsorted(above, parents[c, j], side) for side in ("left", "right"))
                upto = np.cumsum(size[low:high])
                k = int(np.searchsorted(upto, rank[c, j], "right"))
                prefix[c, j], held[c, j] = own[low + k], size[low + k]
                rank[c, j] -= upto[k] - size[low + k]
        return held

    held = settle(cell, key, n, None, 0)
    while bits < 64 and held.max(initial=0) > FEW:
        shift = 64 - bits - NEXT
        cell, key, n = counts(bits, shift, prefix.reshape(len(groups), width, -1))
        held = settle(cell, key, n, prefix.copy(), NEXT)
        bits += NEXT
    if bits < 64:
        cell, key, n = counts(bits, -1, prefix.reshape(len(groups), width, -1))
        settle(cell, key, n, prefix.copy(), 64 - bits)
    value = values_of(prefix)
    out: dict[tuple[str, str], list[float] | None] = {}
    for c in range(cells):
        name = groups[c // width], cols[c % width]
        low, high = value[c, 0::2].tolist(), value[c, 1::2].tolist()
        out[name] = [a if a == b else a + (b - a) * (h - math.floor(h)) for a, b, h in zip(low, high, place[c])] if total[c] else None
    return out

"""Joins of a large table with one row per key, where a few keys may hold most of the large table's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

#: a key is hot if it has more than this share of all rows; so there are at most 1 / HOT hot keys
HOT = 1 / 1_000


def join_counted(rows: DataFrame, named: DataFrame, keys: Sequence[str], count: str = "rows") -> DataFrame:
    """Inner join of ``rows`` with ``named`` (one row per key, with the number ``count`` of the key's rows), no key in one task.

    Rows of hot keys get their partner from a broadcast of at most 1 / HOT rows and stay where they are; all others are
    joined by a shuffle, in which no key has more than the share HOT. Keys are not null. ``count`` is not returned.
    """
    named = cut_lineage(named)
    total = named.agg(F.sum(count)).first()[0] or 0
    hot = named.filter(F.col(count) > total * HOT).drop(count)
    cold = named.filter(F.col(count) <= total * HOT).drop(count)
    few = rows.join(F.broadcast(hot), list(keys))
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return few.unionByName(rest)

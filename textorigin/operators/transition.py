"""State-transition profiles of a value sequence.

Everything the profile needs follows from the counts of neighbouring state pairs and the first state, so a
document costs one pass over its array and a long table one aggregation; runs are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import arrays as A
from ..functions.batches import slices
from ..functions.fixed_values import STATE_COUNTS
from .ranking import lagged, quantiles

SUMMARY = (
    "transition_entropy", "self_transition_rate", "upward_transition_rate", "downward_transition_rate", "large_jump_rate",
    "high_loss_burst_density", "low_loss_run_length_mean", "high_loss_run_length_mean", "state_sequence_entropy",
    "transition_spectral_gap", "token_count",
)


def finite_values(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def z_scores(a: Column) -> Column:
    """(x - mean) / std (population; 1 where it is 0) inside an array, to 6 digits so that equal values stay equal."""
    std = lambda s: F.when(s["std"] > 0, s["std"]).otherwise(F.lit(1.0))
    return A.let(a, lambda v: A.let(A.mean_std(v), lambda s: F.transform(v, lambda x: F.round((x - s["mean"]) / std(s), 6) + F.lit(0.0))))


def fit_bins(df: DataFrame, values: Sequence[str], states: Sequence[int] = STATE_COUNTS) -> dict[str, dict[int, list[float]]]:
    """Inner quantile cut points per column over all rows of a (training) table, as a few driver-side numbers.

    A constant or empty column has no cut points.
    """
    probs = sorted({i / n for n in states for i in range(1, n)} | {0.0, 1.0})
    found = {r["feature"]: dict(zip(probs, r["quantiles"])) for r in quantiles(df, values, probs).collect() if r["quantiles"]}

    def cuts(name: str, n: int) -> list[float]:
        q = found.get(name)
        return [] if not q or q[0.0] is None or q[0.0] == q[1.0] else [q[i / n] for i in range(1, n)]

    return {v: {n: cuts(v, n) for n in states} for v in values}


def bin_state(x: Column, bins: Sequence[float]) -> Column:
    """How many cut points are at or below ``x``; 0 without cut points."""
    return sum(((x >= F.lit(float(b))).cast("int") for b in bins), F.lit(0))


def states_from_bins(a: Column, bins: Sequence[float]) -> Column:
    return F.transform(a, lambda x: bin_state(x, bins))


def states_from_own_quantiles(a: Column, n: int) -> Column:
    """States by the quantiles of the array itself; all 0 for a constant array."""
    def cut(s, q):
        h = (F.size(s) - 1) * F.lit(q)
        lo, hi = F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))
        return lo + (hi - lo) * (h - F.floor(h))

    def encode(v, s):
        cuts = F.array(*[cut(s, i / n) for i in range(1, n)])
        flat = F.get(s, F.lit(0)) == F.element_at(s, -1)
        return A.let(cuts, lambda c: F.transform(v, lambda x: F.when(flat, 0).otherwise(sum(((x >= F.get(c, F.lit(i))).cast("int") for i in range(n - 1)), F.lit(0)))))

    return F.when(F.size(a) > 0, A.let(a, lambda v: A.let(F.sort_array(v), lambda s: encode(v, s)))).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class Coding:
    """How the states of one encoding follow from an array column: by ``cuts`` of its values (``bins``) or of its z-scores (``z_bins``), by its own
    quantiles (``quantiles``), by its percent rank (``rank``; ``falling``: the largest value first), or as they are (``given``)."""

    column: str
    states: int
    kind: str
    cuts: tuple[float, ...] = ()


class _Batch:
    """The values of a slice of documents, one after the other, and what several encodings need of them."""

    def __init__(self, column: pa.Array):
        self.sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.x = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.n = len(self.sizes)
        self.of = np.repeat(np.arange(self.n), self.sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes

    @cached_property
    def z(self) -> np.ndarray:
        """(x - mean) / std (population; 1 where it is 0), to 6 digits so that equal values stay equal."""
        size = np.maximum(self.sizes, 1)
        off = self.x - (np.bincount(self.of, self.x, self.n) / size)[self.of]
        std = np.sqrt(np.bincount(self.of, off * off, self.n) / size)
        return np.round(off / np.where(std > 0, std, 1.0)[self.of], 6) + 0.0

    @cached_property
    def order(self) -> np.ndarray:
        return np.lexsort((self.x, self.of))

    def rank(self, falling: bool) -> np.ndarray:
        """Rank over the document's length, ties averaged."""
        x, of = self.x[self.order], self.of[self.order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(x)))
        before = first - self.begins[of[first]]
        if falling:
            before = self.sizes[of[first]] - before - size
        out = np.empty(len(x))
        out[self.order] = np.repeat((before * 2 + size + 1) / 2.0 / self.sizes[of[first]], size)
        return out

    def own_cuts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner quantiles of each document, and whether all its values are equal."""
        if not len(self.x):
            return np.zeros((self.n, n - 1)), np.ones(self.n, bool)
        s, last = self.x[self.order], np.maximum(self.sizes - 1, 0)
        at = lambda k: s[np.minimum(self.begins + k, len(s) - 1)]
        cuts = []
        for i in range(1, n):
            h = last * (i / n)
            low, high = at(np.floor(h).astype(np.int64)), at(np.ceil(h).astype(np.int64))
            cuts.append(low + (high - low) * (h - np.floor(h)))
        return np.column_stack(cuts), at(0 * last) == at(last)

    def coded(self, c: Coding) -> np.ndarray:
        if c.kind in ("bins", "z_bins"):
            return np.searchsorted(np.asarray(c.cuts, float), self.x if c.kind == "bins" else self.z, side="right")
        if c.kind in ("rank", "falling"):
            return np.clip(np.floor(self.rank(c.kind == "falling") * c.states), 0, c.states - 1).astype(np.int64)
        if c.kind == "quantiles":
            cuts, flat = self.own_cuts(c.states)
            return np.where(flat[self.of], 0, (self.x[:, None] >= cuts[self.of]).sum(1))
        return self.x.astype(np.int64)

    def pairs(self, state: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of neighbouring pairs, and the first state (-1 without any)."""
        same = self.of[1:] == self.of[:-1]
        codes = (self.of[1:] * n * n + state[:-1] * n + state[1:])[same]
        first = np.full(self.n, -1)
        first[self.sizes > 0] = state[self.begins[self.sizes > 0]]
        return np.bincount(codes, minlength=self.n * n * n).reshape(self.n, n, n), first


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Base-2 entropy along the last axis; nan where all counts are 0."""
    total = counts.sum(1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros(counts.shape), where=total > 0)
    return np.where(total[:, 0] > 0, -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1), np.nan)


def rates(pairs: np.ndarray, first: np.ndarray, size: np.ndarray, with_gap: bool) -> list[np.ndarray]:
    """All profile values of documents, in the order of :func:`names`, from their pair counts, first state and length; nan is null."""
    n = pairs.shape[1]
    i, j = np.indices((n, n))
    some, moved = size > 0, size > 1
    steps = np.where(moved, size - 1, 1).astype(float)
    per_step = lambda mask: np.where(moved, pairs[:, mask].sum(1) / steps, np.nan)
    seen = pairs.sum(1) + (first[:, None] == np.arange(n))

    def run_mean(k: int) -> np.ndarray:
        runs = (first == k) + pairs[:, (j == k) & (i != k)].sum(1)
        return np.where(some, np.divide(seen[:, k], runs, out=np.zeros(len(size)), where=runs > 0), np.nan)

    out = [np.where(moved, pairs[:, a, b] / steps, np.nan) for a in range(n) for b in range(n)]
    out += [_entropy(pairs.reshape(len(size), -1)), per_step(i == j), per_step(j > i), per_step(j < i), per_step(abs(i - j) >= 2),
            np.where(some, seen[:, n - 1] / np.maximum(size, 1), np.nan), run_mean(0), run_mean(n - 1), np.where(some, _entropy(seen), np.nan)]
    if with_gap:
        rows = pairs.sum(2, keepdims=True)
        share = np.divide(pairs, rows, out=np.zeros(pairs.shape), where=rows > 0)
        moduli = np.sort(np.abs(np.linalg.eigvals(share)), axis=1) if len(share) else np.zeros((0, n))
        out.append(np.where(some, 1.0 - moduli[:, -2], np.nan))
    return [*out, np.where(some, size.astype(float), np.nan)]


def names(prefix: str, n: int, with_gap: bool) -> list[str]:
    return [*(f"{prefix}_trans_{i}_to_{j}" for i in range(n) for j in range(n)), *(f"{prefix}_{k}" for k in SUMMARY if with_gap or k != "transition_spectral_gap")]


#: steps handled at a time
SLICE = 1 << 19


def _numbers(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in columns]


def coded_profiles(df: DataFrame, codings: dict[str, Coding] | dict[str, dict[str, Coding]], key: str = "id", with_gap: bool = True, name: str | None = None) -> DataFrame:
    """Profile of several encodings ``{prefix: coding}`` per row of ``df``: one narrow pass over the arrays, no shuffle.

    With ``name``, ``codings`` has such a dictionary for each value of a new column of that name, and every row comes back once for each: a
    sequence is read once, however many sets of cut points it is coded by.
    """
    sets = codings if name else {"": codings}
    columns = sorted({c.column for own in sets.values() for c in own.values()})
    heads = [h for p, c in next(iter(sets.values())).items() for h in names(p, c.states, with_gap)]
    fields = [df.schema[key], *([T.StructField(name, T.StringType())] if name else []), *(T.StructField(h, T.DoubleType()) for h in heads)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                part = batch.slice(low, high - low)
                own = {c: _Batch(part.column(i + 1)) for i, c in enumerate(columns)}
                done: dict[Coding, list[pa.Array]] = {}
                for label, codes in sets.items():
                    for c in codes.values():
                        if c not in done:
                            b = own[c.column]
                            done[c] = _numbers(rates(*b.pairs(b.coded(c), c.states), b.sizes, with_gap))
                    made = [a for c in codes.values() for a in done[c]]
                    yield pa.record_batch([part.column(0), *([pa.array([label] * len(part), pa.string())] if name else []), *made], [f.name for f in fields])

    return df.select(key, *columns).mapInArrow(run, T.StructType(fields))


def profiles(df: DataFrame, states: dict[str, tuple[Column, int]], key: str = "id", with_gap: bool = True) -> DataFrame:
    """Profile of several encodings ``{prefix: (state array, number of states)}`` per row."""
    coded = df.select(key, *[s.alias(f"_a_{p}") for p, (s, _) in states.items()])
    return coded_profiles(coded, {p: Coding(f"_a_{p}", n, "given") for p, (_, n) in states.items()}, key, with_gap)


def values_of(df: DataFrame, seq: str, key: str = "id") -> DataFrame:
    """(key, _v): the finite values of a sequence, as the codings below read them."""
    v = finite_values(F.col(seq))
    return df.select(key, v.alias("_v"))


def with_z_scores(df: DataFrame, seq: str) -> DataFrame:
    """(raw, zscore): the finite values of every array and their z-scores within it, as arrays; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(0), SLICE >> 2):
                column = batch.column(0).slice(low, high - low)
                flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                known = np.isfinite(flat)
                kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
                ends = pa.array(np.append(0, np.cumsum(kept)).astype(np.int32))
                values = pa.ListArray.from_arrays(ends, pa.array(flat[known]))
                yield pa.record_batch([values, pa.ListArray.from_arrays(ends, pa.array(_Batch(values).z))], ["raw", "zscore"])

    return df.select(seq).mapInArrow(run, "raw array<double>, zscore array<double>")


def train_bins(train: DataFrame, seq: str, states: Sequence[int] = STATE_COUNTS) -> dict[str, dict[int, list[float]]]:
    """Cut points of raw and z-scored losses of the training documents."""
    return fit_bins(with_z_scores(train, seq), ["raw", "zscore"], states)


def full_codings(bins: dict[str, dict[int, list[float]]], model: str) -> dict[str, Coding]:
    """Raw bins, z-score bins and own-rank states for 3, 5 and 7 states."""
    out = {}
    for n in STATE_COUNTS:
        out[f"{model}_raw_lossq{n}"] = Coding("_v", n, "bins", tuple(bins["raw"][n]))
        out[f"{model}_z_lossq{n}"] = Coding("_v", n, "z_bins", tuple(bins["zscore"][n]))
        out[f"{model}_doc_rank{n}"] = Coding("_v", n, "rank")
    return out


def full_profiles(df: DataFrame, seq: str, bins: dict[str, dict[int, list[float]]], model: str, key: str = "id",
                  with_gap: bool = True) -> DataFrame:
    """Profiles under :func:`full_codings`."""
    return coded_profiles(values_of(df, seq, key), full_codings(bins, model), key, with_gap)


def full_profiles_by_definition(df: DataFrame, seq: str, bins: dict[str, dict[str, dict[int, list[float]]]], model: str, key: str = "id",
                                with_gap: bool = True, name: str = "train_name") -> DataFrame:
    """Rows (key, ``name``): the profile of each sequence under the cut points of every train definition, from one pass."""
    return coded_profiles(values_of(df, seq, key), {d: full_codings(b, model) for d, b in bins.items()}, key, with_gap, name)


def formal_profiles(df: DataFrame, seq: str, bins: dict[int, list[float]], model: str, key: str = "id", with_gap: bool = True) -> DataFrame:
    """Global bins plus per-document probability ranks."""
    codings = {f"{model}_lossq{n}": Coding("_v", n, "bins", tuple(b)) for n, b in bins.items()}
    codings |= {f"{model}_probrank{n}": Coding("_v", n, "falling") for n in STATE_COUNTS}
    return coded_profiles(values_of(df, seq, key), codings, key, with_gap)


def own_profiles(df: DataFrame, seq: str, model: str, n: int = 5, key: str = "id", with_gap: bool = True) -> DataFrame:
    """States by the document's own quantiles and probability ranks; needs no training data."""
    return coded_profiles(values_of(df, seq, key), {f"{model}_lossq": Coding("_v", n, "quantiles"), f"{model}_probrank": Coding("_v", n, "falling")}, key, with_gap)


def long_profiles(df: DataFrame, entity: str, order: str, value: str, bins: dict[int, list[float]], prefix: str,
                  with_gap: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The same profile for a long table (entity, order, value), however long one entity is. ``order`` is a number or a time, unique
    within an entity together with ``ties``; ``value`` has no nulls. The value is lagged once; all numbers of states are counted in one aggregation."""
    rows = df.select(entity, order, *ties, F.struct(F.col(value).alias("x")).alias("_v"))
    moved = lagged(rows, [entity], order, "_v", "_p", ties=ties)
    counts = [F.count(F.lit(1)).alias("_n")]
    for n, cuts in bins.items():
        state, before = bin_state(F.col("_v.x"), cuts), bin_state(F.col("_p.x"), cuts)
        moved = moved.withColumns({f"_s{n}": state, f"_b{n}": before})
        cell = lambda i, j, n=n: F.count_if((F.col(f"_b{n}") == i) & (F.col(f"_s{n}") == j))
        counts += [F.max(F.when(F.col("_p").isNull(), F.col(f"_s{n}"))).alias(f"_f{n}"), F.array(*[cell(i, j) for i in range(n) for j in range(n)]).alias(f"_c{n}")]
    found = moved.groupBy(entity).agg(*counts)
    heads = [h for n in bins for h in names(f"{prefix}_q{n}", n, with_gap)]
    schema = T.StructType([df.schema[entity], *(T.StructField(h, T.DoubleType()) for h in heads)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, out = batch.column(1).to_numpy(), []
            for k, n in enumerate(bins):
                pairs = batch.column(3 + 2 * k).flatten().to_numpy().reshape(len(size), n, n)
                out += _numbers(rates(pairs, batch.column(2 + 2 * k).to_numpy(), size, with_gap))
            yield pa.record_batch([batch.column(0), *out], [entity, *heads])

    return found.mapInArrow(run, schema)


def column_delta(small: DataFrame, large: DataFrame, small_name: str, large_name: str, prefix: str = "scale_transition_delta_", key: str = "id") -> DataFrame:
    """large minus small for every column whose name differs only by the model name; one join."""
    pairs = [(c, c.replace(large_name, small_name)) for c in large.columns if c != key]
    pairs = [(b, a) for b, a in pairs if a in small.columns]
    left = large.select(key, *[F.col(b) for b, _ in pairs])
    right = small.select(key, *[F.col(a).alias(f"_small_{a}") for _, a in pairs])
    joined = left.join(right, key, "left")
    return joined.select(key, *[(F.col(b) - F.col(f"_small_{a}")).alias(prefix + b.replace(f"{large_name}_", "")) for b, a in pairs])

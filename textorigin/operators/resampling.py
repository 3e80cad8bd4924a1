"""Bootstrap by multinomial draws over counted scores.

A replicate draws exactly as many rows as its cell has, with replacement. The rows are never copied: their number per (cell, score,
label) follows from a tree of draws. The root deals a cell's rows to blocks of neighbouring scores and to the two labels, a block
deals its share to slices, a slice to its scores. Every node draws for all replicates at once, seeded by its own name, so a task
that runs again draws the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .metrics import _share, score_counts
from .ranking import prefix_sums

#: distinct scores of one cell in a block, the unit of a task's work, and in a slice, the unit held for all replicates
BLOCK, SLICE = 65_536, 256
ROOTS = "_g string, _b long, pos array<long>, neg array<long>, pos_above array<long>, neg_above array<long>"
PARTS = "_g string, replicate int, P long, N long, TP long, FP long, wins double, ap double"


def _node(*name: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, name)).encode()).digest(), "big"))


def _dealt(rng: np.random.Generator, drawn: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``drawn`` rows of every replicate dealt to categories in proportion to ``weights``: replicates x categories."""
    total = weights.sum()
    return rng.multinomial(drawn, weights / total) if total else np.zeros((len(drawn), len(weights)), dtype=np.int64)


def _roots(replicates: int, seed: int):
    """Rows drawn from each block and label of a cell, and from the blocks of higher scores."""
    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_b")
        pos, neg = blocks["pos"].to_numpy(np.int64), blocks["neg"].to_numpy(np.int64)
        rows = np.full(replicates, pos.sum() + neg.sum())
        p, n = np.split(_dealt(_node(seed, key[0]), rows, np.concatenate([pos, neg]).astype(float)).T, 2)
        above = lambda x: list(np.cumsum(x, axis=0) - x)
        return pd.DataFrame({"_g": key[0], "_b": blocks["_b"].to_numpy(), "pos": list(p), "neg": list(n), "pos_above": above(p), "neg_above": above(n)})

    return run


def _slices(seed: int, key: tuple, scores: pd.DataFrame, root: pd.DataFrame) -> Iterator[tuple]:
    """Slices of a block from the highest score down: score, and drawn rows (replicates x scores) by label and call."""
    scores = scores.sort_values("score", ascending=False)
    cuts = range(0, len(scores), SLICE)
    dealt, weights = {}, {}
    for label in ("pos", "neg"):
        called = scores[f"hat_{label}"].to_numpy(float)
        # a score's rows that are called positive, then those that are not
        weights[label] = np.stack([called, scores[label].to_numpy(float) - called], axis=1)
        per_slice = np.array([weights[label][c:c + SLICE].sum() for c in cuts])
        dealt[label] = _dealt(_node(seed, *key, label), np.asarray(root[label].iloc[0], dtype=np.int64), per_slice)
    for i, c in enumerate(cuts):
        at = slice(c, c + SLICE)
        drawn = [_dealt(_node(seed, *key, y, i), dealt[y][:, i], weights[y][at].ravel()).reshape(len(dealt[y]), -1, 2) for y in ("pos", "neg")]
        yield scores["score"].to_numpy()[at], *drawn


def _parts(seed: int):
    """A block's share of every replicate's sums."""
    def run(key: tuple, scores: pd.DataFrame, root: pd.DataFrame) -> pd.DataFrame:
        tp, fp = (np.asarray(root[f"{y}_above"].iloc[0], dtype=np.int64) for y in ("pos", "neg"))
        out = {c: np.zeros(len(tp), dtype=np.int64) for c in ("P", "N", "TP", "FP")} | {c: np.zeros(len(tp)) for c in ("wins", "ap")}
        for _, pos, neg in _slices(seed, key, scores, root):
            p, n = pos.sum(axis=2), neg.sum(axis=2)
            above_p, above_n = tp[:, None] + p.cumsum(axis=1), fp[:, None] + n.cumsum(axis=1)
            out["P"] += p.sum(axis=1)
            out["N"] += n.sum(axis=1)
            out["TP"] += pos[:, :, 0].sum(axis=1)
            out["FP"] += neg[:, :, 0].sum(axis=1)
            out["wins"] += (n * (above_p - p / 2)).sum(axis=1)
            out["ap"] += (p * above_p / np.maximum(above_p + above_n, 1)).sum(axis=1)
            tp, fp = above_p[:, -1], above_n[:, -1]
        return pd.DataFrame({"_g": key[0], "replicate": np.arange(len(tp)), **out})

    return run


def _prepared(pred: DataFrame, cells: Sequence[str], replicates: int, seed: int, names: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted scores with their cell's key and block; the draws of blocks; the cells behind the keys."""
    counts = score_counts(pred, cells, **names)
    running = prefix_sums(cut_lineage(counts.withColumn("_one", F.lit(1))), cells, "score", {"_rank": "_one"}, descending=True)
    cell = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}) if cells else F.lit("")
    marked = cut_lineage(running.withColumns({"_g": cell, "_b": F.floor((F.col("_rank") - 1) / F.lit(BLOCK)).cast("long")}))
    blocks = marked.groupBy("_g", "_b").agg(F.sum("pos").cast("long").alias("pos"), F.sum("neg").cast("long").alias("neg"))
    roots = blocks.groupBy("_g").applyInPandas(_roots(replicates, seed), ROOTS)
    keys = marked.groupBy("_g").agg(*[F.first(c).alias(c) for c in cells], F.sum(F.col("pos") + F.col("neg")).alias("n"))
    return marked.select("_g", "_b", "score", "pos", "neg", "hat_pos", "hat_neg"), roots, keys


def multinomial_draws(pred: DataFrame, cells: Sequence[str] = (), replicates: int = 200, seed: int = 42, **names) -> DataFrame:
    """(cells, replicate, score, pos, neg): how many positives and negatives of a score every replicate draws; undrawn scores have no row."""
    scores, roots, keys = _prepared(pred, cells, replicates, seed, names)

    def run(key: tuple, rows: pd.DataFrame, root: pd.DataFrame) -> pd.DataFrame:
        found = []
        for score, pos, neg in _slices(seed, key, rows, root):
            p, n = pos.sum(axis=2), neg.sum(axis=2)
            b, i = np.nonzero(p + n)
            found.append(pd.DataFrame({"_g": key[0], "replicate": b, "score": score[i], "pos": p[b, i], "neg": n[b, i]}))
        return pd.concat(found)

    drawn = scores.groupBy("_g", "_b").cogroup(roots.groupBy("_g", "_b")).applyInPandas(run, "_g string, replicate int, score double, pos long, neg long")
    return drawn.join(keys, "_g").select(*cells, "replicate", "score", "pos", "neg")


def multinomial_metrics(pred: DataFrame, cells: Sequence[str] = (), replicates: int = 200, seed: int = 42, **names) -> DataFrame:
    """AUROC, AUPRC and F1 of every replicate, and ``n``, the rows it drew.

    ``pred`` is a prediction table as for :func:`metrics.detector_metrics`; ``names`` are the column names of
    :func:`metrics.score_counts`. Rows without a label of 0 or 1 are left out; null cells are cells; tied scores are one category. A replicate without one of
    the two labels has no AUROC and no AUPRC. An empty table has no replicates. Blocks hold at most ``BLOCK`` scores whatever the
    size of a cell, and send one row per replicate; a cell's root holds two numbers per block and replicate.
    """
    scores, roots, keys = _prepared(pred, cells, replicates, seed, names)
    parts = scores.groupBy("_g", "_b").cogroup(roots.groupBy("_g", "_b")).applyInPandas(_parts(seed), PARTS)
    sums = parts.groupBy("_g", "replicate").agg(*[F.sum(c).alias(c) for c in ("P", "N", "TP", "FP", "wins", "ap")])
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return sums.join(keys.drop("n"), "_g").select(
        *cells, "replicate", (F.col("P") + F.col("N")).alias("n"),
        F.when(both, _share(F.col("wins"), F.col("P") * F.col("N"))).alias("auroc"),
        F.when(both, _share(F.col("ap"), F.col("P"))).alias("auprc"),
        F.coalesce(_share(2 * F.col("TP"), F.col("TP") + F.col("FP") + F.col("P")), F.lit(0.0)).alias("f1"))


def multinomial_intervals(pred: DataFrame, cells: Sequence[str] = (), replicates: int = 200, **options) -> DataFrame:
    """2.5 and 97.5 percentiles over the replicates."""
    runs = multinomial_metrics(pred, cells, replicates, **options)

    def between(metric: str) -> list[Column]:
        return [F.percentile(metric, F.lit(p)).alias(f"{metric}_ci_{side}") for p, side in ((0.025, "low"), (0.975, "high"))]

    return runs.groupBy(*cells).agg(*between("auroc"), *between("auprc"), *between("f1"))

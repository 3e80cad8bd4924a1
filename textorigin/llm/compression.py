"""Quality classifier from compressed sizes: zstandard dictionaries of good and bad labelled text, and a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import held

#: documents of each label that the fit uses, two thirds for the dictionaries and a third for the calibration
FIT_DOCUMENTS = 2_400
#: longer texts are scored like all others, but not used for the fit; with FIT_DOCUMENTS this bounds what the driver gets
FIT_CHARACTERS = 32_768
#: bytes of a text that a dictionary compresses at once (the dictionary would not matter in a longer piece)
PIECE = 1024
DICTIONARY, LEVEL = 128 << 10, 3


def held_out(doc_id: Column | str, parts: int = 3, part: int = 1) -> Column:
    """True for ids whose crc32 as text leaves ``part`` when divided by ``parts``; an id that is null is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False)) if isinstance(doc_id, str) else doc_id


@dataclass(frozen=True)
class Model:
    """Dictionaries by label, and a logistic curve over the features of :func:`features`."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


@lru_cache(4)
def _presses(good: bytes, bad: bytes):
    made = []
    for raw in (good, bad):
        # a dictionary without the header is taken as plain content
        own = zstandard.ZstdCompressionDict(raw) if raw else None
        if own is not None:
            own.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False))
    return (*made, zstandard.ZstdCompressor(level=LEVEL))


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: log of its size under the bad dictionary over that under the good one (the normalised difference), log of the
    share of its size that remains under the good, the bad and no dictionary (whole text at once), and log of its size."""
    by_good, by_bad, alone = _presses(good, bad)
    out = np.empty((len(texts), 5))
    for i, raw in enumerate(texts):
        pieces = [raw[a : a + PIECE] for a in range(0, len(raw), PIECE)] or [b""]
        a = sum(len(by_good.compress(p)) for p in pieces)
        b = sum(len(by_bad.compress(p)) for p in pieces)
        out[i] = a, b, len(alone.compress(raw)), max(1, len(raw)), 0
    logs = np.log(out[:, :4])
    return np.column_stack([logs[:, 1] - logs[:, 0], *(logs[:, j] - logs[:, 3] for j in range(3)), logs[:, 3]])


def _dictionary(pieces: list[bytes]) -> bytes:
    if not pieces:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", train: Column | None = None) -> Model:
    """Dictionaries and calibration from a bounded sample of labelled documents where ``train`` (a condition on ``doc_id``) holds.

    The sample: for each label the FIT_DOCUMENTS ids with the smallest md5, without texts above FIT_CHARACTERS. Labels other
    than 0 and 1, null ids, and ids with both labels are left out. Class weights come from all labelled rows. With labels of one
    kind only, or none, the model gives every text the smoothed share of label 1, at least 0.5 without any label.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if train is not None:
        own = own.filter(train)
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    there = docs.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    own = own.join(there, "doc_id", "left_semi").withColumn("at", F.md5(F.col("doc_id").cast("string")))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    chosen = [r for y in (0, 1) for r in own.filter(F.col("y") == y).orderBy("at").limit(FIT_DOCUMENTS).collect()]
    flat = Model(b"", b"", (0.0,) * 5, (1.0,) * 5, (float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))), *(0.0,) * 5))
    if len({r["y"] for r in chosen}) < 2:
        return flat
    ids = spark.createDataFrame([(r["doc_id"], r["y"], r["at"]) for r in chosen], "doc_id long, y int, at string")
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.length("text") <= FIT_CHARACTERS)
    # at most 2 * FIT_DOCUMENTS ids; repeated rows of an id count once
    rows = wanted.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "at").agg(F.min("text").alias("text")).orderBy("at", "doc_id").collect()
    by = {y: [r["text"].encode("utf-8", "replace") for r in rows if r["y"] == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return flat
    pieces = {y: [raw[a : a + PIECE] for i, raw in enumerate(own) if i % 3 for a in range(0, len(raw), PIECE)] for y, own in by.items()}
    good, bad = _dictionary(pieces[1]), _dictionary(pieces[0])
    left = {y: own[::3] for y, own in by.items()}
    x = features(left[1] + left[0], good, bad)
    y = np.array([1.0] * len(left[1]) + [0.0] * len(left[0]))
    weight = np.where(y == 1, counts[1] / len(left[1]), counts[0] / len(left[0]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.column_stack([np.ones(len(x)), (x - mean) / scale]), np.zeros(6)
    weight = weight / weight.sum()
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + 1e-4 * np.eye(6), z.T @ (weight * (p - y)) + 1e-4 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(good, bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` between 0 and 1, and ``predicted``: 1 if the score is 0.5 or more.

    Whole texts are compressed, in one narrow pass; other columns do not go through Python. Null and empty texts get the score of an empty text; repeated rows get equal
    scores; an empty table stays empty. Columns named as the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]

    @F.arrow_udf("double")
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held.only("compression")
        m = shared.value
        mean, scale, weights = np.array(m.mean), np.array(m.scale), np.array(m.weights)
        for column in columns:
            out = np.empty(len(column))
            # a few texts at a time, so that a batch is not held twice
            for low in range(0, len(column), 256):
                raw = [x or b"" for x in column.slice(low, 256).cast(pa.large_binary()).to_pylist()]
                x = (features(raw, m.good, m.bad) - mean) / scale
                out[low : low + len(raw)] = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.array(out)
        _presses.cache_clear()

    # only the text goes to Python, and only once: a condition on the score does not work it out again
    scored = docs.select(*names, good.asNondeterministic()(F.col(text).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that has seen no held-out label."""
    model = fit(docs, labels, train=~held_out("doc_id"))
    return score(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

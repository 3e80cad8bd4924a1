"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals exact block quotas to output shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .ranks import bits_for, running

#: sources whose sizes the driver may hold (about 100 bytes each); more are an error, not a smaller mix
MOST_SOURCES = 200_000
SHARDS, SEED = 16, 20_240_229
#: blocks in a shard, about
BLOCKS = 64
#: passes that fill what the document at a source's border leaves open
FILLS = 3
#: single documents that may follow, each if it brings its source nearer to the target
SINGLES = 2


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """``budget`` shared by weight; a target stops at ``most`` times its size, and the excess is shared anew among the others."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(budget)
    while free:
        total = sum(weights[i] for i in sorted(free))
        above = [i for i in sorted(free) if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
        left = max(left, 0.0)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows: shards, columns: sources. Each shard gets its even share of all blocks; which sources they are of is drawn without
    replacement: at each inner node of a binary tree over the shards the left side draws its number of blocks from the node's."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(own: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = own
            return
        middle, total = (low + high) // 2, int(own.sum())
        draw = np.random.default_rng([seed, low, high])
        left = total * (middle - low) // (high - low)
        taken = draw.multivariate_hypergeometric(own, left, method="marginals") if total else own * 0
        down(taken, low, middle)
        down(own - taken, middle, high)

    down(np.asarray(quotas, np.int64), 0, shards)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = SEED,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, source, size (words of the text), source_size, target, copies (times the mix takes it) and ``places``,
    an array with shard, block and order for each copy. Whole documents are taken, so a document's share is copies * size.

    Sources by code point, null last, weigh ``weights``, repeating; they share ``budget`` times all sizes, each up to ``most`` times its own
    (see :func:`targets`). A source's documents stand in a hash order. All are taken as often as the target covers the whole source;
    then documents from the start of that order as far as they fit the rest, and, where one does not, later ones that
    do, and at last single ones that bring the sum nearest. Each source's stream is cut into blocks of equal size; the tree (:func:`split_quotas`) deals their numbers to the
    shards; a shard draws its blocks, disjoint, from a permutation; the order within a shard is a hash.

    A null or empty text has size 0 and takes part with no words; a source without words has target 0; repeated rows are
    rows of their own; an empty table gives no rows; the same rows and seed give the same mix. Sums along the hash order go over
    ranges of it, so a source with a third of all rows is no single task. Only sizes per source reach the driver.
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    base = cut_lineage(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(doc_id).cast("long"), t).alias("h"),
            # tells repeated rows apart; written once, so it stays
            F.monotonically_increasing_id().alias("row"),
        )
    )
    per_source = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give coarser ones")
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in per_source]
    goals = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], budget * sum(sizes), most)
    count = sum(r["rows"] for r in per_source)
    bits = bits_for(count)
    whole = [min(math.floor(g / s + 1e-12), math.floor(most)) if s else 0 for g, s in zip(goals, sizes)]
    rest = [max(0.0, g - w * s) if w < most else 0.0 for g, s, w in zip(goals, sizes, whole)]
    schema = "sid int, source string, source_size long, target double, whole int, rest double"
    if not per_source:
        made = "doc_id long, source string, size long, source_size long, target double, copies int, places array<struct<shard:int,block:bigint,order:bigint>>, h long"
        return spark.createDataFrame([], made)
    made = spark.createDataFrame([(i, r["source"], r["size"], goals[i], whole[i], rest[i]) for i, r in enumerate(per_source)], schema)
    # one row per source, at most MOST_SOURCES
    rows = base.join(F.broadcast(made.withColumnRenamed("source", "of")), base["source"].eqNullSafe(F.col("of"))).drop("of")
    ties = ["size", "doc_id", "row"]
    ranked = running(rows, ["sid"], "h", "size", "before", bits, ties)
    ranked = cut_lineage(ranked.withColumn("extra", (F.col("size") > 0) & (F.col("before") + F.col("size") <= F.col("rest"))), count)

    def still_open() -> DataFrame:
        got = {r["sid"]: r["x"] for r in ranked.filter("extra").groupBy("sid").agg(F.sum("size").alias("x")).collect()}
        return spark.createDataFrame([(i, r - got.get(i, 0)) for i, r in enumerate(rest)], "sid int, open double")

    for _ in range(FILLS):
        left = still_open()
        fits = ~F.col("extra") & (F.col("size") > 0) & (F.col("size") <= F.col("open"))
        again = ranked.join(F.broadcast(left), "sid").withColumn("fit", F.when(fits, F.col("size")).otherwise(F.lit(0).cast("long")))
        again = running(again, ["sid"], "h", "fit", "ahead", bits, ties)
        more = (F.col("fit") > 0) & (F.col("ahead") + F.col("fit") <= F.col("open"))
        ranked = cut_lineage(again.withColumn("extra", F.col("extra") | more).drop("fit", "ahead", "open"), count)
    for _ in range(SINGLES):
        # the one document that brings the source nearest to its target, if it brings it nearer
        off = F.abs(F.col("open") - F.col("size"))
        near = ranked.filter(F.expr("not extra and size > 0") & (F.col("whole") < int(most))).join(F.broadcast(still_open()), "sid").filter(off < F.col("open"))
        best = near.groupBy("sid").agg(F.min(F.struct(off.alias("off"), "h", "doc_id", "row")).alias("b")).select(F.col("b.row").alias("best"))
        ranked = cut_lineage(ranked.join(F.broadcast(best), F.col("row") == F.col("best"), "left").withColumn("extra", F.col("extra") | F.col("best").isNotNull()).drop("best"), count)
    ranked = ranked.withColumn("own", F.when(F.col("extra"), F.col("size")).otherwise(F.lit(0).cast("long")))
    ranked = cut_lineage(running(ranked, ["sid"], "h", "own", "extra_before", bits, ties), count)
    taken = {r["sid"]: r["x"] for r in ranked.groupBy("sid").agg(F.sum("own").alias("x")).collect()}
    totals = [w * s + taken.get(i, 0) for i, (w, s) in enumerate(zip(whole, sizes))]
    block = max(1, math.ceil(sum(totals) / (shards * BLOCKS)))
    quotas = np.array([math.ceil(x / block) for x in totals], np.int64)
    dealt = np.cumsum(split_quotas(quotas, shards, seed), axis=0).T
    steps = [_step(int(q), seed + i) for i, q in enumerate(quotas)]
    quota_rows = [(i, int(quotas[i]), steps[i], [int(x) for x in dealt[i]], w * sizes[i]) for i, w in enumerate(whole)]
    of_source = F.broadcast(spark.createDataFrame(quota_rows, "sid int, quota long, step long, upto array<long>, first long"))

    rows = ranked.join(of_source, "sid")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("int")).otherwise(0)

    def place(copy, at):
        number_ = F.floor(at / block)
        drawn = F.pmod(number_ * F.col("step") + 7, F.col("quota"))
        shard = F.size(F.filter("upto", lambda x: x <= drawn))
        return F.struct(shard.alias("shard"), number_.alias("block"), F.xxhash64(F.lit(seed), "h", copy).alias("order"))

    firsts = F.transform(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>")), lambda e: place(e, e * F.col("source_size") + F.col("before")))
    last = F.when(F.col("extra"), F.array(place(F.col("whole"), F.col("first") + F.col("extra_before")))).otherwise(F.array().cast("array<struct<shard:int,block:bigint,order:bigint>>"))
    places = F.when(F.col("size") > 0, F.concat(firsts, last)).otherwise(F.array().cast("array<struct<shard:int,block:bigint,order:bigint>>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), places.alias("places"), "h")


def _step(quota: int, seed: int) -> int:
    """A factor without a common divisor with ``quota``: multiplying by it permutes the block numbers."""
    step = seed % max(quota, 1) or 1
    while math.gcd(step, max(quota, 1)) != 1:
        step += 1
    return step


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` once for each of its copies, with ``mix_shard`` and ``mix_order`` (the order within the shard).

    Rows with the same id, text and source are paired with their plans by number, as these are alike.
    """
    plan = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    id_ = F.col(of[doc_id]).cast("long")
    keyed = docs.toDF(*names).withColumns({
        "_h": F.xxhash64(F.lit(options.get("seed", SEED)), id_, F.col(of[text]).cast("string")),
        "_s": F.xxhash64(id_.isNull(), id_, F.col(of[source]).isNull(), F.col(of[source]).cast("string")),
    })
    numbered = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_h", "_s").orderBy(F.xxhash64(*names))))
    plan = plan.withColumns({"_h": F.col("h"), "_s": F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source")})
    plan = plan.withColumn("_k", F.row_number().over(Window.partitionBy("_h", "_s").orderBy(F.lit(0)))).filter("copies > 0").select("_h", "_s", "_k", "places")
    rows = numbered.join(plan, ["_h", "_s", "_k"]).select(*names, F.explode("places").alias("p"))
    return rows.select(*names, "p.shard", "p.order").toDF(*docs.columns, "mix_shard", "mix_order")


def op8(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document, summed over the places that the tree and the block draw gave its copies, and where they are."""
    plan = mix(docs.select("doc_id", "text", "source"))
    taken = F.aggregate(F.transform("places", lambda p: F.when(p["shard"] >= 0, F.col("size")).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    spots = F.transform(F.array_sort("places"), lambda p: F.concat_ws(":", p["shard"], p["block"], p["order"]))
    return plan.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["shard"]))), ",").alias("shards"),
        F.sha2(F.array_join(spots, ","), 256).alias("places_sha256"),
    )

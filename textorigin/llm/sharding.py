"""Balanced label propagation: documents move towards the shards of the documents they are linked with, under exact quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .ranks import bits_for, running

ROUNDS = 12
GROUP = ["g", "size", "text_crc32"]


def _grants(wanted: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many may move between each two shards: swaps first, then into free places, which moving out makes anew."""
    n = len(free)
    grant = [[min(wanted[s][t], wanted[t][s]) if s != t else 0 for t in range(n)] for s in range(n)]
    free, moved = list(free), True
    while moved:
        moved = False
        for s in range(n):
            for t in range(n):
                more = min(wanted[s][t] - grant[s][t], free[t]) if s != t else 0
                if more > 0:
                    grant[s][t] += more
                    free[t] -= more
                    free[s] += more
                    moved = True
    return grant


def _target(shards: int, open_: list[bool], turn: int) -> Column:
    """For the cell of a group in shard ``s``: the open shard with most of the group if that is ahead of ``s``, else ``s``.

    Shards with equally many are ranked by a hash of group, shard and turn: all of the group want the same shard, and if they
    find no room there, another one in a later turn.
    """
    tie = [F.pmod(F.xxhash64("g", F.lit(t), F.lit(turn)), F.lit(1 << 20)) for t in range(shards)]
    standing = [F.struct(F.col("n")[t].alias("n"), tie[t].alias("h"), F.lit(t).alias("t")) for t in range(shards)]
    candidates = [x for x, is_open in zip(standing, open_) if is_open]
    best = F.greatest(*candidates) if len(candidates) > 1 else candidates[0]
    own = F.array(*standing)[F.col("s")]
    return F.when(best > own, best["t"]).otherwise(F.col("s"))


def _after(s: int) -> Column:
    """Number of a group's documents in shard ``s`` after its moves."""

    def add(total: Column, x: Column) -> Column:
        return total + F.when(x["t"] == s, x["k"]).otherwise(0) - F.when(x["s"] == s, x["k"]).otherwise(0)

    return F.col("n")[s] + F.aggregate(F.coalesce("moves", F.array().cast("array<struct<s:int,t:int,k:bigint>>")), F.lit(0).cast("long"), add)


def shard(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    Documents with equal texts are linked. Counts of the shards differ by one at most, at every step. The linked documents start
    dealt evenly; in each round every document wants the shard that holds most of its group, requests are counted per pair of
    shards, quotas are granted (swaps, then free places), and requests within them move. Documents without a link fill what is
    left. The state is one row per group with its numbers per shard, as members of a group differ only in their id; a group
    larger than a shard is spread over as few shards as it needs.

    Size is the number of UTF-8 bytes plus 1. A null text has size 1 and the checksum of no bytes, and is linked with nothing; empty
    texts are equal texts; a null id is an id like others; repeated rows are placed each; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    id_ = F.col(doc_id).cast("long")
    base = cut_lineage(
        docs.select(
            id_.alias("doc_id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.when(F.col(text).isNull(), F.xxhash64(F.lit("no text"), id_)).otherwise(F.xxhash64(F.lit("text"), raw)).alias("g"),
            F.xxhash64(id_, F.lit(17)).alias("h"),
            F.col(text).isNull().alias("alone"),
        )
    )
    total = base.count()
    bits = bits_for(total)
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    ranges = base.withColumn("r", F.shiftrightunsigned("h", 64 - bits).cast("int")).groupBy(*GROUP, "alone", "r").agg(F.count(F.lit(1)).alias("c"))
    ranges = cut_lineage(ranges)
    groups = ranges.groupBy(*GROUP, "alone").agg(F.sum("c").alias("m"))
    linked = cut_lineage(running(groups.filter("m > 1 and not alone"), [], "g", "m", "start", bits, ["size", "text_crc32"]))
    # position p of all linked documents starts in shard p mod shards
    first = lambda s: F.pmod(F.lit(s) - F.col("start"), F.lit(shards))
    dealt = F.array(*[F.when(F.col("m") > first(s), F.floor((F.col("m") - 1 - first(s)) / shards) + 1).otherwise(0).cast("long") for s in range(shards)])
    state = cut_lineage(linked.select(*GROUP, "m", dealt.alias("n")))

    idle = 0
    for turn in range(rounds):
        cells = state.select(*GROUP, "m", "n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")).filter(F.col("n")[F.col("s")] > 0)
        loads = {r["s"]: r["x"] for r in cells.groupBy("s").agg(F.sum(F.col("n")[F.col("s")]).alias("x")).collect()}
        free = [quota[s] - loads.get(s, 0) for s in range(shards)]
        # every other round looks at shards with free places only: what cannot be exchanged goes where there is room
        open_ = [turn % 2 == 0 or x > 0 for x in free] if any(x > 0 for x in free) else [True] * shards
        asked = cut_lineage(cells.withColumn("t", _target(shards, open_, turn)).filter("s != t").select(*GROUP, "m", "s", "t", F.col("n")[F.col("s")].alias("k")))
        wanted = [[0] * shards for _ in range(shards)]
        for r in asked.groupBy("s", "t").agg(F.sum("k").alias("k")).collect():
            wanted[r["s"]][r["t"]] = r["k"]
        grant = _grants(wanted, free)
        if not any(map(any, grant)):
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        allowed = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in grant])[F.col("s")][F.col("t")]
        # larger groups come first (by powers of two, in the upper five bits), then by hash
        large = F.lit(31) - F.least(F.lit(31), F.floor(F.log2(F.col("m").cast("double"))))
        order = F.shiftleft(large.cast("long"), 59).bitwiseOR(F.shiftrightunsigned(F.xxhash64("g", "size"), 5))
        ranked = running(asked.withColumn("o", order), ["s", "t"], "o", "k", "before", bits + 5, GROUP)
        moves = ranked.withColumn("k", F.greatest(F.lit(0), F.least(F.col("k"), allowed - F.col("before")))).filter("k > 0")
        change = moves.groupBy(*GROUP).agg(F.collect_list(F.struct("s", "t", "k")).alias("moves"))
        state = cut_lineage(state.join(change, GROUP, "left").select(*GROUP, "m", F.array(*[_after(s) for s in range(shards)]).alias("n")))

    # slots of the linked: groups one after the other in each shard
    cells = state.select(*GROUP, "n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")).withColumn("k", F.col("n")[F.col("s")]).filter("k > 0")
    loads = {r["s"]: r["x"] for r in cells.groupBy("s").agg(F.sum("k").alias("x")).collect()}
    slots = running(cells, ["s"], "g", "k", "slot", bits, ["size", "text_crc32"])
    ahead = reduce(lambda a, t: a + F.when(F.col("s") > t, F.col("n")[t]).otherwise(0), range(shards), F.lit(0).cast("long"))
    place = F.struct(ahead.alias("rank"), F.col("s").alias("shard"), "slot")
    of_linked = slots.select(*GROUP, place.alias("p")).groupBy(*GROUP).agg(F.sort_array(F.collect_list("p")).alias("places"))
    # the others by their rank: shard after shard, each behind its linked documents
    singles = running(groups.filter("m = 1 or alone").withColumn("o", F.xxhash64("g", "size")), [], "o", "m", "u", bits, GROUP)
    bounds, upto = [], 0
    for s in range(shards):
        bounds.append((upto, s, loads.get(s, 0)))
        upto += quota[s] - loads.get(s, 0)
    # a group of rows alone (null texts under one id) may reach over several shards: its places are all that begin before its end
    reach = F.filter(
        F.array(*[F.struct((F.lit(a) - F.col("u")).cast("long").alias("rank"), F.lit(s).alias("shard"), F.lit(b).cast("long").alias("slot")) for a, s, b in bounds]),
        lambda p: p["rank"] < F.col("m"),
    )
    of_single = singles.select(*GROUP, reach.alias("places"))
    placed = of_linked.unionByName(of_single)

    earlier = Window.partitionBy(*GROUP).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("ahead", F.coalesce(F.sum("c").over(earlier), F.lit(0))).select(*GROUP, "r", "ahead").join(placed, GROUP)
    inside = F.row_number().over(Window.partitionBy(*GROUP, "r").orderBy("h", "doc_id")) - 1
    rows = base.withColumn("r", F.shiftrightunsigned("h", 64 - bits).cast("int")).withColumn("inside", inside).join(offsets, [*GROUP, "r"])
    rank = F.col("ahead") + F.col("inside")
    mine = F.element_at(F.filter("places", lambda p: p["rank"] <= F.col("rank")), -1)
    out = rows.withColumn("rank", rank).withColumn("mine", mine)
    return out.select("doc_id", "size", "text_crc32", F.col("mine.shard").alias("shard"), (F.col("mine.slot") + F.col("rank") - F.col("mine.rank")).alias("slot"))


def op4(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

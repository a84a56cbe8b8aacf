"""Operator 2: balanced label propagation, in DataFrames alone."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows of a part, within which they are numbered, and the least number of parts.
PART_ROWS, PARTS = 500_000, 64
#: Rounds without a move, each with other ties, after which none is left to find.
IDLE = 3


def numbered(df: DataFrame, by: str, name: str, order: list[str], urgency: Column | None = None, most: int = 64, parts: int = PARTS) -> DataFrame:
    """Adds `name`: gapless numbers from 0 within each value of `by`, less urgency first.

    Rows are numbered within parts (a hash of the order columns) and the parts' sizes give each part its
    first number, so that no task sees more than a part. The table of sizes has a row for each part.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(parts)) + (F.lit(0) if urgency is None else F.least(F.greatest(urgency, F.lit(0)), F.lit(most - 1)) * parts)
    df = df.withColumn("_part", part.cast("int"))
    sizes = df.groupBy(by, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(by, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(by, "_part").orderBy(*order)
    ranked = df.withColumn("_own", F.row_number().over(own) - 1)
    return ranked.join(first, [by, "_part"]).withColumn(name, (F.col("_first") + F.col("_own")).cast("long")).drop("_part", "_first", "_own")


def _by_shard(counts: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col("shard"))


def accepted(asked: dict[tuple[int, int], int], loose: dict[int, int], shards: int) -> dict[tuple[int, int], int]:
    """Of the rows that ask to move (from, to), as many in all as can so that no shard gains more than its loose rows.

    Rows that leave a shard make places as loose ones do. It is the largest circulation on the shards and a pool of loose
    rows: exchanges of two first, then cycles that add moves until there is none.
    """
    pool = shards
    want, free = np.zeros((shards + 1, shards + 1), np.int64), np.array([loose.get(s, 0) for s in range(shards)])
    for (s, t), n in asked.items():
        want[s, t] = n
    flow = np.minimum(want, want.T)
    while True:
        room = free - (flow.sum(0) - flow.sum(1))[:shards]
        # an arc adds a move (-1), or takes back one against it (+1), or passes through the pool (0)
        cost = np.where(want > flow, -1.0, np.where(flow.T > 0, 1.0, np.inf))
        cost[:shards, pool] = np.where(room > 0, 0.0, np.inf)
        cost[pool, :shards] = 0.0
        dist, came, changed = np.zeros(shards + 1), np.full(shards + 1, -1), np.zeros(0, np.int64)
        for _ in range(shards + 2):
            through = dist[:, None] + cost
            best = through.argmin(0)
            changed = np.flatnonzero(through[best, np.arange(shards + 1)] < dist)
            if not len(changed):
                break
            came[changed] = best[changed]
            dist = np.minimum(dist, through.min(0))
        if not len(changed):
            return {(int(s), int(t)): int(flow[s, t]) for s, t in np.argwhere(flow)}
        at = int(changed[0])
        for _ in range(shards + 1):
            at = int(came[at])
        cycle = [at]
        while came[cycle[-1]] != at:
            cycle.append(int(came[cycle[-1]]))
        arcs = list(zip(np.roll(cycle, -1).tolist(), cycle, strict=True))
        most = [room[u] if v == pool else np.iinfo(np.int64).max if u == pool else want[u, v] - flow[u, v] if cost[u, v] < 0 else flow[v, u] for u, v in arcs]
        for u, v in arcs:
            if pool not in (u, v):
                flow[(u, v) if cost[u, v] < 0 else (v, u)] += min(most) if cost[u, v] < 0 else -min(most)


def shard(rows: DataFrame, shards: int = 16, rounds: int | None = None) -> DataFrame:
    """rows with `shard`: counts of rows that differ by one at most, and rows of one `grp` together where places allow.

    rows: any columns with doc_id and grp (rows with equal, not null grp are linked). It starts from a
    balanced deal by hash. In each round a group's rows ask for the shard that has most of them (ties: the
    one that a hash of the round favours). As many move as can while each shard keeps its size: rows that leave make
    places for others, and unlinked rows are displaced for the rest, those of the largest gain first. A row once with most of
    its group stays, so that each round cuts less; it ends when no row asks, or none can move in IDLE rounds on end
    (`rounds` at most, if given). A group larger than half a shard is dealt over parts of that size. Only counts by shard reach the driver.
    Null ids, repeated rows and ties are rows like others; null groups link with nothing; no rows give none.
    """
    total = rows.count()
    quota = max(1, total // shards)
    parts = max(PARTS, -(-total // PART_ROWS))
    # sizes and wishes are tables of their own, so that Spark can split a hot group's rows where they are joined
    size = checkpoint(rows.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("_n")).where("_n > 1"))
    dealt = rows.join(size, "grp", "left")
    pieces = F.ceil(2 * F.col("_n") / F.lit(quota)).cast("long")
    linked = F.when(F.col("_n").isNotNull(), F.xxhash64("grp", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), pieces)))
    dealt = dealt.withColumn("_grp", linked).drop("_n").withColumn("_all", F.lit(0))
    state = numbered(dealt, "_all", "_r", ["doc_id", "_tie"] if "_tie" in rows.columns else ["doc_id"], parts=parts).withColumn("shard", (F.col("_r") % shards).cast("int")).drop("_all")
    state = checkpoint(state)
    idle = 0
    for turn in itertools.count() if rounds is None else range(rounds):
        held = state.where("_grp IS NOT NULL").groupBy("_grp", "shard").agg(F.count("*").alias("_c"))
        lean = F.struct("_c", F.xxhash64("_grp", "shard", F.lit(turn)).alias("h"), "shard")
        wish = checkpoint(held.groupBy("_grp").agg(F.max(lean).alias("_w")).select("_grp", F.col("_w.shard").alias("_to"), F.col("_w._c").alias("_gain")))
        asked = state.join(wish, "_grp", "left").withColumn("_moves", F.coalesce(F.col("_to") != F.col("shard"), F.lit(False)))
        asked = checkpoint(asked)
        loose = {r.shard: r.n for r in asked.where("_grp IS NULL").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        demand = {(r.shard, r._to): r.n for r in asked.where("_moves").groupBy("shard", "_to").agg(F.count("*").alias("n")).collect()}
        flow = accepted(demand, loose, shards)
        idle = 0 if flow else idle + 1
        if not demand or idle == IDLE:
            break
        if not flow:
            continue
        way = F.col("shard") * shards + F.col("_to")
        movers = numbered(asked.where("_moves").withColumn("_way", way), "_way", "_place", ["doc_id", "_r"], 62 - F.floor(F.log2("_gain")).cast("int"), parts=max(1, parts // shards))
        places = F.element_at(F.create_map(*(F.lit(x) for s, t in demand for x in (s * shards + t, flow.get((s, t), 0)))), F.col("_way"))
        movers = checkpoint(movers.withColumn("_taken", F.col("_place") < places).drop("_way"))
        over = {s: sum(n for (_, t), n in flow.items() if t == s) - sum(n for (f, _), n in flow.items() if f == s) for s in range(shards)}
        keep = ["_to", "_gain", "_moves"]
        moved = movers.withColumn("shard", F.when(F.col("_taken"), F.col("_to")).otherwise(F.col("shard"))).drop(*keep, "_place", "_taken")
        rest = asked.where("NOT _moves AND _grp IS NOT NULL").drop(*keep)
        singles = numbered(asked.where("_grp IS NULL").drop(*keep), "shard", "_out", ["doc_id", "_r"], parts=max(1, parts // shards))
        # the first `over` unlinked rows of a shard that took more than it gave go to those that gave more
        starts, at = {}, 0
        for s in range(shards):
            starts[s] = at
            at += max(0, over[s])
        fill, at = F.lit(None).cast("int"), 0
        spot = F.col("_out") + _by_shard(starts)
        for s in range(shards):
            if over[s] < 0:
                fill = F.when((spot >= at) & (spot < at - over[s]), F.lit(s)).otherwise(fill)
                at -= over[s]
        leaves = F.col("_out") < _by_shard({s: max(0, over[s]) for s in range(shards)})
        singles = singles.withColumn("shard", F.when(leaves, fill).otherwise(F.col("shard"))).drop("_out")
        state = checkpoint(moved.unionByName(rest).unionByName(singles))
    return state.drop("_grp", "_r")


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, grp) for each row of docs, by the law `rows`.

    size: UTF-8 bytes of the text plus 1 (null: 1); text_crc32 of a null text is that of no bytes. Equal texts
    are linked; null texts are linked with nothing. slot numbers a shard's rows from 0 without gaps.
    """
    facts = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("grp"),
    )
    facts = checkpoint(facts)
    placed = numbered(shard(facts, shards, rounds), "shard", "slot", ["doc_id", "text_crc32"], parts=max(1, PARTS // shards, -(-facts.count() // (shards * PART_ROWS))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "grp")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("grp")

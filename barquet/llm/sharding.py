"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on a ring, and goes clockwise to the next virtual node. A shard takes no
more than its share; keys beyond it go on clockwise to the next shard with room. So loads are equal
to within one row, and only the overflow of the ring's unevenness moves, not every row.

Rows are counted by ring cell, a fixed number of cells whatever the data. From these counts the
flow of the overflow around the ring follows: a plan of row ranges per virtual node, as long as the
number of virtual nodes allows. Each row then finds its rank, its node's plan, its shard and its slot.
DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of the ring, as a power of two. A cell's rows are ranked in one task.
RING_BITS = 16


def ring(shards: int, virtual_nodes: int) -> dict[int, int]:
    """The shard of each virtual node by the cell in which the node ends; cells without a node belong to the next one's."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for i in range(virtual_nodes):
            cell = (shard * virtual_nodes + i) * 0x9E3779B97F4A7C15 % 2**64
            cell = (cell ^ (cell >> 31)) * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - RING_BITS)
            while cell in nodes:
                cell = (cell + 1) % 2**RING_BITS
            nodes[cell] = shard
    return nodes


def flow(counts: dict[int, int], nodes: dict[int, int], room: dict[int, int]) -> list[dict[str, int]]:
    """Ranges of each node's keys and the shard that takes them: node, low, high (rank, exclusive), shard, base (slot of the first)."""
    left, used, plan, over = dict(room), dict.fromkeys(room, 0), [], {}

    def take(node: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, left[shard])
        if n:
            plan.append({"node": node, "low": low, "high": low + n, "shard": shard, "base": used[shard]})
            left[shard] -= n
            used[shard] += n
        return low + n

    for node in sorted(nodes):
        got = take(node, 0, counts.get(node, 0), nodes[node])
        if got < counts.get(node, 0):
            over[node] = got
    order = sorted(nodes)
    for node in sorted(over):
        at, low = order.index(node), over[node]
        for step in range(1, len(order) + 1):
            if low == counts[node]:
                break
            low = take(node, low, counts[node], nodes[order[(at + step) % len(order)]])
    return plan


def shard_rows(df: DataFrame, key: str, shards: int, virtual_nodes: int = 64) -> DataFrame:
    """``df`` and shard int, from 0, and slot long, gapless from 0 in each shard; counts of shards are at most one apart.

    A key's place on the ring is its hash. Keys that overflow are those whose hashes are the last before their
    virtual node; equal keys are ranked by the other columns as JSON. Null is a key like any
    other. Rows repeated in all columns are interchangeable, and each gets its own slot. More shards than
    rows leave shards empty; an empty table gives an empty one. Columns shard and slot of ``df`` are replaced.
    """
    if not 0 < shards * virtual_nodes <= 2 ** (RING_BITS - 2):
        raise ValueError(f"{shards * virtual_nodes} virtual nodes don't fit {2**RING_BITS} cells")
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    place = F.xxhash64(key)
    nodes = ring(shards, virtual_nodes)
    ends = F.array(*[F.lit(c) for c in sorted(nodes)])
    cell = F.shiftrightunsigned(place, 64 - RING_BITS).cast("int")

    cells = df.groupBy(cell.alias("cell")).count()
    # The next node clockwise; beyond the last one the ring begins anew.
    next_node = F.coalesce(F.get(F.filter(ends, lambda e: e >= F.col("cell")), 0), F.lit(min(nodes)))
    cells = cells.withColumn("node", next_node)
    # Cells after the last node come before cell 0 for the first one.
    turn = F.when(F.col("cell") > max(nodes), F.col("cell") - 2**RING_BITS).otherwise(F.col("cell"))
    cells = cells.withColumn("before", F.sum("count").over(W.partitionBy("node").orderBy(turn)) - F.col("count"))

    counts = {r["node"]: r["n"] for r in cells.groupBy("node").agg(F.sum("count").alias("n")).collect()}  # a row per virtual node
    total = sum(counts.values())
    plan = flow(counts, nodes, {s: total // shards + (s < total % shards) for s in range(shards)})
    ranges = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<node:int,low:long,high:long,shard:int,base:long>>")).alias("p"))
    ranges = ranges.select(F.col("p.node").alias("p_node"), "p.low", "p.high", F.col("p.shard").alias("shard"), "p.base")

    rows = df.select(F.struct(*columns).alias("row"), place.alias("place"), cell.alias("cell"))
    rows = rows.join(F.broadcast(cells.drop("count")), "cell")  # as many rows as the ring has cells
    in_cell = W.partitionBy("cell").orderBy("place", F.to_json("row"))
    rows = rows.withColumn("rank", F.col("before") + F.row_number().over(in_cell) - 1)
    placed = rows.join(F.broadcast(ranges), (F.col("node") == F.col("p_node")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("row.*", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))

"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import Scratch, durable, few

#: So many edges, a fixed number, are contracted in one task; of more, rounds are made until no more are left.
LAST = 1 << 18


def _settled(edges: DataFrame) -> DataFrame:
    """(to, end) of a few edges: each node and the smallest one that it reaches."""

    def settle(batches):
        ends: dict[int, int] = {}

        def end(x: int) -> int:
            ends.setdefault(x, x)
            while ends[x] != x:
                ends[x] = ends[ends[x]]
                x = ends[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = end(a), end(b)
                ends[max(a, b)] = min(a, b)
        nodes = list(ends)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([end(x) for x in nodes], pa.int64())], names=["to", "end"])

    return edges.coalesce(1).mapInArrow(settle, "to long, end long")


def _ordered(edges: DataFrame, keep: Scratch) -> DataFrame:
    return keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges to (node, component): the smallest node that each node reaches.

    The graph is contracted in rounds: each node points to the first of its neighbours and itself, in the
    order of a hash; pointers are followed two steps; edges are rewritten to where they end, until
    none is left. By hashes pointer paths are short whatever the ids, so the rounds grow with the logarithm
    of the number of nodes. First neighbours are aggregated before they are shuffled, and all joins
    are of written tables, so that Spark can split a node with many edges; every round is
    written to the shared checkpoint folder, and deleted when the next one is. The last ``LAST`` edges are contracted
    at once: rounds on few rows cost the driver threads and plans, whatever their size. No edges give no rows.
    """
    keep, rounds = Scratch(), Scratch()
    edges = _ordered(edges, rounds)
    moves = []
    while n := edges.count():
        if n <= LAST:
            moves.append(keep(_settled(edges)))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        nearest = both.select("a", F.least(place("a"), place("b")).alias("p")).groupBy("a").agg(F.min_by("p.n", "p.h").alias("to"))
        parents = rounds(nearest.select(F.col("a").alias("node"), "to"))
        moved = keep(parents.join(parents.select(F.col("node").alias("to"), F.col("to").alias("end")), "to").select(F.col("node").alias("to"), "end"))
        moves.append(moved)
        for c in ("a", "b"):
            edges = edges.join(moved.withColumnRenamed("to", c), c).drop(c).withColumnRenamed("end", c)
        old = tuple(rounds.kept)
        edges = _ordered(edges, rounds)
        rounds.release(*old)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves[0].toDF("node", "to")
    for moved in moves[1:]:
        found = found.join(moved, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    found = durable(few(found))
    keep.release()
    rounds.release()
    lowest = durable(few(found.groupBy("to").agg(F.min("node").alias("component"))))
    return found.join(lowest, "to").select("node", "component")

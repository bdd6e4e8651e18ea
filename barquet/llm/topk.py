"""Exact top-k inner products with block-max pruning.

Vectors are documents, their dimensions terms. Documents lie in blocks of consecutive ids; a block
has a forward index (its integer matrix) and the maximum and minimum of each term. For a query the sum
over terms of the larger product with the two bounds every score in the block. Each task takes
its blocks in windows of bounded size, orders a window's blocks by bound for each query, scores a block at
a time and stops once a query's bounds fall below its k-th score so far. Tasks' best meet by query.

The stated queries are broadcast in chunks of bounded size, one pass over the blocks each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The range of scores; a score beyond it counts as its end.
LOWEST, HIGHEST = np.iinfo(np.int64).min + 2, np.iinfo(np.int64).max


def _matrix(lists: list[list[float]], scale: float, width: int) -> np.ndarray:
    """Integer components. One beyond 2**62 counts as that: times anything but 0 or 1 it is beyond the range of scores."""
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = np.clip(np.floor(np.asarray(v, np.float64)[:width] * scale), -(2.0**62), 2.0**62)
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point or 64 bits only while every sum stays exact, else by Python's integers."""
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST, HIGHEST).astype(np.int64)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.size or max(abs(int(x)) for m in (a, b) for x in (m.min(), m.max())) < 1 << 62:
        return a + b
    return np.clip(a.astype(object) + b.astype(object), LOWEST, HIGHEST).astype(np.int64)


def _better(scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of both by score, then smaller id, per row."""
    s, d = np.concatenate([scores, more_scores], 1), np.concatenate([ids, more_ids], 1)
    best = np.lexsort((d, -s), axis=1)[:, :k]
    return np.take_along_axis(s, best, 1), np.take_along_axis(d, best, 1)


_NONE = np.iinfo(np.int64).min + 1


class _Search:
    """Best results of all queries so far over the blocks of one task."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, block_rows: int):
        self.query_ids, self.queries, self.k, self.block_rows = query_ids, queries, k, block_rows
        self.scores = np.full((len(query_ids), k), _NONE)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.scored = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        cuts = np.arange(self.block_rows, len(ids), self.block_rows)
        blocks = list(zip(np.split(ids, cuts), np.split(rows, cuts), strict=True))
        most, least = (np.array([f(m, axis=0) for _, m in blocks]) for f in (np.max, np.min))
        up, down = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        halves = _dot(up, most), _dot(down, least)
        # A half at an end of the range may be any amount beyond it, which the other half doesn't make up for: no bound is known.
        beyond = np.any([(h >= HIGHEST) | (h <= LOWEST) for h in halves], axis=0)
        bounds = np.where(beyond, HIGHEST, _sum(*halves))
        order = np.argsort(-bounds, axis=1, kind="stable")
        for step in range(len(blocks)):
            block = order[:, step]
            # A bound that equals the k-th score may hide a smaller id of that score.
            live = np.flatnonzero(bounds[np.arange(len(block)), block] >= self.scores[:, -1])
            if not len(live):
                break
            for b in np.unique(block[live]):
                self._score(live[block[live] == b], *blocks[b])

    def _score(self, which: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.scored += len(which) * len(ids)
        got = _dot(self.queries[which], rows)
        own = self.query_ids[which][:, None] == ids[None, :]
        got[own] = _NONE
        there = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, got.shape))
        self.scores[which], self.ids[which] = _better(self.scores[which], self.ids[which], got, there, self.k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block_rows: int = 256, window_blocks: int = 64, query_chunk: int = 50_000) -> DataFrame:
    """The ``k`` best of ``vectors`` for each of ``queries`` by inner product of floor(scale * component).

    Both: vec_id and embedding (array of numbers); other columns are left out. A row with the query's own
    vec_id is no candidate. Vectors that are null, or hold null or non-finite components, take no
    part, on either side. Of vectors of unlike lengths the shorter is filled up with zeros, the longer cut to the
    longest query; an empty one scores 0. Ties go to smaller vec_ids; repeated rows rank each. Fewer than k
    candidates give all. Rows that repeat a query count once; of unlike vectors under one query's vec_id each has a ranking, and
    the best k of these together are returned. Returns query_id, rank (from 1), vec_id, score; a score
    beyond the range of a long counts as the end of it.

    Every pair is scored or excluded by its bound. query_chunk bounds what is broadcast; a larger query set takes more passes.
    """
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid)
    spark, kept = vectors.sparkSession, pick(vectors)
    asked = pick(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).distinct()
    n = asked.count()
    width = (asked.agg(F.max(F.size("query"))).first()[0] or 0) if n else 0
    chunks = max(1, -(-n // query_chunk))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    out = None
    for c in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c).collect()  # about query_chunk
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), _matrix([r[1] for r in rows], scale, width)))

        def search(batches, sent=sent):
            query_ids, matrix = sent.value
            found, ids, mats = _Search(query_ids, matrix, k, block_rows), [], []
            for batch in batches:
                ids.append(batch["vec_id"].to_numpy())
                mats.append(_matrix(batch["embedding"].to_pylist(), scale, width))
                if sum(map(len, ids)) >= block_rows * window_blocks:
                    found.add(np.concatenate(ids), np.concatenate(mats))
                    ids, mats = [], []
            if len(query_ids) and sum(map(len, ids)):
                found.add(np.concatenate(ids), np.concatenate(mats))
            real = found.scores != _NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query_ids[:, None], real.shape)[real]), pa.array(found.ids[real]), pa.array(found.scores[real])], names=["query_id", "vec_id", "score"])

        part = ranged.mapInArrow(search, "query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

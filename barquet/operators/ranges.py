"""Ordered work on keys of any size.

The rows of all keys are dealt to tasks by ranges of key and order, so that a key with many rows is spread
over many tasks. What a range has to know of those before it (sums, a maximum, a recursive mean) is first summed up
range by range; the few sums of a key are scanned in order, and joined back to the rows. ``parted`` leaves such
work to the keys that need it: those of few rows are clustered and sorted once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.operators.checkpoints import kept
from barquet.operators.scan import ordered_scan

ROWS = 1 << 18


def ranged(df: DataFrame, keys: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` and part: ranges of about ``rows`` rows in the order of keys and ``order``, which has to tell a key's rows apart for a split.

    Rows are written once, as ranges are drawn by a sample and have to stay as they are. A null key is a key, nulls are first.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return kept(df.repartitionByRange(n, *keys, *order).withColumn("part", F.spark_partition_id()))


def parted(df: DataFrame, keys: list[str], rows: int = ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without the keys of more than ``rows`` rows, each of which a task can take whole, and the rows of those keys, if there are any.

    Keys are counted before; there are at most as many large ones as the table has multiples of ``rows``.
    """
    large = kept(df.groupBy(*keys).count().where(F.col("count") > rows).select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    if large.isEmpty():
        return df, None
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(F.broadcast(large), same, "left_anti"), df.join(F.broadcast(large), same, "left_semi")


def within(keys: list[str], order: list[str]) -> WindowSpec:
    """Rows of a key's range up to the current one."""
    return W.partitionBy(*keys, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def earlier(keys: list[str]) -> WindowSpec:
    """Of a key's ranges those before the current one."""
    return W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)


def rejoined(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``sums`` has for their key and range; null keys meet too."""
    on = [*keys, "part"]
    renamed = sums.withColumnsRenamed({k: f"_k_{k}" for k in on})
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on]).drop(*[f"_k_{k}" for k in on])


def numbered(rows: DataFrame, keys: list[str], order: list[str], before: dict[str, str]) -> DataFrame:
    """Ranged ``rows`` with n, the row's number in its key from 1, and columns of the row before: ``before`` has new names and columns."""
    w = W.partitionBy(*keys, "part").orderBy(*order)
    local = rows.withColumns({"n": F.row_number().over(w)} | {f"_own_{k}": F.lag(c).over(w) for k, c in before.items()})
    last = F.struct(*[F.col(c).alias(k) for k, c in before.items()]) if before else F.struct(F.lit(0).alias("_"))
    sums = rows.groupBy(*keys, "part").agg(F.count("*").alias("_rows"), F.max_by(last, F.struct(*order)).alias("_last"))
    sums = sums.select(*keys, "part", F.coalesce(F.sum("_rows").over(earlier(keys)), F.lit(0)).alias("_rows"), F.lag("_last").over(W.partitionBy(*keys).orderBy("part")).alias("_last"))
    out = rejoined(local, sums, keys)
    first = F.col("n") == 1
    out = out.withColumns({k: F.when(first, F.col("_last")[k]).otherwise(F.col(f"_own_{k}")) for k in before})
    return out.withColumn("n", (F.col("n") + F.col("_rows")).cast("int")).drop("_rows", "_last", *[f"_own_{k}" for k in before])


def _slices(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches of sorted rows, cut where the key changes, with their keys."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            codes = batch[k].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change |= codes[1:] != codes[:-1]
        cuts = (np.flatnonzero(change) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(batch[k][i].as_py() for k in keys), batch.slice(i, j - i)


def _composed(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """The map y -> a y + b that all rows make together."""
    after = np.concatenate([np.cumprod(a[:0:-1])[::-1], [1.0]])  # what the rows after each one make of its b
    return float(a[0] * after[0]), float(b @ after)


class _Chain:
    """Carries values over the ranges of a key."""

    def __init__(self, names: list[str], ends: bool):
        self.names, self.ends, self.values = names, ends, [0.0] * len(names)

    def step(self, row):
        if not self.ends:
            yield (row["part"], *self.values)
        self.values = [row[f"_a_{c}"] * y + row[f"_b_{c}"] for c, y in zip(self.names, self.values, strict=True)]

    def finish(self):
        if self.ends:
            yield tuple(self.values)


def _compositions(rows: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Per key and range, the map of each name that all of its rows make together."""
    by = [*keys, "part"]
    schema = T.StructType([*rows.select(*by).schema, *[T.StructField(f"_{x}_{c}", T.DoubleType()) for c in names for x in "ab"]])

    def composed(batches):
        current, maps = None, []

        def row():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*current, *[x for m in maps for x in m]), strict=True))], schema=arrow)

        arrow = None
        for key, batch in _slices(batches, by):
            if arrow is None:
                arrow = pa.schema([*(batch.schema.field(k) for k in by), *[pa.field(n, pa.float64()) for n in schema.names[len(by) :]]])
            if current is not None and key != current:
                yield row()
            if key != current:
                current, maps = key, [(1.0, 0.0)] * len(names)
            new = [_composed(batch[f"_a_{c}"].to_numpy(), batch[f"_b_{c}"].to_numpy()) for c in names]
            maps = [(a * x, a * y + b) for (a, b), (x, y) in zip(new, maps, strict=True)]
        if current is not None:
            yield row()

    return rows.sortWithinPartitions(*by, *order).select(*by, *[f"_{x}_{c}" for c in names for x in "ab"]).mapInArrow(composed, schema)


def _with_maps(rows: DataFrame, maps: dict[str, tuple[Column, Column]]) -> DataFrame:
    return rows.withColumns({f"_a_{c}": F.coalesce(a.cast("double"), F.lit(1.0)) for c, (a, _) in maps.items()} | {f"_b_{c}": F.coalesce(b.cast("double"), F.lit(0.0)) for c, (_, b) in maps.items()})


def _clustered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key's range in one task, however they came."""
    return rows.repartition(*keys, "part")


def affine(rows: DataFrame, keys: list[str], order: list[str], maps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Ranged ``rows`` with a column per name: y after the row, where each row makes a y + b of the y before it, from 0 on.

    Exponential and Wilder's means, and average costs, are of this form. Such maps compose to one such map, so the start of each range follows from a
    scan over ranges, and ranges run side by side. A null a is 1, a null b is 0. Differs from one scan in the last digits only.
    """
    names = list(maps)
    mapped = _with_maps(rows, maps)
    chunks = _compositions(_clustered(mapped, keys), keys, order, names)
    starts = ordered_scan(chunks, keys, ["part"], ["part", *[f"_{x}_{c}" for c in names for x in "ab"]], lambda *_: _Chain(names, False), T.StructType([rows.schema["part"], *[T.StructField(f"_y_{c}", T.DoubleType()) for c in names]]))
    by = [*keys, "part"]
    joined = _clustered(rejoined(mapped, starts, keys), keys).sortWithinPartitions(*by, *order)
    own = [f for f in rows.columns if f not in names]
    schema = T.StructType([*rows.select(*own).schema, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches):
        current, at = None, []
        for key, batch in _slices(batches, by):
            if key != current:
                current, at = key, [batch[f"_y_{c}"][0].as_py() for c in names]
            values = []
            for i, c in enumerate(names):
                ys = list(accumulate(zip(batch[f"_a_{c}"].to_pylist(), batch[f"_b_{c}"].to_pylist(), strict=True), lambda y, m: m[0] * y + m[1], initial=at[i]))
                at[i] = ys[-1]
                values.append(pa.array(ys[1:], pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), *values], names=[*own, *names])

    return joined.mapInArrow(run, schema)


def affine_end(rows: DataFrame, keys: list[str], order: list[str], maps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The last values of ``affine`` for each key; no row needs its own value."""
    names = list(maps)
    chunks = _compositions(_clustered(_with_maps(rows, maps), keys), keys, order, names)
    return ordered_scan(chunks, keys, ["part"], ["part", *[f"_{x}_{c}" for c in names for x in "ab"]], lambda *_: _Chain(names, True), T.StructType([T.StructField(c, T.DoubleType()) for c in names]))

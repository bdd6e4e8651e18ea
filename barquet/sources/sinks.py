"""Writing: text files in order, and tables whose bad rows are set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """A folder of text parts that read one after another in ``order``."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written, and the others; an unknown validity is none."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def write_candles(bars: DataFrame, path: str) -> None:
    """Partitioned by interval and symbol, in order of time within files: scans of a series prune folders and skip row groups."""
    bars.repartition("interval", "symbol").sortWithinPartitions("interval", "symbol", "ts").write.mode("overwrite").partitionBy("interval", "symbol").parquet(path)


def evicted(cache: DataFrame, now: int, most: int = 50) -> DataFrame:
    """Cache entries (key, interval, fetched_at in ms) that are to go: past an hour within a day's intervals, six hours otherwise, and the oldest beyond ``most``.

    The ``most`` newest live ones are found by a top-n, not by sorting the cache in one task.
    """
    life = F.when(F.col("interval").isin("1d", "1w", "1M"), 21_600_000).otherwise(3_600_000)
    live = cache.where(F.lit(now) - F.col("fetched_at") < life)
    kept = live.orderBy(F.desc("fetched_at"), "key").limit(most)
    return cache.join(kept.select("key"), "key", "left_anti")

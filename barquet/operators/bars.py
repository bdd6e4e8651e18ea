"""OHLCV bars: rollup, scans, gaps, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.config import INTERVAL_MS

KEYS = ["symbol", "interval"]


def align(ts: Column, interval: str) -> Column:
    """The start of the interval that holds ``ts`` (ms); an unknown interval is an error."""
    ms = INTERVAL_MS[interval]
    return (F.floor(ts / ms) * ms).cast("long")


def rollup(ticks: DataFrame, interval: str) -> DataFrame:
    """Ticks (symbol, ts in ms, event_id, price) to bars; the volume is the count of ticks, and bars without ticks don't exist.

    Map-side aggregation leaves a row per task and bar to shuffle, however many ticks a symbol has. Time and id are one
    decimal, as Spark aggregates by hash only over types of a fixed width; of a struct it would sort all ticks.
    """
    at = F.col("ts").cast("decimal(19,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + F.col("event_id").cast("decimal(19,0)")
    bars = ticks.withColumn("bar", align(F.col("ts"), interval)).groupBy("symbol", "bar").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.lit(interval).alias("interval"), F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars to longer bars."""
    out = bars.withColumn("bar", align(F.col("ts"), interval)).groupBy("symbol", "bar").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum(F.col("volume").cast("decimal(28,8)")).cast("double").alias("volume")
    )
    return out.select("symbol", F.lit(interval).alias("interval"), F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def between(bars: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars in a closed range of which either end may be open."""
    if start is not None:
        bars = bars.where(F.col("ts") >= start)
    return bars if end is None else bars.where(F.col("ts") <= end)


def scan(bars: DataFrame, start: int | None = None, end: int | None = None, limit: int = 500) -> DataFrame:
    """At most ``limit`` bars of each series: the first from ``start`` on, or the latest if there is no start."""
    time = F.col("ts")
    w = W.partitionBy(*KEYS).orderBy(time.desc() if start is None else time)
    return between(bars, start, end).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def extent(bars: DataFrame) -> DataFrame:
    """First and last time and number of bars of each series."""
    return bars.groupBy(*KEYS).agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count("*").alias("bars"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same key; of more new rows the last by ``seq`` wins."""
    rank = F.lit(1) if seq is None else F.row_number().over(W.partitionBy(*keys).orderBy(F.col(seq).desc()))
    last = new.withColumn("_n", rank).where("_n = 1").select(existing.columns)
    return existing.join(last.select(*keys), keys, "left_anti").select(existing.columns).unionByName(last)


def inserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys of ``new`` are not in ``existing``: a row with n."""
    return new.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti").agg(F.count("*").alias("inserted"))


def missing_ranges(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Ranges to fetch so that each series spans ``start`` to ``end``: before its oldest and after its newest bar; inner gaps are left."""
    e = extent(bars)
    head = e.where(F.col("oldest") > start).select(*KEYS, F.lit("head").alias("part"), F.lit(start).cast("long").alias("from"), (F.col("oldest") - 1).alias("to"))
    tail = e.where(F.col("newest") < end).select(*KEYS, F.lit("tail").alias("part"), (F.col("newest") + 1).alias("from"), F.lit(end).cast("long").alias("to"))
    return head.unionByName(tail)


def missing_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Bars that a series lacks between its first and last."""
    ms = INTERVAL_MS[interval]
    every = extent(bars).select(*KEYS, F.explode(F.sequence("oldest", "newest", F.lit(ms))).alias("ts"))
    return every.join(bars.select(*KEYS, "ts"), [*KEYS, "ts"], "left_anti")


def retained(bars: DataFrame, now: int) -> DataFrame:
    """Bars that are not past their retention: 7 days for 1m, 14 for 5m, all others for good."""
    days = F.create_map(F.lit("1m"), F.lit(7), F.lit("5m"), F.lit(14))[F.col("interval")]
    return bars.where(days.isNull() | (F.col("ts") > now - days * 86_400_000))


def newer(bars: DataFrame, existing: DataFrame) -> DataFrame:
    """Bars after the newest of their series in ``existing``; all of a series that it lacks."""
    last = existing.groupBy(*KEYS).agg(F.max("ts").alias("_last"))
    return bars.join(last, KEYS, "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")

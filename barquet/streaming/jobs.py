"""Streams of ticks: parsing, bars, latest prices, alerts, limits, idempotent days, and writing them by key.

Ticks have symbol, ts (TIMESTAMP), event_id and price. Bars and duplicates are dropped from the state once the watermark has
passed them; later ticks are lost to them. ``DELAY`` is this package's own default.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barquet.config import INTERVAL_MS
from barquet.operators.bars import upsert
from barquet.operators.limiter import Limiter
from barquet.sources.tables import epoch_ms

A = TypeVar("A")
DELAY = "10 minutes"

#: Fields of an exchange's 24h ticker message; numbers come as text.
TICKER = T.StructType([T.StructField(c, T.StringType()) for c in ("s", "c", "o", "h", "l", "v", "q")] + [T.StructField("E", T.LongType())])

#: Fields of an exchange's bar message: the bar, and whether it is closed.
KLINE = T.StructType([T.StructField(c, T.StringType()) for c in ("s", "i", "o", "h", "l", "c", "v")] + [T.StructField("t", T.LongType()), T.StructField("x", T.BooleanType())])


def parse_tickers(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to symbol, ts, price, open, high, low, volume, quote_volume; what can't be parsed, or has no symbol or price, is dropped."""
    m = messages.select(F.from_json(F.col(column).cast("string"), TICKER).alias("m")).select("m.*")
    number = lambda c: F.col(c).try_cast("double")
    out = m.select(F.col("s").alias("symbol"), F.timestamp_millis("E").alias("ts"), number("c").alias("price"), number("o").alias("open"), number("h").alias("high"), number("l").alias("low"), number("v").alias("volume"), number("q").alias("quote_volume"))
    return out.where("symbol is not null and price is not null")


def parse_klines(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to symbol, interval, ts in ms, open, high, low, close, volume and closed, false until the bar's last message.

    What can't be parsed, or has no symbol, time or close, is dropped; a missing flag counts as not closed.
    """
    m = messages.select(F.from_json(F.col(column).cast("string"), T.StructType([T.StructField("k", KLINE)])).alias("m")).select("m.k.*")
    numbers = [F.col(c).try_cast("double").alias(name) for c, name in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)]
    out = m.select(F.col("s").alias("symbol"), F.col("i").alias("interval"), F.col("t").alias("ts"), *numbers, F.coalesce("x", F.lit(False)).alias("closed"))
    return out.where("symbol is not null and ts is not null and close is not null")


def _bars(ticks: DataFrame, interval: str, delay: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    width = f"{INTERVAL_MS[interval]} milliseconds"
    grouped = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return grouped.select("symbol", F.lit(interval).alias("interval"), F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def bars(ticks: DataFrame, interval: str = "1m", delay: str = DELAY) -> DataFrame:
    """Tumbling bars of a stream. In append mode a bar comes once, when it is closed; in update mode whenever it changes."""
    return _bars(ticks, interval, delay)


def latest(ticks: DataFrame) -> DataFrame:
    """The newest tick of each symbol: a state of one row a symbol. For update or complete mode."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "event_id", "price"), F.struct("ts", "event_id")).alias("t")).select("symbol", "t.ts", "t.event_id", "t.price")


def once_per_day(rows: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of each key and day; a repeated run of a day adds nothing. A day leaves the state when the watermark has passed its end.

    The watermark stands on a copy of ``ts``, as the state is dropped by that of the day alone.
    """
    dated = rows.withColumn("_at", F.col("ts")).withWatermark("_at", delay).withColumn("_day", F.window("_at", "1 day")).drop("_at")
    day = F.date_from_unix_date(F.floor(F.unix_millis("ts") / 86_400_000).cast("int"))
    return dated.dropDuplicates([*keys, "_day"]).withColumn("day", day).drop("_day")


class _LimitState(StatefulProcessor):
    """Admitted times of a key in the window."""

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("admitted", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        held = self.state.get() if self.state.exists() else None
        limiter = Limiter(self.most, self.window_ms, list(held[0]) if held else None)
        out = [(key[0], int(t), int(s), *limiter.ask(int(t))) for t, s in zip(batch["ts"], batch["seq"], strict=True)]
        self.state.update((list(limiter.admitted),))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "success", "remaining", "reset"])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, most: int, window_ms: int) -> DataFrame:
    """Requests (key, ts in ms, seq) with success, remaining and reset; state is kept in the RocksDB store."""
    schema = "key long, ts long, seq long, success boolean, remaining int, reset long"
    return requests.groupBy("key").transformWithStateInPandas(_LimitState(most, window_ms), outputStructType=schema, outputMode="Append", timeMode="None")


def _file(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def upsert_to(path: str, keys: list[str], seq: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps a folder of Parquet versions, each the last with a batch's rows in place of those with the same key.

    Of a batch's rows with one key the last by ``seq`` wins; without it a batch must have a row a key, as aggregates in update mode do.
    A repeated batch writes its version anew, so that a restart changes nothing. The newest two versions are kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={batch_id - 1}") if batch_id else batch.limit(0)
        upsert(old, batch, keys, seq).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        files, gone = _file(spark, f"{path}/v={batch_id - 2}")
        files.delete(gone, True)

    return write


def restarting(start: Callable[[], StreamingQuery], wait: float = 3.0, most: int = 5, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a stream to its end and starts it anew when it fails, after ``wait`` seconds, then twice as many, and so on.

    A run that has processed a batch begins the count anew. After ``most`` failures in a row the last error is raised.
    Returns how often it was started anew. The query goes on from its checkpoint.
    """
    failures = restarts = 0
    while True:
        q = start()
        try:
            q.awaitTermination()
            return restarts
        except StreamingQueryException:
            failures = 1 if q.recentProgress else failures + 1
            if failures > most:
                raise
            sleep(wait * 2 ** (failures - 1))
            restarts += 1


def single_flight(spark: SparkSession, marker: str, task: Callable[[], A]) -> A | None:
    """The task's result, or None, without running it, while another run holds ``marker``, a file in a shared folder.

    The file system makes the file for one run only. A run that fails gives it back; after a lost driver it has to be deleted.
    """
    files, at = _file(spark, marker)
    if not files.createNewFile(at):
        return None
    try:
        return task()
    finally:
        files.delete(at, False)


def run_available(df: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over all that is there now, then stops; a later call goes on from its checkpoint under ``folder``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", f"{folder}/rows")
    q = w.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def read_ticks(spark: SparkSession, sf_dir: str, symbol: Column | None = None, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of ticks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return raw.select((F.col("event_type") if symbol is None else symbol).alias("symbol"), F.timestamp_millis(epoch_ms("ts")).alias("ts"), "event_id", F.col("value").alias("price"), "user_id")


def alerts(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """Ticks that cross a level (alert_id, symbol, type price_above or price_below, target): a join with a static table."""
    j = ticks.join(levels.select("alert_id", "symbol", "type", "target"), "symbol")
    return j.where(((F.col("type") == "price_above") & (F.col("price") >= F.col("target"))) | ((F.col("type") == "price_below") & (F.col("price") <= F.col("target"))))

"""Readers of exchange payloads: rows of text and positional arrays to typed tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def klines(rows: DataFrame, symbol: Column, interval: str, column: str = "k") -> DataFrame:
    """Positional arrays of text (open time, open, high, low, close, volume, ...) to candles; times are ms."""
    at = lambda i: F.get(column, i)
    return rows.select(
        symbol.alias("symbol"), F.lit(interval).alias("interval"), at(0).try_cast("long").alias("ts"), *[_number(at(i)).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)]
    )


def read_klines(spark: SparkSession, path: str, symbol: str, interval: str) -> DataFrame:
    """A file or folder of JSON arrays of klines, one array of klines per line."""
    lines = spark.read.text(path).select(F.explode(F.from_json("value", "array<array<string>>")).alias("k"))
    return klines(lines, F.lit(symbol), interval)


def tickers(rows: DataFrame, quote: str = "USDT") -> DataFrame:
    """24h tickers whose symbol ends in ``quote``; prices and volumes come as text."""
    numbers = {c: _number(c) for c in rows.columns if c != "symbol"}
    return rows.withColumns(numbers).where(F.endswith("symbol", F.lit(quote)))


def symbols(rows: DataFrame, quote: str = "USDT") -> DataFrame:
    """Symbols that trade against ``quote``: symbol, base_asset, quote_asset."""
    return rows.where((F.col("status") == "TRADING") & (F.col("quote_asset") == quote)).select("symbol", "base_asset", "quote_asset")


def price_map(prices: DataFrame, wanted: list[str]) -> DataFrame:
    """One row with a map of the wanted symbols' prices; as many entries as symbols are asked for."""
    own = prices.where(F.col("symbol").isin(*wanted))
    return own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "price")))).alias("prices"))


def futures(rows: DataFrame, time: str, *values: str) -> DataFrame:
    """A futures series: symbol, ts (ms) and values from text. Funding rates, open interest and long/short ratios all have this form."""
    return rows.select("symbol", F.col(time).try_cast("long").alias("ts"), *[_number(v).alias(v) for v in values])


def fear_greed(rows: DataFrame) -> DataFrame:
    """value (text), value_classification and timestamp (seconds, text) to ts (ms), value, label; what isn't a number is dropped."""
    out = rows.select((F.col("timestamp").try_cast("long") * 1000).alias("ts"), F.col("value").try_cast("int").alias("value"), F.col("value_classification").alias("label"))
    return out.where("ts is not null and value is not null")


def sine_market(spark: SparkSession, points: int, base: float = 100.0, swing: float = 10.0, start: int = 0, step_ms: int = 3_600_000) -> DataFrame:
    """A made-up price series on a sine wave: ts and price."""
    i = F.col("id")
    return spark.range(points).select((F.lit(start) + i * step_ms).alias("ts"), (base + swing * F.sin(i / 10.0)).alias("price"))

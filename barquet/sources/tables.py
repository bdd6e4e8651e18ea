"""Domain tables derived from the test tables, and the same derivations as SQL.

Prices, amounts and values of the test tables have two decimals; sums that results depend on are
taken over decimals, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.config import INTERVAL_MS
from barquet.operators.bars import rollup

EXACT = "decimal(28,8)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def ticks(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    """symbol, ts (ms), event_id, price of each event; one symbol for all if ``pooled``."""
    symbol = F.lit("ALL") if pooled else F.col("event_type")
    return read(spark, sf_dir, "events").select(symbol.alias("symbol"), epoch_ms("ts").alias("ts"), "event_id", F.col("value").alias("price"))


def candles(spark: SparkSession, sf_dir: str, interval: str = "1h", pooled: bool = False) -> DataFrame:
    return rollup(ticks(spark, sf_dir, pooled), interval)


def candles_sql(interval: str = "1h", pooled: bool = False) -> str:
    """A SELECT with the columns of ``candles``."""
    ms, symbol = INTERVAL_MS[interval], "'ALL'" if pooled else "event_type"
    return f"""SELECT {symbol} AS symbol, '{interval}' AS interval, (epoch_us(ts) // 1000) // {ms} * {ms} AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2, 3"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, type, quantity, price, fee, date (ms), seq: returned items are sales; seq orders a symbol's rows of one day."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("type"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.lit(0.0).alias("fee"),
        epoch_ms("l_shipdate").alias("date"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("seq"),
    )


TRANSACTIONS_SQL = """SELECT CAST(l_partkey AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS type, l_quantity AS quantity, l_extendedprice / l_quantity AS price,
  CAST(0 AS DOUBLE) AS fee, (epoch_us(l_shipdate) // 1000) AS date,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq FROM lineitem"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("price"))


PRICES_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price FROM part"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal entries: one per order. Every seventh is open (no pnl), every eleventh has no tags."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    closed = F.col("o_orderkey") % 7 != 0
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry_id"),
        (F.col("o_custkey") % 50).alias("user_id"),
        F.element_at(F.array(F.lit("buy"), F.lit("sell"), F.lit("hold")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("action"),
        F.col("o_orderpriority").alias("signal_tier"),
        F.col("o_orderstatus").alias("setup_type"),
        F.when(F.col("o_orderkey") % 5 != 0, F.element_at(F.array(F.lit("trending"), F.lit("ranging"), F.lit("volatile")), (F.col("o_custkey") % 3 + 1).cast("int"))).alias("market_condition"),
        F.when(F.col("o_orderkey") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", "o_orderstatus")).alias("tags"),
        F.col("o_totalprice").alias("entry_price"),
        F.when(closed, F.col("o_totalprice")).alias("exit_price"),
        F.when(closed, (cents % 2001 - 900) / F.lit(64.0)).alias("pnl"),
        F.when(closed & (F.col("o_orderkey") % 2 == 0), epoch_ms("o_orderdate")).alias("reviewed_at"),
        epoch_ms("o_orderdate").alias("created_at"),
    )


JOURNAL_SQL = """SELECT o_orderkey AS entry_id, o_custkey % 50 AS user_id, ['buy', 'sell', 'hold'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS action, o_orderpriority AS signal_tier, o_orderstatus AS setup_type,
  CASE WHEN o_orderkey % 5 <> 0 THEN ['trending', 'ranging', 'volatile'][CAST(o_custkey % 3 + 1 AS INTEGER)] END AS market_condition,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE [o_orderpriority, o_orderstatus] END AS tags, o_totalprice AS entry_price,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS exit_price,
  CASE WHEN o_orderkey % 7 <> 0 THEN (CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 900) / CAST(64 AS DOUBLE) END AS pnl,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0 THEN (epoch_us(o_orderdate) // 1000) END AS reviewed_at, (epoch_us(o_orderdate) // 1000) AS created_at FROM orders"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio, day (ms), total_value: value of the orders of a status on a day."""
    day = (F.floor(epoch_ms("o_orderdate") / 86_400_000) * 86_400_000).cast("long")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("portfolio"), day.alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_value"))


SNAPSHOTS_SQL = "SELECT o_orderstatus AS portfolio, (epoch_us(o_orderdate) // 1000) // 86400000 * 86400000 AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM orders GROUP BY 1, 2"


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio, symbol, quantity, avg_price: what a supplier has of a part."""
    li = read(spark, sf_dir, "lineitem")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return li.groupBy(F.col("l_suppkey").alias("portfolio"), F.col("l_partkey").cast("string").alias("symbol")).agg(
        total("l_quantity").cast("double").alias("quantity"), (total("l_extendedprice").cast("double") / total("l_quantity").cast("double")).alias("avg_price")
    )


HOLDINGS_SQL = """SELECT l_suppkey AS portfolio, CAST(l_partkey AS VARCHAR) AS symbol, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS avg_price FROM lineitem GROUP BY 1, 2"""

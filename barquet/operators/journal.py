"""Trade journal: filters, pages, summaries by tag, action, setup, condition, month and tier.

Entries have entry_id, user_id, action, signal_tier, setup_type, market_condition, tags,
entry_price, exit_price, pnl (percent), reviewed_at and created_at (ms); an entry is closed if it
has both prices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.functions.scalars import utc

#: Sums of percentages are taken over decimals, so that they don't depend on the order of rows.
EXACT = "decimal(28,8)"


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Rows equal to every value given; None gives no condition."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def one_of(rows: DataFrame, column: str, value: str | None, allowed: list[str]) -> DataFrame:
    """Rows with ``value``, unless it is not an allowed one: then the condition is dropped."""
    return matching(rows, **{column: value}) if value in allowed else rows


def tagged(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.array_contains("tags", tag))


def titled(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose ``column`` holds ``text`` literally, whatever the case."""
    return rows.where(F.contains(F.lower(column), F.lit(text.lower())))


def opened(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("entry_price").isNotNull() & F.col("exit_price").isNull())


def closed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("exit_price").isNotNull())


def unreviewed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("exit_price").isNotNull() & F.col("reviewed_at").isNull())


def since(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("created_at") >= start)
    return rows if end is None else rows.where(F.col("created_at") <= end)


def ordered(rows: DataFrame, sort: str, allowed: list[str], key: str = "entry_id") -> DataFrame:
    """In order of one allowed column, descending with a leading -; otherwise newest first. ``key`` breaks ties."""
    name, down = sort.lstrip("-"), sort.startswith("-")
    if name not in allowed:
        name, down = "created_at", True
    return rows.orderBy(F.col(name).desc() if down else F.col(name).asc(), F.col(key))


def page(rows: DataFrame, sort: str, allowed: list[str], number: int = 1, size: int = 50, most: int = 100, key: str = "entry_id") -> DataFrame:
    """A page of rows, numbered from 1; the size is held between 1 and ``most``."""
    size = max(1, min(most, size))
    return ordered(rows, sort, allowed, key).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(float(size))).cast("long").alias("pages"))


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast(EXACT)).cast("double"), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b.cast("double")), F.lit(0.0))


def summary(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, rates and sums over closed entries with a pnl; total_trades counts all entries. profit_factor is null without losses."""
    pnl = F.col("pnl")
    has = pnl.isNotNull()
    grouped = entries.groupBy(*(by or [])).agg(
        F.count("*").alias("total_trades"),
        F.count_if(pnl > 0).alias("wins"),
        F.count_if(pnl < 0).alias("losses"),
        F.count_if(has).alias("_closed"),
        _sum(pnl).alias("total_pnl"),
        F.max("pnl").alias("best_trade"),
        F.min("pnl").alias("worst_trade"),
        _sum(F.when(pnl > 0, pnl)).alias("_profit"),
        F.abs(_sum(F.when(pnl < 0, pnl))).alias("_loss"),
    )
    out = grouped.withColumns(
        {"win_rate": _ratio(F.col("wins") * 100.0, F.col("_closed")), "avg_pnl": _ratio(F.col("total_pnl"), F.col("_closed")), "profit_factor": F.when(F.col("_loss") > 0, F.try_divide("_profit", "_loss"))}
    )
    return out.drop("_closed", "_profit", "_loss")


def performance(entries: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Of entries with a pnl, by a column: count, wins, losses, win_rate, avg_pnl; the ``top`` by count, ties by name."""
    pnl = F.col("pnl")
    rows = entries.where(pnl.isNotNull() & F.col(by).isNotNull())
    out = rows.groupBy(by).agg(F.count("*").alias("count"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"), _sum(pnl).alias("_total"))
    out = out.withColumns({"win_rate": _ratio(F.col("wins") * 100.0, F.col("count")), "avg_pnl": _ratio(F.col("_total"), F.col("count"))}).drop("_total")
    return out if top is None else out.orderBy(F.desc("count"), by).limit(top)


def by_tag(entries: DataFrame, top: int = 50) -> DataFrame:
    return performance(entries.where(F.size("tags") > 0).withColumn("tag", F.explode("tags")), "tag", top)


def by_action(entries: DataFrame) -> DataFrame:
    """Entries of each action and their share of all, in percent."""
    counts = entries.groupBy("action").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("percentage", _ratio(F.col("count") * 100.0, F.col("_all"))).drop("_all")  # one row


def by_month(entries: DataFrame) -> DataFrame:
    month = F.date_format(utc("created_at"), "yyyy-MM")
    return entries.where("pnl is not null").groupBy(month.alias("month")).agg(_sum(F.col("pnl")).alias("pnl"), F.count("*").alias("trades"))


def tag_counts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def patterns(summaries: DataFrame, months: DataFrame) -> DataFrame:
    """Names of the patterns that a user's summary and months show: user_id and patterns, an array.

    summaries: of ``summary`` by user_id; months: user_id, month, pnl, trades.
    """
    in_order = F.array_sort(F.collect_list(F.struct("month", "pnl", "trades")))
    m = months.groupBy("user_id").agg(in_order.alias("m"))  # as many as there are months
    s = summaries.join(m, "user_id", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<month:string,pnl:double,trades:bigint>>")))
    streak = F.aggregate("m", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, x: F.struct(F.when(x["pnl"] < 0, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["best"], F.when(x["pnl"] < 0, a["now"] + 1).otherwise(0)).alias("best")))["best"]
    n = F.size("m")
    rate = F.try_divide(F.size(F.filter("m", lambda x: x["pnl"] > 0)) * 100.0, n.cast("double"))
    mean = F.try_divide(F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x["trades"]).cast("double"), n.cast("double"))
    s = s.withColumn("_mean", mean)
    busy = F.filter("m", lambda x: x["trades"] > F.col("_mean") * 2)
    worst = F.array_min(F.transform(busy, lambda x: x["pnl"]))
    few = F.col("wins") + F.col("losses") >= 5
    found = F.array_compact(
        F.array(
            F.when((F.col("wins") >= 5) & (F.col("win_rate") >= 70), "Strong Win Rate"),
            F.when((F.col("losses") >= 5) & (F.col("win_rate") < 40), "Low Win Rate"),
            F.when(F.col("profit_factor") >= 2, "High Profit Factor").when((F.col("profit_factor") < 1) & few, "Negative Expectancy"),
            F.when((n >= 3) & (rate >= 70), "Consistent Monthly Profits"),
            F.when((n >= 3) & (streak >= 3), "Losing Streak"),
            F.when((F.col("_mean") >= 3) & (worst < 0), "Possible Overtrading"),
        )
    )
    return s.select("user_id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Insufficient Data"))).alias("patterns"))


def outcome(side: Column, entry: Column, exit: Column) -> Column:
    """Percent gained between two prices; a sale gains from a fall. Null where a price is null or the entry is zero."""
    change = F.try_divide(exit - entry, entry) * 100
    return F.when(side == "sell", -change).otherwise(change)

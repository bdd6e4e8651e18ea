"""CSV text of tax rows in three dialects, and of journal entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.functions.scalars import csv_escape, fixed, iso_day, number_text, quantity_text, strip_quote, utc, utc_time

#: Header lines of the dialects.
HEADERS = {
    "generic": "Date,Type,Asset,Quantity,Price (USD),Fee (USD),Proceeds (USD),Cost Basis (USD),Gain/Loss (USD),Holding Period",
    "koinly": "Date,Sent Amount,Sent Currency,Received Amount,Received Currency,Fee Amount,Fee Currency,Label",
    "cointracker": "Date,Type,Buy/In Amount,Buy/In Currency,Sell/Out Amount,Sell/Out Currency,Fee,Fee Currency",
}


def tax_rows(transactions: DataFrame, gains: DataFrame, year: int | None = None) -> DataFrame:
    """Purchases and realised gains as rows of one kind, of one year in UTC if given; sales have proceeds, cost basis, gain and period."""
    buys = transactions.where("type = 'buy'").select("date", "type", "symbol", "quantity", "price", F.coalesce("fee", F.lit(0.0)).alias("fee"), F.to_json("seq").alias("seq"))
    sells = gains.select(
        F.col("sell_date").alias("date"), F.lit("sell").alias("type"), "symbol", "quantity", F.try_divide("proceeds", "quantity").alias("price"), F.lit(0.0).alias("fee"), F.concat_ws("-", "sell_seq", "buy_seq").alias("seq"), "proceeds", "cost_basis", "gain", "holding_period"
    )
    rows = buys.unionByName(sells, allowMissingColumns=True)
    return rows if year is None else rows.where(F.year(utc("date")) == year)


def _line(*fields: Column) -> Column:
    """Fields, escaped where they may need it, divided by commas; null is empty."""
    return F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields])


def tax_csv(rows: DataFrame, dialect: str = "generic") -> DataFrame:
    """One column, line: the header and a line per row, with place (date, then purchases first, symbol and seq) to order them by.

    Write it in order with ``orderBy("place").select("line").write.text(...)``.
    """
    usd, empty, buy = F.lit("USD"), F.lit(""), F.col("type") == "buy"
    asset, q = csv_escape(strip_quote("symbol")), quantity_text("quantity")
    fee, fee_unit = F.when(F.col("fee") > 0, fixed("fee", 2)), F.when(F.col("fee") > 0, usd)
    got = F.coalesce(F.col("proceeds"), F.col("quantity") * F.col("price"))
    if dialect == "generic":
        money = [fixed(c, 2) for c in ("price", "fee")] + [F.when(F.col(c).isNotNull(), fixed(c, 2)) for c in ("proceeds", "cost_basis", "gain")]
        line = _line(iso_day("date"), F.when(buy, "Buy").otherwise("Sell"), asset, q, *money, F.when(F.col("holding_period") == "long-term", "Long-term").when(F.col("holding_period").isNotNull(), "Short-term"))
    elif dialect == "koinly":
        paid = fixed(F.col("quantity") * F.col("price") + F.col("fee"), 2)
        line = F.when(buy, _line(utc_time("date"), paid, usd, q, asset, fee, fee_unit, empty)).otherwise(_line(utc_time("date"), q, asset, fixed(got, 2), usd, fee, fee_unit, empty))
    elif dialect == "cointracker":
        line = F.when(buy, _line(iso_day("date"), F.lit("Buy"), q, asset, fixed(F.col("quantity") * F.col("price"), 2), usd, fee, fee_unit)).otherwise(
            _line(iso_day("date"), F.lit("Sell"), fixed(got, 2), usd, q, asset, fee, fee_unit)
        )
    else:
        raise ValueError(f"no such dialect: {dialect}")
    place = F.struct(F.lit(1).alias("body"), F.col("date"), F.col("type"), F.col("symbol"), F.col("seq"))
    lines = rows.select(place.alias("place"), line.alias("line"))
    head = rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("body"), *[F.lit(None).cast(t).alias(c) for c, t in (("date", "long"), ("type", "string"), ("symbol", "string"), ("seq", "string"))]).alias("place"), F.lit(HEADERS[dialect]).alias("line"))
    return head.unionByName(lines).select("place.body", "place.date", "place.type", "place.symbol", "place.seq", "line")


#: Fixed value: the header line of a journal's CSV file.
JOURNAL_HEADER = "Date,Symbol,Interval,Action,Signal Score,Signal Tier,Entry Price,Exit Price,P&L %,Setup Type,Market Condition,Tags,Notes,Reviewed"


def journal_csv(entries: DataFrame) -> DataFrame:
    """entry_id and line: a header, whose entry_id is null, and each entry as CSV; days are in UTC, tags are divided by semicolons."""
    fields = [
        iso_day("created_at"), F.col("symbol"), F.col("interval"), F.col("action"), F.floor(F.col("signal_score") + 0.5).cast("string"), F.col("signal_tier"), number_text("entry_price"), number_text("exit_price"),
        fixed("pnl", 2), F.col("setup_type"), F.col("market_condition"), F.array_join("tags", "; "), F.col("notes"), F.when(F.col("reviewed_at").isNotNull(), "Yes").otherwise("No"),
    ]
    head = entries.sparkSession.range(1).select(F.lit(None).cast(entries.schema["entry_id"].dataType).alias("entry_id"), F.lit(JOURNAL_HEADER).alias("line"))
    return head.unionByName(entries.select("entry_id", _line(*map(csv_escape, fields)).alias("line")))

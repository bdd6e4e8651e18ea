"""Alerts: conditions on prices, portfolios and holdings, with a cooldown, at a given time.

Alerts have alert_id, type, symbol, portfolio, target, reference, percent, status, recurring, cooldown_minutes and
last_triggered_at (ms). Only active ones are judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(28,8)"
PRICE_TYPES, PORTFOLIO_TYPES = ("price_above", "price_below", "price_change_pct"), ("portfolio_value_above", "portfolio_value_below")


def _moved(now: Column, before: Column, percent: Column) -> Column:
    return F.abs(F.try_divide(now - before, before) * 100) >= F.abs(percent)


def cooling(now: int) -> Column:
    """Whether a recurring alert is within its cooldown; at its very end it isn't."""
    return F.col("recurring") & F.coalesce(F.lit(now) - F.col("last_triggered_at") < F.col("cooldown_minutes") * 60_000, F.lit(False))


def _fired(rows: DataFrame, condition: Column, now: int) -> DataFrame:
    return rows.where((F.col("status") == "active") & F.coalesce(condition, F.lit(False)) & ~cooling(now))


def price_alerts(alerts: DataFrame, prices: DataFrame, now: int) -> DataFrame:
    """Alerts on prices that fire. Without a price, a target, or a reference there is nothing to fire."""
    rows = alerts.where(F.col("type").isin(*PRICE_TYPES)).join(prices.select("symbol", "price"), "symbol")
    c = (
        F.when(F.col("type") == "price_above", F.col("price") >= F.col("target"))
        .when(F.col("type") == "price_below", F.col("price") <= F.col("target"))
        .otherwise(_moved(F.col("price"), F.col("reference"), F.col("percent")))
    )
    return _fired(rows, c, now).select(alerts.columns)


def portfolio_alerts(alerts: DataFrame, holdings: DataFrame, prices: DataFrame, now: int) -> DataFrame:
    """Alerts on the value of portfolios; holdings without a price count as nothing."""
    values = holdings.join(prices.select("symbol", "price"), "symbol", "left").groupBy("portfolio").agg(F.coalesce(F.sum((F.col("quantity") * F.col("price")).cast(EXACT)).cast("double"), F.lit(0.0)).alias("_value"))
    rows = alerts.where(F.col("type").isin(*PORTFOLIO_TYPES)).join(values, "portfolio")
    return _fired(rows, F.when(F.col("type") == "portfolio_value_above", F.col("_value") >= F.col("target")).otherwise(F.col("_value") <= F.col("target")), now).select(alerts.columns)


def holding_alerts(alerts: DataFrame, holdings: DataFrame, prices: DataFrame, now: int) -> DataFrame:
    """Alerts on the change of a holding since it was bought; holdings that cost nothing are left out."""
    held = holdings.where("avg_price <> 0").select("portfolio", "symbol", "avg_price").join(prices.select("symbol", "price"), "symbol")
    rows = alerts.where("type = 'holding_change_pct'").join(held, ["portfolio", "symbol"])
    return _fired(rows, _moved(F.col("price"), F.col("avg_price"), F.col("percent")), now).select(alerts.columns)


def after(alerts: DataFrame, fired: DataFrame, now: int) -> DataFrame:
    """All alerts in their new state: recurring ones stay active with their times stamped, others are triggered."""
    hit = F.col("_hit").isNotNull()
    out = alerts.join(fired.select("alert_id", F.lit(True).alias("_hit")).distinct(), "alert_id", "left")
    return out.withColumns(
        {
            "status": F.when(hit & ~F.col("recurring"), "triggered").otherwise(F.col("status")),
            "last_triggered_at": F.when(hit & F.col("recurring"), F.lit(now).cast("long")).otherwise(F.col("last_triggered_at")),
            "triggered_at": F.when(hit, F.lit(now).cast("long")),
        }
    ).drop("_hit")


def needed_symbols(alerts: DataFrame, holdings: DataFrame) -> DataFrame:
    """Symbols whose prices the alerts ask for: their own and those of their portfolios."""
    own = alerts.where("status = 'active' and symbol is not null").select("symbol")
    held = holdings.join(alerts.where("status = 'active'").select("portfolio"), "portfolio", "left_semi").select("symbol")
    return own.unionByName(held).distinct()

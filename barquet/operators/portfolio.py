"""Holdings: valuation, allocation, change over a day, average cost, daily snapshots, risk figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.config import RISK
from barquet.operators import ranges
from barquet.operators.scan import ordered_scan

EXACT = "decimal(28,8)"


def flat(portfolios: DataFrame) -> DataFrame:
    """Portfolios with nested holdings (array of structs) to a row per holding."""
    return portfolios.where(F.size("holdings") > 0).select("portfolio", F.explode("holdings").alias("h")).select("portfolio", "h.*")


def valued(holdings: DataFrame, prices: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Holdings (portfolio, symbol, quantity, avg_price) with price (live, else fallback), value, cost, pnl, pnl_percent, allocation.

    Spark broadcasts the prices if they are small enough by its own threshold. Holdings without a price have nulls.
    """
    out = holdings.join(prices.select("symbol", "price"), "symbol", "left")
    if fallback is not None:
        out = out.join(fallback.select("symbol", F.col("price").alias("_rest")), "symbol", "left").withColumn("price", F.coalesce("price", "_rest")).drop("_rest")
    out = out.withColumns({"value": F.col("quantity") * F.col("price"), "cost": F.col("quantity") * F.col("avg_price")})
    total = F.sum(F.col("value").cast(EXACT)).over(W.partitionBy("portfolio")).cast("double")
    pnl = F.col("value") - F.col("cost")
    return out.withColumns({"pnl": pnl, "pnl_percent": F.when(F.col("cost") > 0, F.try_divide(pnl, F.col("cost")) * 100).otherwise(0.0), "allocation": F.coalesce(F.try_divide(F.col("value"), total) * 100, F.lit(0.0))})


def valuation(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Value, cost, pnl and pnl_percent of each portfolio, over the holdings that have a price."""
    priced = holdings.join(prices.select("symbol", "price"), "symbol")
    total = lambda c: F.sum(c.cast(EXACT)).cast("double")
    out = priced.groupBy("portfolio").agg(total(F.col("quantity") * F.col("price")).alias("value"), total(F.col("quantity") * F.col("avg_price")).alias("cost"), F.count("*").alias("holdings"))
    return out.withColumns({"pnl": F.col("value") - F.col("cost"), "pnl_percent": F.when(F.col("cost") > 0, F.try_divide(F.col("value") - F.col("cost"), F.col("cost")) * 100).otherwise(0.0)})


def day_change(holdings: DataFrame, tickers: DataFrame) -> DataFrame:
    """Change of each portfolio over a day: tickers have symbol, price and open, the price a day ago."""
    j = holdings.join(tickers.select("symbol", "price", "open"), "symbol")
    total = lambda c: F.sum(c.cast(EXACT)).cast("double")
    out = j.groupBy("portfolio").agg(total(F.col("quantity") * F.col("price")).alias("value"), total(F.col("quantity") * F.col("open")).alias("before"))
    change = F.col("value") - F.col("before")
    return out.withColumns({"change": change, "change_percent": F.when(F.col("before") > 0, F.try_divide(change, F.col("before")) * 100).otherwise(0.0)}).drop("before")


class _Held:
    """Quantity and average cost: a purchase averages its price and fee in, a sale leaves the average. More may be sold than held; nothing is left then."""

    def __init__(self, *_):
        self.quantity, self.average = 0.0, 0.0

    def step(self, row):
        q = row["quantity"]
        if row["type"] == "buy":
            cost = self.quantity * self.average + q * row["price"] + (row["fee"] or 0.0)
            self.quantity += q
            self.average = cost / self.quantity if self.quantity > 0 else 0.0
        else:
            self.quantity -= q
        return ()

    def finish(self):
        yield (max(0.0, self.quantity), self.average if self.quantity > 0 else 0.0)


def holding_state(transactions: DataFrame, order: list[str]) -> DataFrame:
    """symbol, quantity, avg_price after all transactions in ``order``."""
    out = T.StructType([T.StructField("quantity", T.DoubleType()), T.StructField("avg_price", T.DoubleType())])
    return ordered_scan(transactions, ["symbol"], order, ["type", "quantity", "price", "fee"], _Held, out)


def long_holding_state(transactions: DataFrame, order: list[str], rows_a_range: int = ranges.ROWS) -> DataFrame:
    """What ``holding_state`` gives, but for the last digits, with the rows of symbols of more than ``rows_a_range`` spread over as many tasks as they need.

    The quantity held is a sum; given that, a purchase makes of the average cost a share of it and a share of its own price.
    """
    keys = ["symbol"]
    some, large = ranges.parted(transactions.where("quantity is not null"), keys, rows_a_range)
    whole = holding_state(some, order)
    return whole if large is None else whole.unionByName(_held_by_ranges(large, keys, order, rows_a_range))


def _held_by_ranges(transactions: DataFrame, keys: list[str], order: list[str], rows_a_range: int) -> DataFrame:
    rows = ranges.ranged(transactions, keys, order, rows_a_range)
    own = F.when(F.col("type") == "buy", F.col("quantity")).otherwise(-F.col("quantity")).cast("decimal(28,8)")
    rows = rows.withColumn("_own", own).withColumn("_held", F.sum("_own").over(ranges.within(keys, order)))
    sums = rows.groupBy("symbol", "part").agg(F.sum("_own").alias("_sum"))
    sums = sums.select("symbol", "part", F.coalesce(F.sum("_sum").over(ranges.earlier(keys)), F.lit(0)).alias("_start"))
    rows = ranges.rejoined(rows, sums, keys).withColumn("_held", (F.col("_start") + F.col("_held")).cast("double"))
    buy, q, held = F.col("type") == "buy", F.col("quantity"), F.col("_held")
    paid = q * F.col("price") + F.coalesce("fee", F.lit(0.0))
    share = lambda x: F.when(buy, F.when(held > 0, F.try_divide(x, held)).otherwise(0.0))
    last = ranges.affine_end(rows, keys, order, {"avg_price": (share(held - q), share(paid))})
    quantity = rows.groupBy("symbol").agg(F.sum("_own").cast("double").alias("quantity")).withColumnRenamed("symbol", "_symbol")
    out = last.join(quantity, F.col("symbol").eqNullSafe(F.col("_symbol")))
    return out.select("symbol", F.greatest("quantity", F.lit(0.0)).alias("quantity"), F.when(F.col("quantity") > 0, F.col("avg_price")).otherwise(0.0).alias("avg_price"))


def returns(values: DataFrame) -> DataFrame:
    """Values (portfolio, day, total_value) with ret, the return since the day before; null after a zero and on the first day."""
    w = W.partitionBy("portfolio").orderBy("day")
    before = F.lag("total_value").over(w)
    return values.withColumn("ret", F.when(before != 0, F.try_divide(F.col("total_value") - before, before)))


def drawdowns(values: DataFrame) -> DataFrame:
    """Values with peak (highest so far) and drawdown, zero or negative."""
    w = W.partitionBy("portfolio").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return values.withColumn("peak", F.max("total_value").over(w)).withColumn("drawdown", F.when(F.col("peak") > 0, F.try_divide(F.col("total_value") - F.col("peak"), F.col("peak"))).otherwise(0.0))


def risk(values: DataFrame, risk_free: float = RISK["risk_free"], days: int = RISK["days"], drawdown_points: int = RISK["drawdown_points"], ratio_points: int = RISK["ratio_points"]) -> DataFrame:
    """Risk figures of each portfolio with two values and one return at least.

    Returns are rounded to twelve decimals before they are summed, so that sums don't depend on the order of rows. Ratios need
    ``ratio_points`` returns, the drawdown ``drawdown_points`` values; what can't be had is null. Of equal days the first counts.
    """
    day_ms = 86_400_000.0
    total = lambda c: F.sum(c.cast("decimal(30,12)")).cast("double")
    r = F.col("ret")
    both = drawdowns(returns(values)).groupBy("portfolio").agg(
        F.count("*").alias("points"),
        F.count("ret").alias("n"),
        F.min("day").alias("_d0"),
        F.max("day").alias("_d1"),
        F.min_by("total_value", "day").alias("_v0"),
        F.max_by("total_value", "day").alias("_v1"),
        total(r).alias("_s"),
        total(r * r).alias("_ss"),
        total(F.when(r < 0, r * r)).alias("_down"),
        F.count_if(r < 0).alias("_losses"),
        F.max("ret").alias("best_return"),
        F.min("ret").alias("worst_return"),
        F.max_by("day", F.struct(r, -F.col("day"))).alias("best_day"),
        F.min_by("day", F.when(r.isNotNull(), F.struct(r, F.col("day")))).alias("worst_day"),
        F.min("drawdown").alias("_dd"),
        F.min_by("day", F.struct("drawdown", "day")).alias("_dd_day"),
    )
    n, span = F.col("n"), (F.col("_d1") - F.col("_d0")) / day_ms
    growth = F.when(F.col("_v0") > 0, F.try_divide(F.col("_v1") - F.col("_v0"), F.col("_v0")))
    out = both.where((F.col("points") >= 2) & (n >= 1)).withColumn("total_return", growth)
    out = out.withColumn("annualized_return", F.when(span > 0, F.pow(1 + F.col("total_return"), F.try_divide(F.lit(float(days)), span)) - 1))
    spread = F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    out = out.withColumn("annualized_volatility", F.sqrt(F.try_divide(spread, (n - 1).cast("double"))) * F.sqrt(F.lit(float(days))))
    excess = F.col("annualized_return") - risk_free
    enough = (n >= ratio_points) & (F.col("annualized_volatility") > 0)
    out = out.withColumns(
        {
            "max_drawdown": F.when(F.col("points") >= drawdown_points, F.col("_dd")),
            "max_drawdown_day": F.when(F.col("points") >= drawdown_points, F.col("_dd_day")),
            "sharpe": F.when(enough, F.try_divide(excess, F.col("annualized_volatility"))),
            "sortino": F.when(enough & (F.col("_losses") > 0), F.try_divide(excess, F.sqrt(F.try_divide(F.col("_down"), F.col("_losses").cast("double"))) * F.sqrt(F.lit(float(days))))),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")], "n")


def period_return(values: DataFrame) -> DataFrame:
    """Percent from the first to the last value of each portfolio."""
    out = values.groupBy("portfolio").agg(F.min_by("total_value", "day").alias("first"), F.max_by("total_value", "day").alias("last"))
    return out.withColumn("period_return", F.when(F.col("first") > 0, F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100))


def percent_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100

"""Tax lots: which purchases a sale uses up, first in first out, last in first out, or highest price first.

Transactions have symbol, type (buy or sell), quantity, price, fee and date (ms). What is sold beyond the
lots held is dropped; later purchases don't make up for it.
"""

from __future__ import annotations

from bisect import insort
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.operators import ranges
from barquet.operators.scan import ordered_scan

YEAR_MS = 365 * 86_400_000
QUANTITY = "decimal(28,8)"


def term(bought: Column, sold: Column) -> Column:
    """Long-term if held for more than 365 days."""
    return F.when(sold - bought > YEAR_MS, "long-term").otherwise("short-term")


def _numbered(transactions: DataFrame, order: list[str], rows_a_range: int = ranges.ROWS) -> DataFrame:
    """Positive transactions with cumulative quantities bought and matched, by symbol.

    With B and S bought and sold so far, of S the part max(0, max of S - B so far) was never held; the rest was matched.
    Sums and that maximum are taken within ranges of a symbol's rows first, so a symbol may fill many tasks.
    """
    keys, zero = ["symbol"], F.lit(0).cast(QUANTITY)
    exact = lambda c: c.cast(QUANTITY)  # noqa: E731  sums would widen, and differences of wide sums lose places
    is_buy, q = F.col("type") == "buy", F.col("quantity").cast(QUANTITY)
    rows = ranges.ranged(transactions.where("quantity > 0"), keys, order, rows_a_range)
    upto = ranges.within(keys, order)
    rows = rows.withColumns({"_bought": F.when(is_buy, q).otherwise(zero), "_sold": F.when(is_buy, zero).otherwise(q)})
    rows = rows.withColumns({"seq": F.row_number().over(W.partitionBy("symbol", "part").orderBy(*order)), "b": exact(F.sum("_bought").over(upto)), "s": exact(F.sum("_sold").over(upto))})
    rows = rows.withColumn("_short", F.col("s") - F.col("b"))
    rows = rows.withColumns({"_most": F.max("_short").over(upto), "_most0": F.max("_short").over(W.partitionBy("symbol", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))})
    sums = rows.groupBy("symbol", "part").agg(F.count("*").alias("_n"), exact(F.sum("_bought")).alias("_b"), exact(F.sum("_sold")).alias("_s"), F.max("_short").alias("_m"), F.count_if(is_buy).alias("_buys"))
    before, whole = ranges.earlier(keys), W.partitionBy("symbol")
    sums = sums.withColumns({"_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_b0": F.coalesce(exact(F.sum("_b").over(before)), zero), "_s0": F.coalesce(exact(F.sum("_s").over(before)), zero)})
    sums = sums.withColumn("_m", exact(F.col("_m") + F.col("_s0") - F.col("_b0")))
    mean = F.try_divide(F.sum("_b").over(whole).cast("double"), F.sum("_buys").over(whole).cast("double"))
    sums = sums.select("symbol", "part", "_n0", "_b0", "_s0", F.greatest(zero, F.max("_m").over(before)).alias("_m0"), mean.alias("mean_lot"))
    out = ranges.rejoined(rows, sums, keys)
    b0, s0, never = F.col("_b0"), F.col("_s0"), lambda c: F.greatest(F.col("_m0"), F.col(c) + F.col("_s0") - F.col("_b0"))
    out = out.withColumns({"seq": (F.col("seq") + F.col("_n0")).cast("int"), "m": exact(s0 + F.col("s") - never("_most")), "m0": exact(s0 + F.col("s") - F.col("_sold") - never("_most0"))})
    out = out.withColumns({"b": exact(b0 + F.col("b")), "s": exact(s0 + F.col("s"))})
    return out.drop("part", *[c for c in out.columns if c.startswith("_")])


def _clustered(transactions: DataFrame, order: list[str]) -> DataFrame:
    """What ``_numbered`` gives (seq, b, m; m0 is left out), with one shuffle: of symbols that a task can take whole."""
    upto, zero = W.partitionBy("symbol").orderBy(*order), F.lit(0).cast(QUANTITY)
    exact = lambda c: c.cast(QUANTITY)
    q, so_far = exact(F.col("quantity")), W.unboundedPreceding
    rows = transactions.where("quantity > 0").select("symbol", *order, *[c for c in ("quantity", "price", "fee", "date") if c not in order], (F.col("type") == "buy").alias("is_buy"))
    sums = {"seq": F.row_number().over(upto), "b": exact(F.sum(F.when(F.col("is_buy"), q).otherwise(zero)).over(upto.rowsBetween(so_far, 0))), "s": exact(F.sum(F.when(F.col("is_buy"), zero).otherwise(q)).over(upto.rowsBetween(so_far, 0)))}
    rows = rows.withColumns({f"_{k}": c for k, c in sums.items()})
    never = F.greatest(zero, F.max(F.col("_s") - F.col("_b")).over(upto.rowsBetween(so_far, 0)))
    rows = rows.withColumn("m", exact(F.col("_s") - never))
    return rows.select("symbol", "is_buy", F.col("_seq").alias("seq"), "date", "quantity", "price", F.coalesce("fee", F.lit(0.0)).alias("fee"), F.col("_b").alias("b"), "m")


_GAIN = ["symbol", "buy_seq", "sell_seq", "buy_date", "sell_date", "quantity", "proceeds", "cost_basis"]


def fifo_gains(transactions: DataFrame, order: list[str], rows_a_range: int = ranges.ROWS) -> DataFrame:
    """Matches of sales and lots, first in first out, by intervals of cumulative quantity.

    Lots lie side by side on an axis of quantity, and so does what sales use of them. The rows of a symbol, in the order of where
    their intervals end, cut the axis into stretches, each in one lot and one sale: those that end first at or after it. Symbols of more
    than ``rows_a_range`` rows are spread over tasks, and their intervals joined. Returns symbol, buy_seq, sell_seq, buy_date, sell_date, quantity,
    proceeds (less the fee's share), cost_basis (with the fee), gain, holding_period.
    """
    rows, large = ranges.parted(transactions.where("symbol is not null"), ["symbol"], rows_a_range)
    rows = _clustered(rows, order)
    rows = rows.select("symbol", "seq", "is_buy", "date", F.when(F.col("is_buy"), F.col("b")).otherwise(F.col("m")).alias("at"), "price", "quantity", "fee")
    # From the end of the axis back, as frames that begin with the partition are cheap. Of equal ends the first row has the length, so it is last here.
    back = W.partitionBy("symbol").orderBy(F.desc("at"), F.desc("seq"))
    own = F.struct("seq", "date", "price", "quantity", "fee")
    nearest = lambda which: F.last(F.when(which, own), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    length = F.col("at") - F.coalesce(F.lead("at").over(back), F.lit(0).cast(QUANTITY))
    cut = rows.select("symbol", length.alias("length"), nearest(F.col("is_buy")).alias("lot"), nearest(~F.col("is_buy")).alias("sale")).where("length > 0 and lot is not null and sale is not null")
    q, lot, sale = F.col("length").cast("double"), F.col("lot"), F.col("sale")
    proceeds, cost = q * sale["price"] - q / sale["quantity"] * sale["fee"], q * (lot["price"] + lot["fee"] / lot["quantity"])
    out = cut.select("symbol", *[c.alias(n) for c, n in zip((lot["seq"], sale["seq"], lot["date"], sale["date"], q, proceeds, cost), _GAIN[1:], strict=True)])
    if large is not None:
        out = out.unionByName(_joined(_numbered(large, order, rows_a_range)))
    return out.withColumns({"gain": F.col("proceeds") - F.col("cost_basis"), "holding_period": term(F.col("buy_date"), F.col("sell_date"))})


def _joined(rows: DataFrame) -> DataFrame:
    """Matches of numbered rows, as a join of intervals.

    They are cut at whole multiples of a symbol's mean lot size, and joined by the pieces they share: a sale
    meets the lots it uses up and few others.
    """
    fee = F.coalesce("fee", F.lit(0.0))
    piece = lambda q: F.floor(F.col(q).cast("double") / F.col("mean_lot"))
    pieces = lambda lo, hi: F.explode(F.sequence(piece(lo), piece(hi)))
    lots = rows.where("type = 'buy'").withColumns({"lo": F.col("b") - F.col("quantity").cast(QUANTITY), "hi": F.col("b")})
    lots = lots.select("symbol", pieces("lo", "hi").alias("piece"), F.col("seq").alias("buy_seq"), F.col("date").alias("buy_date"), "lo", "hi", "mean_lot", (F.col("price") + fee / F.col("quantity")).alias("unit_cost"))
    sales = rows.where("type <> 'buy' and m > m0")
    sales = sales.select("symbol", pieces("m0", "m").alias("piece"), F.col("seq").alias("sell_seq"), F.col("date").alias("sell_date"), "m0", "m", F.col("price").alias("sell_price"), F.col("quantity").alias("sold"), fee.alias("sell_fee"))
    # A pair may share many pieces; it counts in the first of them.
    j = lots.join(sales, ["symbol", "piece"]).where("lo < m and m0 < hi").where(F.col("piece") == F.floor(F.greatest("lo", "m0").cast("double") / F.col("mean_lot")))
    q = (F.least("hi", "m") - F.greatest("lo", "m0")).cast("double")
    proceeds = q * F.col("sell_price") - q / F.col("sold") * F.col("sell_fee")
    return j.select("symbol", "buy_seq", "sell_seq", "buy_date", "sell_date", q.alias("quantity"), proceeds.alias("proceeds"), (q * F.col("unit_cost")).alias("cost_basis"))


def fifo_open(transactions: DataFrame, order: list[str], rows_a_range: int = ranges.ROWS) -> DataFrame:
    """Lots with a rest, first in first out: symbol, buy_seq, buy_date, quantity, unit_cost, remaining."""
    rows, large = ranges.parted(transactions.where("symbol is not null"), ["symbol"], rows_a_range)
    rows = _clustered(rows, order).select("symbol", "is_buy", "seq", "date", "quantity", "price", "fee", "b", F.max("m").over(W.partitionBy("symbol")).alias("all_matched")).where("is_buy")
    if large is not None:
        more = _numbered(large, order, rows_a_range)
        matched = more.groupBy("symbol").agg(F.max("m").alias("all_matched"))
        rows = rows.drop("is_buy").unionByName(more.where("type = 'buy'").join(matched, "symbol").select("symbol", "seq", "date", "quantity", "price", "fee", "b", "all_matched"))
    left = F.least(F.col("quantity").cast(QUANTITY), F.col("b") - F.col("all_matched"))
    out = rows.withColumn("remaining", left.cast("double")).where("remaining > 0")
    return out.select("symbol", F.col("seq").alias("buy_seq"), F.col("date").alias("buy_date"), "quantity", (F.col("price") + F.coalesce("fee", F.lit(0.0)) / F.col("quantity")).alias("unit_cost"), "remaining")


class _Lots:
    """Lots in the order of use; ``method`` is fifo, lifo or hifo (of one price the earliest first)."""

    def __init__(self, method: str):
        self.method, self.seq, self.lots = method, 0, deque() if method != "hifo" else []

    def step(self, row):
        if row["quantity"] is None or row["quantity"] <= 0:
            return
        self.seq += 1
        q, fee = row["quantity"], row["fee"] or 0.0
        if row["type"] == "buy":
            lot = [row["price"] + fee / q, self.seq, row["date"], q]
            if self.method == "hifo":
                insort(self.lots, lot, key=lambda x: (x[0], -x[1]))
            else:
                self.lots.append(lot)
            return
        left = q
        while left > 0 and self.lots:
            lot = self.lots[0] if self.method == "fifo" else self.lots[-1]
            used = min(left, lot[3])
            proceeds = used * row["price"] - used / q * fee
            cost = used * lot[0]
            yield ("gain", lot[1], self.seq, lot[2], row["date"], used, proceeds, cost, proceeds - cost, "long-term" if row["date"] - lot[2] > YEAR_MS else "short-term")
            lot[3] -= used
            left -= used
            if lot[3] <= 0:
                self.lots.popleft() if self.method == "fifo" else self.lots.pop()

    def finish(self):
        for cost, seq, date, left in sorted(self.lots, key=lambda x: x[1]):
            yield ("open", seq, None, date, None, left, None, left * cost, None, None)


_MATCHES = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("buy_seq", T.LongType()), T.StructField("sell_seq", T.LongType()), T.StructField("buy_date", T.LongType()), T.StructField("sell_date", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("quantity", "proceeds", "cost_basis", "gain")]
    + [T.StructField("holding_period", T.StringType())]
)


def matches(transactions: DataFrame, order: list[str], method: str = "fifo") -> DataFrame:
    """Matches (kind gain) and rests of lots (kind open) of each symbol by any method, in one ordered scan; a symbol's open lots are its state."""
    if method not in ("fifo", "lifo", "hifo"):
        raise ValueError(f"no such method: {method}")
    return ordered_scan(transactions, ["symbol"], order, ["type", "quantity", "price", "fee", "date"], lambda *_: _Lots(method), _MATCHES)


def rollup(matched: DataFrame) -> DataFrame:
    """Per symbol: total_quantity, total_cost and average_cost of open lots, and total_realized_gain."""
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(28,8)")).cast("double"), F.lit(0.0))
    is_open = F.col("kind") == "open"
    out = matched.groupBy("symbol").agg(
        total(F.when(is_open, F.col("quantity"))).alias("total_quantity"), total(F.when(is_open, F.col("cost_basis"))).alias("total_cost"), total(F.when(~is_open, F.col("gain"))).alias("total_realized_gain")
    )
    return out.withColumn("average_cost", F.when(F.col("total_quantity") > 0, F.try_divide("total_cost", "total_quantity")).otherwise(0.0))

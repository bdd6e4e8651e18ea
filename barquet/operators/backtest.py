"""Backtests of scored bars: trades, equity and metrics, for any number of weightings at once.

Indicators don't depend on weights, so bars carry category scores; a run is a weighting of them. Bars and
runs meet in a join with the runs, whose number is a parameter; each (run, series) is one ordered scan.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.config import CATEGORIES, Backtest
from barquet.functions import score
from barquet.functions.interpret import clamp
from barquet.operators.scan import ordered_scan

RUN = ["run_id", "symbol", "interval"]
TRADE = [
    ("entry_bar", T.IntegerType()), ("exit_bar", T.IntegerType()), ("entry_time", T.LongType()), ("exit_time", T.LongType()), ("side", T.StringType()), ("entry_price", T.DoubleType()), ("exit_price", T.DoubleType()),
    ("quantity", T.DoubleType()), ("pnl", T.DoubleType()), ("pnl_percent", T.DoubleType()), ("fees", T.DoubleType()), ("exit_reason", T.StringType()), ("entry_score", T.DoubleType()), ("exit_score", T.DoubleType()), ("entry_tier", T.StringType()), ("hold_bars", T.IntegerType()),
]
EQUITY = [("bar", T.IntegerType()), ("time", T.LongType()), ("equity", T.DoubleType()), ("drawdown", T.DoubleType())]
EVENTS = T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, t) for n, t in TRADE + EQUITY)])


def weighted(bars: DataFrame, runs: DataFrame) -> DataFrame:
    """Bars with score_* for each run (run_id and weights by category): run_id, symbol, interval, n, ts, prices, score, tier.

    Futures and sentiment have no signals in a backtest; their weights are shared out.
    """
    own = CATEGORIES[:4]
    return scored(bars.select("symbol", "interval", "n", "ts", "open", "high", "low", "close", *[f"score_{c}" for c in own]).join(F.broadcast(runs.select("run_id", *own))))  # runs: candidates x styles


def scored(rows: DataFrame) -> DataFrame:
    """Rows with score_* and weights, which are replaced by score and tier."""
    own = CATEGORIES[:4]
    available = sum((F.col(c) for c in own), F.lit(0.0))
    total = sum((F.col(f"score_{c}") * F.try_divide(F.col(c), available) for c in own), F.lit(0.0))
    rows = rows.withColumn("score", clamp(F.coalesce(total, F.lit(0.0)), -100, 100))
    return rows.withColumn("tier", score.tier(F.col("score"))).drop(*own, *[f"score_{c}" for c in own])


def fixed_fractional(equity: float, risk: float, entry: float, stop: float) -> float:
    """Quantity that loses a share of equity between entry and stop."""
    if entry <= 0 or stop <= 0 or entry == stop:
        return 0.0
    return equity * risk / abs(entry - stop)


def kelly(equity: float, win_rate: float, mean_win: float, mean_loss: float, entry: float, fraction: float = 0.5) -> float:
    """Quantity by a fraction of Kelly's share, held between none and all; without a win nothing."""
    if entry <= 0 or mean_loss == 0 or mean_win == 0:
        return 0.0
    odds = mean_win / abs(mean_loss)
    return equity * min(1.0, max(0.0, (win_rate * odds - (1 - win_rate)) / odds * fraction)) / entry


def fractional_size(equity: Column, risk: Column, entry: Column, stop: Column) -> Column:
    """``fixed_fractional`` of columns."""
    usable = (entry > 0) & (stop > 0) & (entry != stop)
    return F.when(usable, F.try_divide(equity * risk, F.abs(entry - stop))).otherwise(0.0)


def kelly_size(equity: Column, win_rate: Column, mean_win: Column, mean_loss: Column, entry: Column, fraction: Column) -> Column:
    """``kelly`` of columns."""
    odds = F.try_divide(mean_win, F.abs(mean_loss))
    share = F.try_divide(win_rate * odds - (1 - win_rate), odds) * fraction
    usable = (entry > 0) & (mean_loss != 0) & (mean_win != 0)
    return F.when(usable, F.try_divide(equity * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), entry)).otherwise(0.0)


class _Run:
    """Equity, the open position and what Kelly's sizes need of past trades."""

    def __init__(self, cfg: Backtest):
        self.cfg = cfg
        self.equity = self.peak = cfg.start_equity
        self.position = self.last = self.point = None
        self.wins = self.losses = 0
        self.won = self.lost = 0.0

    def _size(self, price: float, side: str) -> float:
        c = self.cfg
        plain = self.equity * c.size / price
        if c.sizing in ("fixed_fractional", "risk_based"):
            return fixed_fractional(self.equity, c.risk_per_trade, price, price * (1 - c.stop_loss if side == "long" else 1 + c.stop_loss))
        if c.sizing == "kelly" and self.wins + self.losses >= 5:
            n = self.wins + self.losses
            return kelly(self.equity, self.wins / n, self.won / self.wins if self.wins else 0.0, self.lost / self.losses if self.losses else -1.0, price, c.kelly_fraction)
        return plain

    def _close(self, row, price: float, reason: str, at: float) -> tuple:
        p, c = self.position, self.cfg
        notional = p["quantity"] * p["price"]
        fees = notional * c.fee + p["quantity"] * price * c.fee
        gross = (price - p["price"] if p["side"] == "long" else p["price"] - price) * p["quantity"]
        pnl = gross - fees
        percent = ((gross if c.gross_percent else pnl) / notional) * 100 if notional > 0 else 0.0
        self.equity += pnl
        if pnl > 0:
            self.wins, self.won = self.wins + 1, self.won + pnl
        elif pnl < 0:
            self.losses, self.lost = self.losses + 1, self.lost + pnl
        self.position = None
        return ("trade", p["bar"], row["n"], p["time"], row["ts"], p["side"], p["price"], price, p["quantity"], pnl, percent, fees, reason, p["score"], at, p["tier"], row["n"] - p["bar"], None, None, None, None)

    def _stopped(self, row) -> tuple[str, float] | None:
        """The stop comes before the target if a bar reaches both."""
        p, c = self.position, self.cfg
        sign = 1 if p["side"] == "long" else -1
        stop, target = p["price"] * (1 - sign * c.stop_loss), p["price"] * (1 + sign * c.take_profit)
        worst, best = (row["low"], row["high"]) if sign > 0 else (row["high"], row["low"])
        if sign * worst <= sign * stop:
            return "stop_loss", stop
        if sign * best >= sign * target:
            return "take_profit", target
        return None

    def step(self, row):
        if self.point:
            yield self.point
        c, s = self.cfg, row["score"]
        if self.position and (hit := self._stopped(row)):
            yield self._close(row, hit[1], hit[0], 0.0)
        if self.position:
            if s <= c.exit if self.position["side"] == "long" else s >= c.short_exit:
                yield self._close(row, row["close"], "signal", s)
        else:
            side = "long" if s >= c.entry else "short" if c.allow_shorts and s <= c.short_entry else None
            if side:
                self.position = {"bar": row["n"], "time": row["ts"], "price": row["close"], "side": side, "quantity": self._size(row["close"], side), "score": s, "tier": row["tier"]}
        self.peak = max(self.peak, self.equity)
        drop = (self.peak - self.equity) / self.peak * 100 if self.peak > 0 else 0.0
        self.point = ("equity", *[None] * len(TRADE), row["n"], row["ts"], self.equity, drop)
        self.last = row

    def finish(self):
        if self.position:
            yield self._close(self.last, self.last["close"], "end_of_data", 0.0)
            self.point = (*self.point[:-2], self.equity, self.point[-1])
        if self.point:
            yield self.point


def run(scored: DataFrame, cfg: Backtest = Backtest()) -> DataFrame:
    """Trades (kind trade) and a point of equity per bar (kind equity) of each run and series.

    scored: run_id, symbol, interval, n, ts, high, low, close, score, tier, from the end of the warm-up on. The last bar closes
    what is open; its equity counts that, its drawdown doesn't.
    """
    return ordered_scan(scored, RUN, ["n"], ["n", "ts", "high", "low", "close", "score", "tier"], lambda *_: _Run(cfg), EVENTS)


def trades(events: DataFrame) -> DataFrame:
    return events.where("kind = 'trade'").select(*RUN, *[n for n, _ in TRADE])


def equity(events: DataFrame) -> DataFrame:
    return events.where("kind = 'equity'").select(*RUN, *[n for n, _ in EQUITY])


def _exact(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("decimal(32,10)")).cast("double"), F.lit(0.0))


def metrics(trade_rows: DataFrame, curve: DataFrame, start_equity: float = 10_000.0) -> DataFrame:
    """Nineteen figures of each run and series, zero where there is nothing to measure.

    Infinite profit factors (no losses) and Sortino ratios (no falling bar) are infinite, as doubles. The percentage of the drawdown is that
    at the largest drawdown in money.
    """
    pnl, w = F.col("pnl"), W.partitionBy(*RUN).orderBy("bar")
    t = trade_rows.groupBy(*RUN).agg(
        F.count("*").alias("total_trades"), F.count_if(pnl > 0).alias("winning_trades"), F.count_if(pnl <= 0).alias("losing_trades"), _exact(F.when(pnl > 0, pnl)).alias("_profit"), F.abs(_exact(F.when(pnl <= 0, pnl))).alias("_loss"),
        _exact(F.when(pnl > 0, F.col("pnl_percent"))).alias("_wp"), F.abs(_exact(F.when(pnl <= 0, F.col("pnl_percent")))).alias("_lp"), _exact(F.col("fees")).alias("total_fees"),
    )
    before = F.lag("equity", 1, start_equity).over(w)
    peak = F.greatest(F.lit(start_equity), F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)))
    c = curve.withColumns({"_ret": F.when(before > 0, F.try_divide(F.col("equity") - before, before)), "_dd": peak - F.col("equity"), "_peak": peak})
    r = F.col("_ret")
    e = c.groupBy(*RUN).agg(
        F.max_by("equity", "bar").alias("_final"), F.count("_ret").alias("_n"), F.count("*").alias("_points"), F.sum(r.cast("decimal(32,14)")).cast("double").alias("_s"), F.sum((r * r).cast("decimal(32,18)")).cast("double").alias("_ss"),
        F.sum(F.when(r < 0, r * r).cast("decimal(32,18)")).cast("double").alias("_down"), F.count_if(r < 0).alias("_falls"), F.max(F.struct(F.col("_dd"), -F.col("bar"), F.col("_peak"))).alias("_worst"),
    )
    out = e.join(t, RUN, "left").fillna(0, [x for x in t.columns if x not in RUN])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    inf = F.lit(float("inf"))
    total = F.col("_final") - start_equity
    mean = F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))
    enough = (F.col("_points") >= 2) & (F.col("_n") >= 2)
    dd, ddp = F.col("_worst._dd"), F.when(F.col("_worst._dd") > 0, ratio(F.col("_worst._dd"), F.col("_worst._peak")) * 100).otherwise(0.0)
    per = lambda a, n: ratio(F.col(a), F.col(n).cast("double"))
    year = F.sqrt(F.lit(252.0))
    out = out.withColumns(
        {
            "total_pnl": total, "total_pnl_percent": total / start_equity * 100, "win_rate": per("winning_trades", "total_trades"),
            "profit_factor": F.when(F.col("_loss") > 0, F.try_divide("_profit", "_loss")).when(F.col("_profit") > 0, inf).otherwise(0.0),
            "max_drawdown": F.greatest(F.lit(0.0), dd), "max_drawdown_percent": ddp, "calmar_ratio": F.when(ddp > 0, ratio(total / start_equity * 100, ddp)).otherwise(0.0),
            "sharpe_ratio": F.when(enough, F.when(sd > 1e-15, mean / sd * year).otherwise(0.0)).otherwise(0.0),
            "sortino_ratio": F.when(~enough, 0.0).when(F.col("_falls") == 0, F.when(mean > 0, inf).otherwise(0.0)).otherwise(ratio(mean, F.sqrt(F.try_divide(F.col("_down"), F.col("_falls").cast("double")))) * year),
            "avg_win": per("_profit", "winning_trades"), "avg_loss": per("_loss", "losing_trades"), "avg_win_percent": per("_wp", "winning_trades"), "avg_loss_percent": per("_lp", "losing_trades"),
        }
    )
    out = out.join(streaks(trade_rows), RUN, "left").fillna(0, ["max_wins", "max_losses"])
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def streaks(trade_rows: DataFrame, keys: list[str] | None = None, order: str = "exit_bar") -> DataFrame:
    """The longest runs of trades that gain, and of those that don't."""
    keys = keys or RUN
    w = W.partitionBy(*keys)
    win = F.col("pnl") > 0
    islands = trade_rows.withColumn("_win", win).withColumn("_i", F.row_number().over(w.orderBy(order, "entry_bar")) - F.row_number().over(W.partitionBy(*keys, "_win").orderBy(order, "entry_bar")))
    runs = islands.groupBy(*keys, "_win", "_i").agg(F.count("*").alias("_c"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_win"), F.col("_c"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(~F.col("_win"), F.col("_c"))), F.lit(0)).alias("max_losses"))


def trade_summary(trade_rows: DataFrame) -> DataFrame:
    """total_trades, winning_trades, avg_hold_bars, and pnl and entry time of the best and worst trade, the first of equals."""
    first = -F.col("exit_bar")
    best, worst = F.max(F.struct("pnl", first.alias("f"), "entry_time")), F.min(F.struct("pnl", "exit_bar", "entry_time"))
    out = trade_rows.groupBy(*RUN).agg(F.count("*").alias("total_trades"), F.count_if(F.col("pnl") > 0).alias("winning_trades"), (F.sum("hold_bars") / F.count("*").cast("double")).alias("avg_hold_bars"), best.alias("b"), worst.alias("w"))
    return out.select(*RUN, "total_trades", "winning_trades", "avg_hold_bars", F.col("b.pnl").alias("best_pnl"), F.col("b.entry_time").alias("best_time"), F.col("w.pnl").alias("worst_pnl"), F.col("w.entry_time").alias("worst_time"))


def sampled(curve: DataFrame, keys: list[str], order: str, most: int = 200) -> DataFrame:
    """At most ``most`` evenly spaced points of each curve, and its last one; all of a shorter curve."""
    w = W.partitionBy(*keys)
    rows = curve.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    step = F.col("_n") / F.lit(float(most))
    # Row i is the k-th sample if k = floor(i' / step) for the first i' of its step.
    k = F.ceil(F.col("_i") / step)
    chosen = (F.floor(k * step) == F.col("_i")) & (k < most)
    return rows.where((F.col("_n") <= most) | chosen | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def run_all(bars: DataFrame, runs: DataFrame, cfg: Backtest = Backtest()) -> DataFrame:
    """Events of every run over scored bars; see ``weighted`` and ``run``."""
    return run(weighted(bars, runs), cfg)



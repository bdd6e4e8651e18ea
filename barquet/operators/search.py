"""Backtests of all candidates of all windows of a series in one pass over its bars.

A bar isn't repeated for each candidate: the scan's state is an array over windows and candidates, and a bar updates all of
it at once. Training windows begin with the series, so windows share the pass; each is read off where it ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

from barquet.config import CATEGORIES, Backtest

FIGURES = ("sharpe_ratio", "sortino_ratio", "win_rate", "max_drawdown_percent", "total_trades", "total_pnl")
OUT = T.StructType([T.StructField("window", T.LongType()), T.StructField("place", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in CATEGORIES], *[T.StructField(c, T.LongType() if c == "total_trades" else T.DoubleType()) for c in FIGURES]])


class Accounts:
    """Equity, positions and running figures of many runs: what one run's scan keeps, as arrays."""

    def __init__(self, rules: Backtest, shape: tuple[int, ...]):
        self.rules = rules
        zeros = lambda: np.zeros(shape)
        self.equity, self.peak, self.before = (np.full(shape, rules.start_equity) for _ in range(3))
        self.side, self.price, self.quantity = zeros(), np.ones(shape), zeros()
        self.trades, self.wins, self.losses, self.won, self.lost = (zeros() for _ in range(5))
        self.points, self.sum, self.squares, self.down, self.falls, self.counted = 0, zeros(), zeros(), zeros(), zeros(), zeros()
        self.worst, self.worst_peak = np.full(shape, -np.inf), zeros()

    def rows(self, keep) -> Accounts:
        """The accounts of some windows alone."""
        out = object.__new__(Accounts)
        out.__dict__ = {k: v[keep].copy() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return out

    def _close(self, which: np.ndarray, price) -> None:
        fee = self.rules.fee
        notional = self.quantity * self.price
        pnl = (price - self.price) * self.side * self.quantity - (notional * fee + self.quantity * price * fee)
        pnl = np.where(which, pnl, 0.0)
        self.equity += pnl
        gain, loss = which & (pnl > 0), which & (pnl < 0)
        self.trades += which
        self.wins += gain
        self.losses += loss
        self.won += np.where(gain, pnl, 0.0)
        self.lost += np.where(loss, pnl, 0.0)
        self.side = np.where(which, 0.0, self.side)

    def _size(self, price: float, side: np.ndarray) -> np.ndarray:
        r = self.rules
        plain = self.equity * r.size / price
        if r.sizing in ("fixed_fractional", "risk_based"):
            stop = price * (1 - side * r.stop_loss)
            away = np.abs(price - stop)
            return np.divide(self.equity * r.risk_per_trade, away, out=np.zeros_like(away), where=(away > 0) & (stop > 0) & (price > 0))
        if r.sizing == "kelly":
            n = self.wins + self.losses
            rate = self.wins / np.maximum(n, 1)
            win = self.won / np.maximum(self.wins, 1)
            odds = win / np.where(self.losses > 0, np.abs(self.lost / np.maximum(self.losses, 1)), 1.0)
            share = np.divide(rate * odds - (1 - rate), odds, out=np.zeros_like(odds), where=odds > 0) * r.kelly_fraction
            return np.where(n >= 5, self.equity * np.clip(share, 0.0, 1.0) / price, plain)
        return plain

    def _point(self) -> None:
        """The bar's equity as a point of the curve."""
        self.points += 1
        some = self.before > 0
        ret = np.divide(self.equity - self.before, self.before, out=np.zeros_like(self.equity), where=some)
        self.counted += some
        self.sum += ret
        self.squares += ret * ret
        fall = ret < 0
        self.falls += fall
        self.down += np.where(fall, ret * ret, 0.0)
        self.peak = np.maximum(self.peak, self.equity)
        drop = self.peak - self.equity
        worse = drop > self.worst
        self.worst, self.worst_peak = np.where(worse, drop, self.worst), np.where(worse, self.peak, self.worst_peak)
        self.before = self.equity.copy()

    def step(self, high: float, low: float, close: float, score: np.ndarray, last: bool = False) -> None:
        """One bar: stop or target first, the stop before the target; then the signal; an exit by signal isn't followed by an entry on its bar."""
        r, side = self.rules, self.side
        open_, long = side != 0, side > 0
        stop, target = self.price * (1 - side * r.stop_loss), self.price * (1 + side * r.take_profit)
        stopped = open_ & np.where(long, low <= stop, high >= stop)
        reached = open_ & ~stopped & np.where(long, high >= target, low <= target)
        hit = stopped | reached
        if hit.any():
            self._close(hit, np.where(stopped, stop, target))
        held = open_ & ~hit
        leaves = held & np.where(long, score <= r.exit, score >= r.short_exit)
        if leaves.any():
            self._close(leaves, close)
        enters = np.where(score >= r.entry, 1.0, np.where(r.allow_shorts & (score <= r.short_entry), -1.0, 0.0))
        enters = np.where(held, 0.0, enters)
        new = enters != 0
        if new.any():
            self.quantity = np.where(new, self._size(close, enters), self.quantity)
            self.price, self.side = np.where(new, close, self.price), np.where(new, enters, self.side)
        if last:
            self._close(self.side != 0, close)
        self._point()

    def figures(self) -> dict[str, np.ndarray]:
        n, enough = self.counted, (self.points >= 2) & (self.counted >= 2)
        mean = self.sum / np.maximum(n, 1)
        sd = np.sqrt(np.maximum(0.0, self.squares - self.sum * self.sum / np.maximum(n, 1)) / np.maximum(n - 1, 1))
        year = np.sqrt(252.0)
        divided = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
        under = divided(mean, np.sqrt(divided(self.down, self.falls)))
        return {
            "sharpe_ratio": np.where(enough & (sd > 1e-15), divided(mean, sd) * year, 0.0),
            "sortino_ratio": np.where(~enough, 0.0, np.where(self.falls == 0, np.where(mean > 0, np.inf, 0.0), under * year)),
            "win_rate": divided(self.wins, self.trades), "max_drawdown_percent": np.where(self.worst > 0, divided(self.worst, self.worst_peak) * 100, 0.0),
            "total_trades": self.trades, "total_pnl": self.equity - self.rules.start_equity,
        }


class Training:
    """All candidates of a group of windows over one series. Rows: _at from 0, prices, score_* and, the same in each, _windows: how many windows the series has."""

    def __init__(self, group: int, a_group: int, draw, rules: Backtest, train: int, step: int):
        self.first, self.a_group, self.draw, self.rules, self.train, self.every = group * a_group, a_group, draw, rules, train, step
        self.accounts = None

    def step(self, row):
        if self.accounts is None:
            self.windows = list(range(self.first, min(self.first + self.a_group, row["_windows"])))
            self.weights = np.array([[[x[c] for c in CATEGORIES] for x in self.draw(w)] for w in self.windows])
            own = self.weights[..., :4]
            available = own[..., 0] + own[..., 1] + own[..., 2] + own[..., 3]
            self.shares = np.divide(own, available[..., None], out=np.zeros_like(own), where=available[..., None] != 0)
            self.accounts = Accounts(self.rules, own.shape[:2])
        if not self.windows:
            return
        score = 0.0
        for i, c in enumerate(CATEGORIES[:4]):
            score = score + row[f"score_{c}"] * self.shares[..., i]
        score = np.clip(score, -100.0, 100.0)
        bar = row["high"], row["low"], row["close"]
        if row["_at"] == self.train - 1 + self.windows[0] * self.every:  # the first window ends here
            ended = self.accounts.rows(slice(0, 1))
            ended.step(*bar, score[:1], last=True)
            figures = {k: v[0].tolist() for k, v in ended.figures().items()}
            for place, weights in enumerate(self.weights[0].tolist()):
                yield (self.windows[0], place, *weights, *[int(figures[k][place]) if k == "total_trades" else figures[k][place] for k in FIGURES])
            self.windows, self.weights, self.shares, score = self.windows[1:], self.weights[1:], self.shares[1:], score[1:]
            self.accounts = self.accounts.rows(slice(1, None))
        if self.windows:
            self.accounts.step(*bar, score)

    def finish(self):
        return ()

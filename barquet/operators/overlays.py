"""Chart overlays: means of several periods, KDJ and parabolic SAR. Formulas are the common textbook ones."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.operators.kernels import EXACT, KEYS, Ema, Wilder, _full, _since, _strength, series, so_far
from barquet.operators.scan import ordered_scan


def means(bars: DataFrame, prices: tuple[int, ...] = (5, 10, 30, 60), volumes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """``bars`` and n, ma_* and volume_ma_*: plain means of closes and volumes, from exact running sums."""
    out = bars.withColumns({"n": F.row_number().over(series()), "_s": F.sum(F.col("close").cast(EXACT)).over(so_far()), "_v": F.sum(F.col("volume").cast(EXACT)).over(so_far())})
    out = out.withColumns({f"ma_{p}": _full(_since("_s", p) / p, p) for p in prices} | {f"volume_ma_{p}": _full(_since("_v", p) / p, p) for p in volumes})
    return out.drop("_s", "_v")


class Sar:
    """Parabolic stop and reverse: closes in on the extreme faster with each new one, and turns when it is hit."""

    def __init__(self, start: float, step: float, most: float):
        self.start, self.step, self.most = start, step, most
        self.up, self.value, self.extreme, self.speed = True, None, 0.0, start
        self.lows: deque[float] = deque(maxlen=2)
        self.highs: deque[float] = deque(maxlen=2)

    def push(self, high: float, low: float) -> float | None:
        out = None
        if self.value is None:
            self.value, self.extreme = low, high
        else:
            at = self.value + self.speed * (self.extreme - self.value)
            at = min(at, *self.lows) if self.up else max(at, *self.highs)
            if low < at if self.up else high > at:
                self.up, self.value, self.extreme, self.speed = not self.up, self.extreme, low if self.up else high, self.start
            else:
                self.value = at
                if high > self.extreme if self.up else low < self.extreme:
                    self.extreme, self.speed = high if self.up else low, min(self.speed + self.step, self.most)
            out = self.value
        self.lows.append(low)
        self.highs.append(high)
        return out


class _Overlays:
    def __init__(self, columns, ema, rsi, kdj, sar):
        self.columns = columns
        self.emas = [Ema(p) for p in ema]
        self.rsis = [(Wilder(p), Wilder(p)) for p in rsi]
        (n, self.mk, self.md), self.k, self.d = kdj, 50.0, 50.0
        self.highs: deque[float] = deque(maxlen=n)
        self.lows: deque[float] = deque(maxlen=n)
        self.sar, self.before = Sar(*sar), None

    def step(self, row):
        high, low, close = row["high"], row["low"], row["close"]
        change = None if self.before is None else close - self.before
        rsis = [None if change is None else _strength(g.push(max(change, 0.0)), x.push(max(-change, 0.0))) for g, x in self.rsis]
        self.highs.append(high)
        self.lows.append(low)
        k = d = None
        if len(self.highs) == self.highs.maxlen:
            hh, ll = max(self.highs), min(self.lows)
            raw = (close - ll) / (hh - ll) * 100 if hh > ll else 0.0
            k = self.k = ((self.mk - 1) * self.k + raw) / self.mk
            d = self.d = ((self.md - 1) * self.d + k) / self.md
        self.before = close
        yield (*(row[c] for c in self.columns), *[e.push(close) for e in self.emas], *rsis, k, d, None if k is None else 3 * k - 2 * d, self.sar.push(high, low))

    def finish(self):
        return ()


def overlays(bars: DataFrame, ema: tuple[int, ...] = (6, 12, 20), rsi: tuple[int, ...] = (6, 12, 24), kdj: tuple[int, int, int] = (9, 3, 3), sar: tuple[float, float, float] = (0.02, 0.02, 0.2)) -> DataFrame:
    """``bars`` and ema_*, rsi_*, kdj_k, kdj_d, kdj_j, sar; null while warming up."""
    own = [c for c in bars.columns if c not in KEYS]
    new = [*(f"ema_{p}" for p in ema), *(f"rsi_{p}" for p in rsi), "kdj_k", "kdj_d", "kdj_j", "sar"]
    out = T.StructType([*bars.select(own).schema, *(T.StructField(c, T.DoubleType()) for c in new)])
    return ordered_scan(bars, KEYS, ["ts"], own, lambda *_: _Overlays(own, ema, rsi, kdj, sar), out)

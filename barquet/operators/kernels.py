"""Indicators of OHLCV series: one column each, null while an indicator warms up.

Kernels over a fixed number of bars are window expressions, all over one partitioning and order, so
that Spark sorts a series once. Their sums are differences of running decimal sums: a row costs the
same whatever the period, and the result doesn't depend on the order of additions. Recursive
kernels (EMA, Wilder's averages, SuperTrend) follow in one ordered scan.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.config import Indicators
from barquet.operators import ranges
from barquet.operators.checkpoints import kept
from barquet.operators.scan import ordered_scan

KEYS = ["symbol", "interval"]
EXACT = "decimal(28,8)"


def series() -> WindowSpec:
    return W.partitionBy(*KEYS).orderBy("ts")


def so_far() -> WindowSpec:
    return series().rowsBetween(W.unboundedPreceding, 0)


def last(n: int) -> WindowSpec:
    """The frame of the current row and the n - 1 before it."""
    return series().rowsBetween(1 - n, 0)


def _since(total: str, n: int) -> Column:
    """Sum over the last n rows from a column of running sums."""
    return (F.col(total) - F.coalesce(F.lag(total, n).over(series()), F.lit(0).cast("decimal(38,8)"))).cast("double")


def _full(value: Column, rows: int) -> Column:
    return F.when(F.col("n") >= rows, value)


def rolling(bars: DataFrame, cfg: Indicators = Indicators()) -> DataFrame:
    """``bars`` and n (row of the series from 1), sma_medium, sma_long, bb_*, williams_r, ichimoku_*, obv, obv_sma, mfi, volume_ratio.

    Sums are exact for prices and volumes of up to eight decimals. A flat window has no %R, no %B, and MFI is 100
    without falling typical prices. obv has its first value at the second bar, mfi after its period of changes.
    """
    change = F.col("close") - F.lag("close").over(series())
    typical = F.col("high") + F.col("low") + F.col("close")  # three times it: MFI is a ratio
    step = typical - F.lag(typical).over(series())
    flow = typical * F.col("volume")
    out = bars.withColumns(
        {
            "n": F.row_number().over(series()),
            "_signed": F.coalesce(F.signum(change) * F.col("volume"), F.lit(0.0)),
            "_up": F.when(step > 0, flow).otherwise(0.0),
            "_down": F.when(step < 0, flow).otherwise(0.0),
        }
        | {f"_hh{p}": F.max("high").over(last(p)) for p in {cfg.williams, *cfg.ichimoku}}
        | {f"_ll{p}": F.min("low").over(last(p)) for p in {cfg.williams, *cfg.ichimoku}}
    )
    sums = {"_s": F.col("close"), "_ss": F.col("close") * F.col("close"), "_v": F.col("volume"), "_o": F.col("_signed"), "_u": F.col("_up"), "_d": F.col("_down")}
    out = out.withColumns({c: F.sum(x.cast(EXACT)).over(so_far()) for c, x in sums.items()})
    out = out.withColumn("_oo", F.sum(F.when(F.col("n") > 1, F.col("_o")).otherwise(0).cast(EXACT)).over(so_far()))
    p, k = cfg.bollinger
    s, up, down = _since("_s", p), _since("_u", cfg.mfi), _since("_d", cfg.mfi)
    middle, width = F.col("bb_middle"), F.col("_sd") * k
    hh, ll = F.col(f"_hh{cfg.williams}"), F.col(f"_ll{cfg.williams}")
    mids = {name: _full((F.col(f"_hh{q}") + F.col(f"_ll{q}")) / 2, q) for name, q in zip(("ichimoku_conversion", "ichimoku_base", "ichimoku_span_b"), cfg.ichimoku, strict=True)}
    volume_mean = F.when(F.col("n") >= cfg.volume, _since("_v", cfg.volume) / cfg.volume).otherwise(F.col("volume"))
    out = out.withColumns(
        {
            "sma_medium": _full(_since("_s", cfg.sma[0]) / cfg.sma[0], cfg.sma[0]),
            "sma_long": _full(_since("_s", cfg.sma[1]) / cfg.sma[1], cfg.sma[1]),
            "bb_middle": _full(s / p, p),
            "_sd": F.sqrt(F.greatest((_since("_ss", p) - s * s / p) / p, F.lit(0.0))),
            "williams_r": _full(F.try_divide((hh - F.col("close")) * -100, hh - ll), cfg.williams),
            "obv": F.when(F.col("n") > 1, F.col("_o").cast("double")),
            "obv_sma": F.when(F.col("n") >= 21, _since("_oo", 20) / 20).otherwise(F.col("_o").cast("double")),
            "mfi": _full(F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down))), cfg.mfi + 1),
            "volume_ratio": F.when(volume_mean > 0, F.col("volume") / volume_mean).otherwise(1.0),
        }
        | mids
    )
    out = out.withColumns({"bb_upper": middle + width, "bb_lower": middle - width})
    out = out.withColumns({"bb_pb": F.try_divide(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), "ichimoku_span_a": F.when(F.col("ichimoku_span_b").isNotNull(), (F.col("ichimoku_conversion") + F.col("ichimoku_base")) / 2)})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


class Ema:
    """Exponential mean seeded with the mean of its first p values."""

    def __init__(self, p: int):
        self.p, self.k, self.n, self.value = p, 2 / (p + 1), 0, 0.0

    def push(self, x: float) -> float | None:
        self.n += 1
        if self.n <= self.p:
            self.value += x
            if self.n < self.p:
                return None
            self.value /= self.p
        else:
            self.value = (x - self.value) * self.k + self.value
        return self.value


class Wilder:
    """Wilder's mean: of the first p values, then p - 1 parts old and one part new."""

    def __init__(self, p: int):
        self.p, self.n, self.value = p, 0, 0.0

    def push(self, x: float) -> float | None:
        self.n += 1
        if self.n <= self.p:
            self.value += x
            if self.n < self.p:
                return None
            self.value /= self.p
        else:
            self.value = (self.value * (self.p - 1) + x) / self.p
        return self.value


class Mean:
    """Mean of the last p values."""

    def __init__(self, p: int):
        self.values: deque[float] = deque(maxlen=p)

    def push(self, x: float) -> float | None:
        self.values.append(x)
        if len(self.values) < self.values.maxlen:
            return None
        total = 0.0
        for v in self.values:  # sum() would compensate for rounding, which SQL doesn't
            total += v
        return total / len(self.values)


class SuperTrend:
    """Bands around the middle that only tighten until the close breaks them."""

    def __init__(self, p: int, multiple: float):
        self.atr, self.multiple = Wilder(p), multiple
        self.upper, self.lower, self.up = float("inf"), float("-inf"), True

    def push(self, true_range: float, high: float, low: float, close: float, before: float) -> tuple[float | None, bool | None]:
        atr = self.atr.push(true_range)
        if atr is None:
            return None, None
        middle = (high + low) / 2
        upper, lower = middle + self.multiple * atr, middle - self.multiple * atr
        if before <= self.upper:
            upper = min(upper, self.upper)
        if before >= self.lower:
            lower = max(lower, self.lower)
        self.upper, self.lower = upper, lower
        self.up = close >= lower if self.up else close > upper
        return (lower if self.up else upper), self.up


RECURSIVE = ("ema_fast", "ema_slow", "rsi", "macd", "macd_signal", "macd_histogram", "atr", "stoch_rsi", "stoch_k", "stoch_d", "supertrend")


class _Recursive:
    def __init__(self, cfg: Indicators, columns: list[str]):
        self.columns = columns
        self.fast, self.slow = Ema(cfg.ema[0]), Ema(cfg.ema[1])
        self.macd_fast, self.macd_slow, self.signal = (Ema(p) for p in cfg.macd)
        self.gain, self.loss, self.atr = Wilder(cfg.rsi), Wilder(cfg.rsi), Wilder(cfg.atr)
        self.stoch_gain, self.stoch_loss = Wilder(cfg.stoch[0]), Wilder(cfg.stoch[0])
        self.seen: deque[float] = deque(maxlen=cfg.stoch[1])
        self.k, self.d = Mean(cfg.stoch[2]), Mean(cfg.stoch[3])
        self.trend = SuperTrend(*cfg.supertrend)
        self.before: float | None = None

    def step(self, row):
        close, before = row["close"], self.before
        rsi = stoch_rsi = atr = raw = k = d = line = up = macd = signal = None
        fast, slow = self.fast.push(close), self.slow.push(close)
        a, b = self.macd_fast.push(close), self.macd_slow.push(close)
        if a is not None and b is not None:
            macd = a - b
            signal = self.signal.push(macd)
        if before is not None:
            change = close - before
            rsi = _strength(self.gain.push(max(change, 0.0)), self.loss.push(max(-change, 0.0)))
            stoch_rsi = _strength(self.stoch_gain.push(max(change, 0.0)), self.stoch_loss.push(max(-change, 0.0)))
            spread = max(row["high"] - row["low"], abs(row["high"] - before), abs(row["low"] - before))
            atr = self.atr.push(spread)
            line, up = self.trend.push(spread, row["high"], row["low"], close, before)
        if stoch_rsi is not None:
            self.seen.append(stoch_rsi)
            if len(self.seen) == self.seen.maxlen:
                low, high = min(self.seen), max(self.seen)
                raw = (stoch_rsi - low) / (high - low) * 100 if high > low else 0.0
                k = self.k.push(raw)
                d = None if k is None else self.d.push(k)
        self.before = close
        yield (
            *(row[c] for c in self.columns),
            fast, slow, rsi, macd, None if macd is None else signal or 0.0, None if macd is None else 0.0 if signal is None else macd - signal, atr,
            None if d is None else raw, None if d is None else k, d, line, up,
        )

    def finish(self):
        return ()


def _strength(gain: float | None, loss: float | None) -> float | None:
    """Relative strength index of mean gains and losses; 100 without losses."""
    return None if gain is None or loss is None else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)


def recursive(bars: DataFrame, cfg: Indicators = Indicators(), clustered: bool = False) -> DataFrame:
    """``bars`` and ema_fast, ema_slow, rsi, macd, macd_signal, macd_histogram, atr, stoch_rsi, stoch_k, stoch_d, supertrend, supertrend_up.

    The MACD's signal and histogram are zero until the signal has its first mean. StochRSI is 0 over flat RSIs.
    Bars with a null price are left out.
    """
    bars = bars.where("close is not null and high is not null and low is not null")
    own = [c for c in bars.columns if c not in KEYS]
    out = T.StructType([*bars.select(own).schema, *(T.StructField(c, T.DoubleType()) for c in RECURSIVE), T.StructField("supertrend_up", T.BooleanType())])
    return ordered_scan(bars, KEYS, ["ts"], own, lambda *_: _Recursive(cfg, own), out, clustered)


def _ema_map(p: int, x: Column, n: Column) -> tuple[Column, Column]:
    """The step of ``Ema`` as a map y -> a y + b: a sum of the first p values, their mean, then a share of each."""
    k = 2 / (p + 1)
    return F.when(n < p, 1.0).when(n == p, 1 / p).otherwise(1 - k), F.when(n < p, x).when(n == p, x / p).otherwise(x * k)


def _wilder_map(p: int, x: Column, n: Column) -> tuple[Column, Column]:
    return F.when(n < p, 1.0).when(n == p, 1 / p).otherwise((p - 1) / p), F.when(n < p, x).otherwise(x / p)


def long_means(bars: DataFrame, cfg: Indicators = Indicators(), rows_a_range: int = ranges.ROWS) -> DataFrame:
    """``bars``, n, ema_fast, ema_slow, rsi, macd, macd_signal, macd_histogram and atr, for series of any length.

    The same figures as ``recursive``'s but for the last digits (1e-9 of the value): a series is cut into ranges that run side by side, where
    ``recursive`` needs a task for the whole series. Bars with a null price are left out; ts has to tell a series' bars apart.
    """
    keys, order, n = KEYS, ["ts"], F.col("n")
    rows = ranges.ranged(bars.where("close is not null and high is not null and low is not null"), keys, order, rows_a_range)
    rows = ranges.numbered(rows, keys, order, {"_before": "close"})
    close, before = F.col("close"), F.col("_before")
    change = close - before
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    some = before.isNotNull()  # the first bar has no change
    wilder = lambda p, x: tuple(F.when(some, c) for c in _wilder_map(p, x, n - 1))
    maps = {"ema_fast": _ema_map(cfg.ema[0], close, n), "ema_slow": _ema_map(cfg.ema[1], close, n), "_fast": _ema_map(cfg.macd[0], close, n), "_slow": _ema_map(cfg.macd[1], close, n)}
    maps |= {"_gain": wilder(cfg.rsi, F.greatest(change, F.lit(0.0))), "_loss": wilder(cfg.rsi, F.greatest(-change, F.lit(0.0))), "atr": wilder(cfg.atr, spread)}
    out = ranges.affine(rows, keys, order, maps)
    first = max(cfg.macd[:2])
    out = kept(out.withColumn("macd", F.when(n >= first, F.col("_fast") - F.col("_slow"))))
    m = n - first + 1
    signal = tuple(F.when(m >= 1, c) for c in _ema_map(cfg.macd[2], F.col("macd"), m))
    out = ranges.affine(out, keys, order, {"macd_signal": signal})
    ready = m >= cfg.macd[2]
    strength = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_gain", "_loss")))
    out = out.withColumns(
        {
            "ema_fast": _full(F.col("ema_fast"), cfg.ema[0]), "ema_slow": _full(F.col("ema_slow"), cfg.ema[1]), "rsi": _full(strength, cfg.rsi + 1), "atr": _full(F.col("atr"), cfg.atr + 1),
            "macd_histogram": F.when(m >= 1, F.when(ready, F.col("macd") - F.col("macd_signal")).otherwise(0.0)), "macd_signal": F.when(m >= 1, F.when(ready, F.col("macd_signal")).otherwise(0.0)),
        }
    )
    return out.drop("part", *[c for c in out.columns if c.startswith("_")])


def suite(bars: DataFrame, cfg: Indicators = Indicators(), enough: bool = True) -> DataFrame:
    """All indicators of each bar; of series with cfg.min_candles bars at least, if ``enough``."""
    if enough:
        bars = bars.withColumn("_count", F.count("*").over(W.partitionBy(*KEYS))).where(F.col("_count") >= cfg.min_candles).drop("_count")
    return recursive(rolling(bars, cfg), cfg, clustered=True)


def warmup(suites: DataFrame, skip_ichimoku: bool = False) -> DataFrame:
    """For each series the number of bars before the first that has every indicator; null if there is none."""
    needed = ["ema_slow", "sma_long", "rsi", "macd", "bb_middle", "atr", "stoch_d", "williams_r", "obv", "mfi"] + ["ichimoku_span_b"] * (not skip_ichimoku)
    ready = F.lit(True)
    for c in needed:
        ready = ready & F.col(c).isNotNull()
    return suites.groupBy(*KEYS).agg((F.min(F.when(ready, F.col("n"))) - 1).cast("long").alias("warmup"))

"""Signals from indicator values: a struct of name, value, direction and strength each.

Directions are bullish, bearish and neutral; strengths lie between 0 and 100. All are built-in
expressions of columns, so a whole suite stays in one generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BULL, BEAR, FLAT = "bullish", "bearish", "neutral"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def signal(name: str, value: Column, *cases: tuple[Column, str, Column | float], default: tuple[str, Column | float]) -> Column:
    """The first case whose condition holds gives direction and strength."""
    as_col = lambda s: s if isinstance(s, Column) else F.lit(float(s))
    direction, strength = F.lit(default[0]), as_col(default[1])
    for condition, d, s in reversed(cases):
        direction, strength = F.when(condition, F.lit(d)).otherwise(direction), F.when(condition, as_col(s)).otherwise(strength)
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), direction.alias("direction"), clamp(strength, 0, 100).alias("strength"))


def describe(s: Column) -> Column:
    """A signal in words: its name, direction and value."""
    return F.format_string("%s %s at %.2f", s["name"], s["direction"], s["value"])


def ema_cross(fast: Column, slow: Column, close: Column) -> Column:
    """Twenty points for each percent between the means; three fifths if the price disagrees."""
    spread = F.try_divide(fast - slow, slow) * 100
    strength = F.least(F.lit(100.0), F.abs(spread) * 20)
    over = fast > slow
    agrees = (close > fast) == over
    return signal("EMA Cross", spread, (over & agrees, BULL, strength), (over, BULL, strength * 0.6), (agrees, BEAR, strength), default=(BEAR, strength * 0.6))


def sma_trend(close: Column, medium: Column, long: Column) -> Column:
    a, b, golden = close > medium, close > long, medium > long
    return signal("SMA Trend", close, (a & b & golden, BULL, 80), (~a & ~b & ~golden, BEAR, 80), (a & golden, BULL, 50), (~a & ~golden, BEAR, 50), default=(FLAT, 30))


def ichimoku(conversion: Column, base: Column, span_a: Column, span_b: Column, close: Column) -> Column:
    """Null where the cloud is null."""
    over, under = close > F.greatest(span_a, span_b), close < F.least(span_a, span_b)
    found = signal("Ichimoku", close, (over & (conversion > base), BULL, 75), (under & (conversion < base), BEAR, 75), (over, BULL, 50), (under, BEAR, 50), default=(FLAT, 25))
    return F.when(span_b.isNotNull(), found)


def rsi(x: Column) -> Column:
    return signal("RSI", x, (x >= 80, BEAR, 90), (x >= 70, BEAR, 65), (x <= 20, BULL, 90), (x <= 30, BULL, 65), (x >= 60, BULL, 30), (x <= 40, BEAR, 30), default=(FLAT, 10))


def macd(line: Column, histogram: Column) -> Column:
    s = F.least(F.lit(100.0), F.abs(histogram) * 1000)
    return signal(
        "MACD", histogram, ((line > 0) & (histogram > 0), BULL, s), ((line > 0) & (histogram < 0), BULL, 30), ((line < 0) & (histogram < 0), BEAR, s), ((line < 0) & (histogram > 0), BEAR, 30), default=(FLAT, 10)
    )


def stochastic_rsi(k: Column, d: Column) -> Column:
    return signal("StochRSI", k, ((k > 80) & (d > 80), BEAR, 70), ((k < 20) & (d < 20), BULL, 70), ((k > d) & (k < 80), BULL, 40), ((k < d) & (k > 20), BEAR, 40), default=(FLAT, 20))


def williams_r(x: Column) -> Column:
    return signal("Williams %R", x, (x > -20, BEAR, 65), (x < -80, BULL, 65), default=(FLAT, 20))


def bollinger(pb: Column) -> Column:
    return signal("Bollinger", pb, (pb > 1, BEAR, 70), (pb < 0, BULL, 70), (pb > 0.8, BEAR, 40), (pb < 0.2, BULL, 40), default=(FLAT, 10))


def atr(x: Column, close: Column) -> Column:
    percent = F.try_divide(x, close) * 100
    return signal("ATR", percent, (percent > 5, FLAT, 80), (percent > 3, FLAT, 50), default=(FLAT, 30))


def obv(current: Column, mean: Column) -> Column:
    distance = F.coalesce(F.try_divide(F.abs(current - mean), F.abs(mean)) * 100, F.lit(0.0))
    return signal("OBV", current, (current > mean, BULL, distance), default=(BEAR, distance))


def mfi(x: Column) -> Column:
    return signal("MFI", x, (x >= 80, BEAR, 70), (x <= 20, BULL, 70), (x >= 60, BULL, 30), (x <= 40, BEAR, 30), default=(FLAT, 10))


def volume(ratio: Column) -> Column:
    return signal("Volume", ratio, (ratio > 2, FLAT, 90), (ratio > 1.5, FLAT, 60), (ratio < 0.5, FLAT, 40), default=(FLAT, 20))


def supertrend(up: Column) -> Column:
    """Null where the direction is null."""
    return F.when(up.isNotNull(), signal("SuperTrend", F.when(up, 1.0).otherwise(-1.0), (up, BULL, 60), default=(BEAR, 60)))


def funding(rate: Column) -> Column:
    """Contrarian: longs that pay are a bearish sign. Null where the rate is null."""
    s = F.least(F.lit(90.0), F.abs(rate) * 10_000)
    return F.when(rate.isNotNull(), signal("Funding Rate", rate, (rate < -0.001, BULL, s), (rate < -0.0001, BULL, 40), (rate > 0.001, BEAR, s), (rate > 0.0001, BEAR, 40), default=(FLAT, 0)))


def long_short(ratio: Column) -> Column:
    heavy, light = F.least(F.lit(80.0), (ratio - 1) * 40), F.least(F.lit(80.0), (F.try_divide(F.lit(1.0), ratio) - 1) * 40)
    return F.when(ratio.isNotNull(), signal("Long/Short Ratio", ratio, (ratio > 2, BEAR, heavy), (ratio > 1.3, BEAR, 40), (ratio < 0.5, BULL, F.coalesce(light, F.lit(80.0))), (ratio < 0.77, BULL, 40), default=(FLAT, 0)))


def fear_greed(x: Column) -> Column:
    return F.when(x.isNotNull(), signal("Fear & Greed", x, (x <= 10, BULL, 80), (x <= 25, BULL, 60), (x >= 90, BEAR, 80), (x >= 75, BEAR, 60), (x >= 60, BEAR, 20), (x <= 40, BULL, 20), default=(FLAT, 0)))


def by_category(live: bool = False, skip_ichimoku: bool = False) -> dict[str, Column]:
    """Arrays of signals over the columns of a suite, by category.

    Columns in their warm-up count as neutral values. ``live`` takes the fast mean for the close, as the scores of
    the latest bar do; scores of past bars take the close.
    """
    close = F.col("close")
    fast, slow = F.coalesce("ema_fast", close), F.coalesce("ema_slow", close)
    price = fast if live else close
    c = lambda name, default: F.coalesce(F.col(name), F.lit(float(default)))
    trend = [ema_cross(fast, slow, price), sma_trend(price, F.coalesce("sma_medium", close), F.coalesce("sma_long", close))]
    if not skip_ichimoku:
        trend.append(ichimoku(F.col("ichimoku_conversion"), F.col("ichimoku_base"), F.col("ichimoku_span_a"), F.col("ichimoku_span_b"), price))
    return {
        "trend": F.array_compact(F.array(*trend, supertrend(F.col("supertrend_up")))),
        "momentum": F.array(rsi(c("rsi", 50)), macd(c("macd", 0), c("macd_histogram", 0)), stochastic_rsi(c("stoch_k", 50), c("stoch_d", 50)), williams_r(c("williams_r", -50))),
        "volume": F.array(obv(c("obv", 0), c("obv_sma", 0)), mfi(c("mfi", 50)), volume(F.col("volume_ratio"))),
        "volatility": F.array(bollinger(c("bb_pb", 0.5)), atr(c("atr", 0), price)),
    }

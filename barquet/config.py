"""Parameters of indicators, scores, backtests and risk figures, and table schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CATEGORIES = ("trend", "momentum", "volume", "volatility", "futures", "sentiment")

CANDLES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("interval", T.StringType()), T.StructField("ts", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)

#: Milliseconds of the intervals that have a fixed length.
INTERVAL_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}


@dataclass(frozen=True)
class Indicators:
    """Periods of all indicators; the defaults are those of day trading."""

    ema: tuple[int, int] = (12, 26)
    sma: tuple[int, int] = (50, 200)
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger: tuple[int, float] = (20, 2.0)
    atr: int = 14
    stoch: tuple[int, int, int, int] = (14, 14, 3, 3)
    williams: int = 14
    ichimoku: tuple[int, int, int] = (9, 26, 52)
    mfi: int = 14
    volume: int = 20
    supertrend: tuple[int, float] = (10, 3.0)
    displacement: int = 26

    @property
    def min_candles(self) -> int:
        """Bars that a full suite asks for: the longest period, a displaced cloud included, and ten more."""
        return max(*self.ema, *self.sma, self.rsi, *self.macd, self.bollinger[0], self.atr, *self.stoch, self.williams, self.ichimoku[2] + self.displacement, self.mfi) + 10


@dataclass(frozen=True)
class Style:
    """A way of trading: periods, category weights, thresholds, and how long a signal counts."""

    indicators: Indicators
    weights: dict[str, float]
    entry: float
    exit: float
    intervals: tuple[str, ...]
    ttl_days: int
    min_candles: int
    skip_ichimoku: bool = False

    @property
    def short_entry(self) -> float:
        return -self.entry

    @property
    def short_exit(self) -> float:
        return -self.exit


def _weights(*values: float) -> dict[str, float]:
    return dict(zip(CATEGORIES, values, strict=True))


#: Weights of the categories without a style.
DEFAULT_WEIGHTS = _weights(0.25, 0.25, 0.15, 0.10, 0.15, 0.10)

#: Fixed values of the four styles.
STYLES = {
    "scalping": Style(
        Indicators((5, 13), (20, 50), 7, (5, 13, 5), (10, 2.0), 7, (7, 7, 3, 3), 7, (9, 26, 52), 7), _weights(0.10, 0.40, 0.30, 0.15, 0.05, 0.00), 50, 10, ("1m", "5m"), 1, 50, True
    ),
    "day_trading": Style(Indicators(), _weights(0.25, 0.30, 0.20, 0.10, 0.10, 0.05), 40, 10, ("15m", "1h"), 7, 200),
    "swing_trading": Style(
        Indicators((21, 55), (50, 200), 21, (21, 55, 9), (20, 2.0), 14, (14, 14, 3, 3), 14, (9, 26, 52), 14), _weights(0.30, 0.20, 0.10, 0.10, 0.20, 0.10), 35, 5, ("4h", "1d"), 30, 200
    ),
    "position_trading": Style(
        Indicators((50, 200), (100, 400), 28, (26, 100, 9), (30, 2.0), 21, (21, 21, 3, 3), 28, (26, 52, 104), 21), _weights(0.35, 0.10, 0.05, 0.05, 0.25, 0.20), 30, 0, ("1d",), 90, 400
    ),
}


@dataclass(frozen=True)
class Backtest:
    """Rules of a backtest; ``sizing`` is fixed_percent, fixed_fractional, kelly or risk_based."""

    entry: float = 30.0
    exit: float = -10.0
    short_entry: float = -30.0
    short_exit: float = 10.0
    stop_loss: float = 0.05
    take_profit: float = 0.10
    size: float = 0.10
    allow_shorts: bool = False
    fee: float = 0.001
    start_equity: float = 10_000.0
    sizing: str = "fixed_percent"
    risk_per_trade: float = 0.01
    kelly_fraction: float = 0.5
    gross_percent: bool = False
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))


#: Fixed values of walk-forward runs and of what counts as robust.
WALK_FORWARD = {"train": 300, "test": 100, "step": 300, "candidates": 50, "constraint": 0.20}
ROBUST = {"min_sharpe": 0.5, "min_win_rate": 0.4, "max_drawdown": 0.3, "min_trades": 10}

#: Fixed values of portfolio risk figures.
RISK = {"drawdown_points": 7, "ratio_points": 30, "risk_free": 0.05, "days": 365}

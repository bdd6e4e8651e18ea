"""Indicators and scores: known values, bounds, and independence of how rows arrive."""

import random

import pytest
from pyspark.sql import functions as F

from barquet.config import DEFAULT_WEIGHTS, STYLES, Indicators
from barquet.functions import interpret, score
from barquet.operators import bars, kernels

#: Closes whose RSI(14) is known to be about 68.36.
CLOSES = [44, 44.34, 44.09, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00, 46.03, 46.41, 46.22, 46.21]


def series(spark, closes, volumes=None, symbol="A"):
    volumes = volumes or [100.0] * len(closes)
    rows = [(symbol, "1h", i * 3_600_000, float(c), float(c) + 1, float(c) - 1, float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, interval string, ts long, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def walk(spark):
    rng, x, out = random.Random(123), 100.0, []
    for _ in range(320):
        x = max(1.0, round(x * (1 + rng.uniform(-0.02, 0.021)), 2))
        out.append(x)
    return series(spark, out, [rng.randrange(1000, 6000) for _ in out])


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_sma(spark):
    assert column(kernels.rolling(series(spark, [1, 2, 3, 4, 5]), Indicators(sma=(3, 4))), "sma_medium") == [None, None, 2, 3, 4]


def test_rsi(spark):
    assert column(kernels.recursive(series(spark, CLOSES)), "rsi")[-1] == pytest.approx(68.3564, abs=1e-3)


def test_obv(spark):
    assert column(kernels.rolling(series(spark, [10, 11, 12], [100, 200, 300])), "obv") == [None, 200, 500]


def test_flat_series(spark):
    last = kernels.suite(series(spark, [50.0] * 220)).orderBy(F.desc("ts")).first()
    assert last["volume_ratio"] == 1 and last["bb_pb"] is None and last["stoch_rsi"] == 0 and last["rsi"] == 100 and last["mfi"] == 100


def test_bounds(walk):
    for r in kernels.suite(walk).where("n > 200").collect():
        assert 0 <= r["rsi"] <= 100 and 0 <= r["mfi"] <= 100 and -100 <= r["williams_r"] <= 0 and r["bb_lower"] <= r["bb_middle"] <= r["bb_upper"] and r["atr"] > 0
        assert r["macd_histogram"] == r["macd"] - r["macd_signal"]


def test_too_short(spark):
    assert kernels.suite(series(spark, [1.0] * 209)).count() == 0


def test_min_candles():
    assert {k: s.indicators.min_candles for k, s in STYLES.items()} == {"scalping": 88, "day_trading": 210, "swing_trading": 210, "position_trading": 410}


def test_order_of_rows(spark, walk):
    again = walk.orderBy(F.rand(3)).repartition(7)
    assert sorted(kernels.suite(walk).collect()) == sorted(kernels.suite(again).collect())


def test_supertrend_turns(spark):
    up = kernels.recursive(series(spark, [100 + i for i in range(60)] + [160 - 4 * i for i in range(30)]))
    found = [r["supertrend_up"] for r in up.orderBy("ts").collect()]
    assert found[10:60] == [True] * 50 and found[-1] is False


def test_scores(walk):
    rows = score.composite(kernels.suite(walk), DEFAULT_WEIGHTS, fear_greed=F.lit(5), funding=F.lit(0.002)).collect()
    assert all(-100 <= r["score"] <= 100 and r["confidence"] == 100 for r in rows)
    assert {r["score_sentiment"] for r in rows} == {80.0} and {r["score_futures"] for r in rows} == {-20.0}


def test_missing_categories(spark):
    one = spark.range(1).select(F.lit(None).cast("boolean").alias("x"))
    assert one.select(score.confidence(F.lit(False), F.lit(False), DEFAULT_WEIGHTS).alias("c")).first()["c"] == 75
    empty = F.array().cast("array<struct<direction:string,strength:double>>")
    assert one.select(score.category_score(empty).alias("c")).first()["c"] == 0


@pytest.mark.parametrize(("score_", "tier"), [(60.1, "strong_buy"), (60.0, "buy"), (30.0, "neutral"), (-30.0, "neutral"), (-30.1, "sell"), (-60.0, "sell"), (-60.1, "strong_sell")])
def test_tiers(spark, score_, tier):
    assert spark.range(1).select(score.tier(F.lit(score_)).alias("t")).first()["t"] == tier


@pytest.mark.parametrize(("rsi", "direction", "strength"), [(80, "bearish", 90), (70, "bearish", 65), (20, "bullish", 90), (30, "bullish", 65), (60, "bullish", 30), (40, "bearish", 30), (50, "neutral", 10)])
def test_rsi_bands(spark, rsi, direction, strength):
    s = spark.range(1).select(interpret.rsi(F.lit(float(rsi))).alias("s")).first()["s"]
    assert (s["direction"], s["strength"]) == (direction, strength)


def test_rollup_and_resample(spark):
    ticks = spark.createDataFrame([("A", 10, 1, 5.0), ("A", 20, 2, 9.0), ("A", 59_999, 3, 1.0), ("A", 60_000, 4, 7.0), ("A", 60_000, 5, 8.0)], "symbol string, ts long, event_id long, price double")
    got = [tuple(r)[2:] for r in bars.rollup(ticks, "1m").orderBy("ts").collect()]
    assert got == [(0, 5, 9, 1, 1, 3), (60_000, 7, 8, 7, 8, 2)]
    assert [tuple(r)[2:] for r in bars.resample(bars.rollup(ticks, "1m"), "5m").collect()] == [(0, 5, 9, 1, 8, 5)]
    with pytest.raises(KeyError):
        bars.rollup(ticks, "7m")


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, bars.upsert(old, new, ["k"], "seq").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert bars.inserted(old, new, ["k"]).first()["inserted"] == 1

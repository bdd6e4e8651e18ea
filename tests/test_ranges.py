"""Ordered work over ranges: one key spread over many tasks gives what one ordered scan gives."""

import random

import pytest
from pyspark.sql import functions as F

from barquet.operators import kernels, lots, portfolio, ranges

TX = "symbol string, type string, quantity double, price double, fee double, date long"


def transactions(spark, rows=3000, seed=7):
    """A third and more of the rows in one symbol, sales beyond what is held, quantities of eight places, a null symbol."""
    rng = random.Random(seed)
    symbol = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    made = [(symbol(), rng.choice(["buy", "buy", "sell"]), rng.randrange(1, 10**9) / 10**8, rng.randrange(100, 9999) / 100, rng.choice([0.0, None, 0.25]), i) for i in range(rows)]
    return spark.createDataFrame(made + [("a", "buy", 0.0, 1.0, 0.0, 5), ("b", "sell", None, 1.0, 0.0, 6)], TX)


def test_hot_symbol_is_split(spark):
    t = transactions(spark)
    numbered = ranges.ranged(t, ["symbol"], ["date"], 100)
    assert numbered.where("symbol = 'hot'").select("part").distinct().count() > 10
    keys = ["symbol", "buy_seq", "sell_seq"]
    got = {tuple(r[k] for k in keys): r for r in lots.fifo_gains(t, ["date"], rows_a_range=100).collect()}
    want = {tuple(r[k] for k in keys): r for r in lots.matches(t, ["date"]).where("kind = 'gain' and symbol is not null").collect() if r["quantity"] > 1e-7}
    assert set(want) <= set(got) and len(want) > 1000
    for k, r in got.items():
        if r["quantity"] > 1e-7:
            assert r["quantity"] == pytest.approx(want[k]["quantity"], abs=1e-7) and r["gain"] == pytest.approx(want[k]["gain"], abs=1e-4)
    whole = {tuple(r[k] for k in keys): r["quantity"] for r in lots.fifo_gains(t, ["date"]).collect()}
    assert {k: r["quantity"] for k, r in got.items()} == whole


def test_open_lots_of_a_hot_symbol(spark):
    t = transactions(spark, seed=8)
    key = lambda r: (r["symbol"], r["buy_seq"])
    got = {key(r): r["remaining"] for r in lots.fifo_open(t, ["date"], rows_a_range=100).collect()}
    assert got == {key(r): r["remaining"] for r in lots.fifo_open(t, ["date"]).collect()}
    want = {key(r): r["quantity"] for r in lots.matches(t, ["date"]).where("kind = 'open' and symbol is not null").collect() if r["quantity"] > 1e-7}
    assert {k for k, v in got.items() if v > 1e-7} == set(want) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_average_cost_of_a_hot_symbol(spark):
    t = transactions(spark, seed=9).where("quantity is not null")
    got = {r["symbol"]: r for r in portfolio.long_holding_state(t, ["date"], rows_a_range=100).collect()}
    want = {r["symbol"]: r for r in portfolio.holding_state(t, ["date"]).collect()}
    assert set(got) == set(want) == {"hot", "a", "b", None}
    for k, r in want.items():
        assert got[k]["quantity"] == pytest.approx(r["quantity"], abs=1e-6) and got[k]["avg_price"] == pytest.approx(r["avg_price"], rel=1e-7, abs=1e-7)


def shuffles(df):
    """Of the plan without what is written or reused."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_symbols_of_few_rows_are_shuffled_once(spark):
    """Lots and average costs of symbols that a task can take whole: rows are clustered once, whatever follows."""
    t = transactions(spark, rows=200)
    assert shuffles(lots.fifo_gains(t, ["date"])) == shuffles(lots.fifo_open(t, ["date"])) == shuffles(portfolio.long_holding_state(t, ["date"])) == 1


def test_lots_and_sales_that_end_together(spark):
    """Equal ends, sales of nothing held, lots below the eighth place, and what is sold before it is bought."""
    rows = [("s", "sell", 5.0), ("s", "buy", 1.0), ("s", "buy", 2.0), ("s", "sell", 1.0), ("s", "buy", 1e-9), ("s", "sell", 2.0), ("s", "sell", 4.0), ("s", "buy", 3.0), ("s", "buy", 1.0), ("s", "sell", 3.5)]
    t = spark.createDataFrame([(s, k, q, 10.0 + i, 0.5, i) for i, (s, k, q) in enumerate(rows)], TX)
    want = [(2, 4, 1.0), (3, 6, 2.0), (8, 10, 3.0), (9, 10, 0.5)]
    for a_range in (3, 1000):
        found = lots.fifo_gains(t, ["date"], rows_a_range=a_range).orderBy("buy_seq", "sell_seq").collect()
        assert [(r["buy_seq"], r["sell_seq"], r["quantity"]) for r in found] == want
        assert [(r["buy_seq"], r["remaining"]) for r in lots.fifo_open(t, ["date"], rows_a_range=a_range).collect()] == [(9, 0.5)]
    assert found[0]["proceeds"] == 13.0 - 0.5 and found[1]["cost_basis"] == 2 * 12.0 + 0.5 and found[3]["proceeds"] == pytest.approx(0.5 * 19.0 - 0.5 / 3.5 * 0.5)


def series(spark, n=4000):
    rng, price, rows = random.Random(2), 100.0, []
    for i in range(n):
        price = max(1.0, price + rng.uniform(-1, 1) * (0 if 500 < i < 560 else 1))
        rows.append(("long", "1m", i * 60_000, price, price + rng.random(), price - rng.random(), price, 5.0))
    rows += [("short", "1m", i, 5.0, 6.0, 4.0, 5.0, 1.0) for i in range(9)] + [(None, "1m", i, 5.0, 6.0, 4.0, 5.0 + i, 1.0) for i in range(40)] + [("long", "1m", -1, None, None, None, None, None)]
    return spark.createDataFrame(rows, "symbol string, interval string, ts long, open double, high double, low double, close double, volume double")


def test_means_of_one_long_series(spark):
    bars = series(spark)
    assert ranges.ranged(bars, ["symbol", "interval"], ["ts"], 200).where("symbol = 'long'").select("part").distinct().count() > 10
    columns = ["ema_fast", "ema_slow", "rsi", "macd", "macd_signal", "macd_histogram", "atr"]
    row = lambda r: (r["symbol"], r["ts"])
    got = {row(r): r for r in kernels.long_means(bars, rows_a_range=200).collect()}
    want = {row(r): r for r in kernels.recursive(bars).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        for c in columns:
            assert (got[k][c] is None) == (r[c] is None) and (r[c] is None or got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9)), (k, c)
    assert kernels.long_means(bars.limit(0)).count() == 0


def test_affine_maps_of_any_kind(spark):
    """Also those that forget everything, and nulls, which change nothing."""
    rng = random.Random(1)
    rows = [(k, i, rng.choice([0.0, 1.0, -0.5, None]), rng.choice([0.0, 2.0, None, -1.0])) for k in (1, None) for i in range(300)]
    df = ranges.ranged(spark.createDataFrame(rows, "k int, i int, a double, b double"), ["k"], ["i"], 20)
    got = {(r["k"], r["i"]): r["y"] for r in ranges.affine(df, ["k"], ["i"], {"y": (F.col("a"), F.col("b"))}).collect()}
    last = {}
    for k, i, a, b in rows:
        last[k] = (1.0 if a is None else a) * last.get(k, 0.0) + (b or 0.0)
        assert got[k, i] == pytest.approx(last[k], abs=1e-9)
    ends = {r["k"]: r["y"] for r in ranges.affine_end(df, ["k"], ["i"], {"y": (F.col("a"), F.col("b"))}).collect()}
    assert ends == pytest.approx(last, abs=1e-9)

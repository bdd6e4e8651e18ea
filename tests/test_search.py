"""Searches over arrays of candidates against one backtest per candidate; joins by weights."""

import random

import pytest
from pyspark.sql import functions as F

from barquet.config import CATEGORIES, DEFAULT_WEIGHTS, Backtest
from barquet.operators import backtest, optimize, search


def scored_bars(spark, lengths, seed=3):
    rng, rows = random.Random(seed), []
    for symbol, bars in lengths.items():
        price = 100.0
        for n in range(50, 50 + bars):
            price *= 1 + rng.uniform(-0.03, 0.03)
            rows.append((symbol, "1h", n, n * 1000, price, price * (1 + rng.random() / 20), price * (1 - rng.random() / 20), price, *[rng.uniform(-90, 90) for _ in range(4)]))
    return spark.createDataFrame(rows, "symbol string, interval string, n int, ts long, open double, high double, low double, close double, " + ", ".join(f"score_{c} double" for c in CATEGORIES[:4]))


RULES = [
    Backtest(entry=15, exit=0, short_entry=-15, short_exit=0, allow_shorts=True), Backtest(entry=5, exit=-5, stop_loss=0.02, take_profit=0.03), Backtest(entry=10, exit=0, sizing="kelly", allow_shorts=True, short_entry=-10, short_exit=5),
    Backtest(entry=10, exit=0, sizing="risk_based", allow_shorts=True, short_entry=-10, short_exit=5), Backtest(entry=1000),
]
SHAPE = {"count": 4, "train": 60, "test": 25, "step": 30}


@pytest.mark.parametrize("rules", RULES, ids=range(len(RULES)))
def test_training_is_one_backtest_per_candidate(spark, rules):
    bars = scored_bars(spark, {"long": 260, "one": 85, "short": 84, "odd": 120})
    found = optimize.training(bars, DEFAULT_WEIGHTS, rules, **SHAPE, windows_a_task=2).collect()
    got = {(r["symbol"], r["window"], r["place"]): r for r in found}
    windows = {"long": 6, "one": 1, "odd": 2}
    assert set(got) == {(s, w, p) for s, n in windows.items() for w in range(n) for p in range(4)}
    for w in range(6):
        weights = optimize.candidates(DEFAULT_WEIGHTS, 4, seed=42 + w)
        part = bars.where(f"n < 50 + 60 + 30 * {w}")
        e = backtest.run_all(part, optimize.as_runs(spark, weights), rules).cache()
        for r in backtest.metrics(backtest.trades(e), backtest.equity(e), rules.start_equity).collect():
            if (k := (r["symbol"], w, int(r["run_id"][1:]))) in got:
                for c in search.FIGURES:
                    assert got[k][c] == pytest.approx(r[c], rel=1e-7, abs=1e-9), (k, c)
                assert [got[k][c] for c in CATEGORIES] == [weights[k[2]][c] for c in CATEGORIES]


def test_walk_forward(spark):
    rules, loose = RULES[0], {"min_sharpe": -1e9, "min_win_rate": 0.0, "max_drawdown": 1.0, "min_trades": 1}
    bars = scored_bars(spark, {"a": 200, "b": 130}).cache()
    found = {(r["symbol"], r["window"]): r for r in optimize.walk_forward(bars, DEFAULT_WEIGHTS, rules, **SHAPE, limits=loose).collect()}
    train = optimize.training(bars, DEFAULT_WEIGHTS, rules, **SHAPE).collect()
    assert set(found) == {("a", w) for w in range(4)} | {("b", w) for w in range(2)}
    for (symbol, window), r in found.items():
        own = [x for x in train if (x["symbol"], x["window"]) == (symbol, window) and x["total_trades"] >= 1]
        best = max(own, key=lambda x: (x["sharpe_ratio"], -x["place"]))
        assert r["candidate"] == best["place"] and r["train_sharpe"] == best["sharpe_ratio"]
        first = 50 + 60 + 30 * window
        weights = optimize.candidates(DEFAULT_WEIGHTS, 4, seed=42 + window)[r["candidate"]]
        e = backtest.run_all(bars.where(f"symbol = '{symbol}' and n >= {first} and n < {first + 25}"), optimize.as_runs(spark, [weights]), rules)
        want = backtest.metrics(backtest.trades(e), backtest.equity(e)).first()
        assert all(r[c] == pytest.approx(want[c]) for c in ("sharpe_ratio", "sortino_ratio", "win_rate", "total_trades", "total_pnl"))
    assert optimize.walk_forward(bars, DEFAULT_WEIGHTS, rules, **SHAPE, limits=loose | {"min_sharpe": 1e9}).count() == 0
    assert optimize.walk_forward(bars.limit(0), DEFAULT_WEIGHTS, rules).count() == 0


def test_same_weights(spark):
    """Rounded weights meet, -0.0 is 0.0, null and NaN equal themselves, equal weights of two windows are told apart by the window."""
    nan = float("nan")
    sets = [(0.1 + 0.2, 0.0, 1.0), (0.3, -0.0, 1.0), (nan, 0.0, 1.0), (None, 0.0, 1.0), (0.3, 0.0, 1.0 + 1e-9)]
    rows = [(i, w, *x, 0.0, 0.0, 0.0) for i, (w, x) in enumerate((w, x) for w in (0, 1) for x in sets)]
    df = spark.createDataFrame(rows, "id int, window int, " + ", ".join(f"{c} double" for c in CATEGORIES))
    pairs = {(r["id"], r["id_right"]) for r in optimize.same_weights(df, df, ["window"]).collect()}
    assert pairs == {(i, i) for i in range(10)} | {(0, 1), (1, 0), (5, 6), (6, 5)}
    across = {(r["id"], r["id_right"]) for r in optimize.same_weights(df, df.where("window = 0")).where(F.col("id") > 4).collect()}
    assert across == {(5, 0), (5, 1), (6, 0), (6, 1), (7, 2), (8, 3), (9, 4)}


def test_many_rows_with_the_same_weights_are_dealt(spark):
    """Of two groups of equal weights no task makes all pairs; null keys, copies and rows without a partner are as in one piece."""
    rows = [(i if i % 7 else None, i % 3, *[float(i % 2)] * len(CATEGORIES)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, window int, " + ", ".join(f"{c} double" for c in CATEGORIES))
    some = df.where("window = 1")
    joined = optimize.same_weights(df, some, pairs_a_task=1000).cache()
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert joined.count() == 600 * 100 and max(sizes) < 15_000 and len(sizes) > 20  # 30,000 pairs each in one piece
    pairs = lambda d: sorted(((r["id"] or 0, r["id_right"] or 0) for r in d.collect()))
    assert pairs(joined) == sorted((a[0] or 0, b[0] or 0) for a in rows for b in rows if b[1] == 1 and a[2] == b[2])
    assert pairs(optimize.same_weights(df, some, ["window"], pairs_a_task=100)) == sorted((a[0] or 0, b[0] or 0) for a in rows for b in rows if a[1] == b[1] == 1 and a[2] == b[2])

"""Lots, risk, backtests, optimisation, alerts, limits, news, export, streams."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from barquet.config import DEFAULT_WEIGHTS, Backtest
from barquet.functions import scalars
from barquet.operators import alerts, backtest, export, joins, limiter, lots, news, optimize, portfolio
from barquet.sources import sinks
from barquet.streaming import jobs

DAY = 86_400_000
TX = "symbol string, type string, quantity double, price double, fee double, date long, seq long"
ORDER = ["date", "seq"]


def tx(spark, *rows):
    return spark.createDataFrame([("A", t, float(q), float(p), f, d * DAY, i) for i, (t, q, p, f, d) in enumerate(rows)], TX)


def test_full_sale(spark):
    t = tx(spark, ("buy", 1, 40_000, None, 0), ("sell", 1, 65_000, None, 5))
    for gains in (lots.fifo_gains(t, ORDER), lots.matches(t, ORDER, "lifo").where("kind = 'gain'")):
        assert [(r["gain"], r["holding_period"]) for r in gains.collect()] == [(25_000, "short-term")]


def test_partial_sale(spark):
    t = tx(spark, ("buy", 1, 40_000, None, 0), ("sell", 0.3, 60_000, None, 5))
    assert lots.fifo_gains(t, ORDER).first()["gain"] == pytest.approx(6000)
    assert lots.fifo_open(t, ORDER).first()["remaining"] == pytest.approx(0.7)
    roll = lots.rollup(lots.matches(t, ORDER)).first()
    assert roll["total_cost"] == pytest.approx(28_000) and roll["average_cost"] == pytest.approx(40_000)


@pytest.mark.parametrize(("days", "term"), [(365, "short-term"), (366, "long-term")])
def test_term(spark, days, term):
    t = tx(spark, ("buy", 1, 1, None, 0), ("sell", 1, 2, None, days))
    assert lots.fifo_gains(t, ORDER).first()["holding_period"] == term == lots.matches(t, ORDER).first()["holding_period"]


def test_oversold(spark):
    """What is sold beyond the lots is dropped, and later purchases stay open."""
    t = tx(spark, ("buy", 1, 10, None, 0), ("sell", 3, 20, None, 1), ("buy", 2, 30, None, 2), ("sell", 1, 40, None, 3))
    assert sorted(r["gain"] for r in lots.fifo_gains(t, ORDER).collect()) == [10, 10]
    assert [(r["buy_seq"], r["remaining"]) for r in lots.fifo_open(t, ORDER).collect()] == [(3, 1)]


def test_hifo_takes_the_earliest_of_equal_prices(spark):
    t = tx(spark, ("buy", 1, 10, None, 0), ("buy", 1, 30, None, 1), ("buy", 1, 30, None, 2), ("sell", 1, 40, None, 3))
    assert lots.matches(t, ORDER, "hifo").where("kind = 'gain'").first()["buy_seq"] == 2


def test_fees(spark):
    t = tx(spark, ("buy", 2, 10, 4.0, 0), ("sell", 1, 20, 3.0, 1))
    g = lots.fifo_gains(t, ORDER).first()
    assert (g["cost_basis"], g["proceeds"]) == (12, 17)


def test_set_based_fifo_is_the_scan(spark):
    rng = random.Random(9)
    rows = [(f"S{rng.randrange(4)}", rng.choice(["buy", "buy", "sell"]), float(rng.choice([0, 1, 2, 50, 400])), float(rng.randrange(1, 99)), 0.5, rng.randrange(900) * DAY, i) for i in range(400)]
    t = spark.createDataFrame(rows, TX)
    keys = ["symbol", "buy_seq", "sell_seq", "quantity", "cost_basis", "holding_period"]
    a, b = lots.fifo_gains(t, ORDER).select(keys), lots.matches(t, ORDER).where("kind = 'gain'").select(keys)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_holding_state(spark):
    state = lambda *rows: tuple(portfolio.holding_state(tx(spark, *rows), ["seq"]).first())[1:]
    assert state(("buy", 1, 40_000, None, 0), ("buy", 1, 50_000, None, 1)) == (2, 45_000)
    assert state(("buy", 1, 40_000, 100.0, 0), ("sell", 0.5, 1, None, 1)) == (0.5, 40_100)
    assert state(("buy", 1, 40_000, None, 0), ("sell", 1, 1, None, 1)) == (0, 0)


def values(spark, *xs):
    return spark.createDataFrame([("P", i * DAY, float(x)) for i, x in enumerate(xs)], "portfolio string, day long, total_value double")


def test_risk(spark):
    r = portfolio.risk(values(spark, 100, 110, 120, 115, 90, 95, 100)).first()
    assert r["max_drawdown"] == -0.25 and r["max_drawdown_day"] == 4 * DAY and r["sharpe"] is None
    assert portfolio.risk(values(spark, 100)).count() == 0 and portfolio.risk(values(spark, 0, 5)).count() == 0
    assert portfolio.risk(values(spark, 100, 110)).first()["annualized_volatility"] is None
    assert portfolio.risk(values(spark, 1, 2, 3, 4, 5, 6)).first()["max_drawdown"] is None
    assert portfolio.risk(values(spark, *[100 + i % 3 for i in range(40)])).first()["sortino"] is not None


BAR = "run_id string, symbol string, interval string, n int, ts long, high double, low double, close double, score double, tier string"


def run(spark, bars, **rules):
    rows = [("r", "A", "1h", i, i * 1000, float(h), float(low), float(c), float(s), "buy") for i, (h, low, c, s) in enumerate(bars, 1)]
    e = backtest.run(spark.createDataFrame(rows, BAR), Backtest(**rules))
    return backtest.trades(e).orderBy("exit_bar").collect(), backtest.equity(e).orderBy("bar").collect(), e


def test_stop_comes_before_target_and_the_bar_may_enter_anew(spark):
    trades, curve, _ = run(spark, [(100, 100, 100, 50), (120, 90, 100, 50), (100, 100, 100, 0)])
    assert [(t["exit_reason"], t["exit_price"], t["entry_bar"]) for t in trades] == [("stop_loss", 95.0, 1), ("end_of_data", 100.0, 2)]
    assert curve[-1]["equity"] == pytest.approx(10_000 + sum(t["pnl"] for t in trades))


def test_signal_exit_does_not_enter_on_its_bar(spark):
    trades, _, _ = run(spark, [(100, 100, 100, 50), (101, 99, 100, -50), (101, 99, 100, -50)], allow_shorts=True)
    assert [(t["side"], t["exit_reason"], t["entry_bar"], t["exit_bar"]) for t in trades] == [("long", "signal", 1, 2), ("short", "end_of_data", 3, 3)]


def test_fees_and_percent(spark):
    trades, _, _ = run(spark, [(100, 100, 100, 50), (111, 100, 110, 0)])
    t = trades[0]
    assert (t["exit_reason"], t["quantity"]) == ("take_profit", 10.0) and t["pnl"] == pytest.approx(100 - 2.1) and t["pnl_percent"] == pytest.approx(9.79)


def test_no_trades(spark):
    _, curve, e = run(spark, [(100, 100, 100, 0)] * 3)
    m = backtest.metrics(backtest.trades(e), backtest.equity(e)).first()
    assert len(curve) == 3 and m["total_trades"] == 0 and m["sharpe_ratio"] == 0 and m["profit_factor"] == 0 and m["max_wins"] == 0


def test_only_wins(spark):
    _, _, e = run(spark, [(100, 100, 100, 50), (111, 100, 110, 0), (111, 110, 110, 0)])
    m = backtest.metrics(backtest.trades(e), backtest.equity(e)).first()
    assert m["profit_factor"] == float("inf") and m["sortino_ratio"] == float("inf") and m["win_rate"] == 1


def test_sizing():
    assert backtest.fixed_fractional(10_000, 0.01, 100, 95) == 20 and backtest.fixed_fractional(10_000, 0.01, 100, 100) == 0
    assert backtest.kelly(10_000, 0.6, 200, -100, 100, 0.5) == pytest.approx(20) and backtest.kelly(10_000, 0, 0, -1, 100) == 0


def test_windows(spark):
    one = spark.createDataFrame([("A", 1000), ("B", 600), ("C", 599)], "symbol string, bars long")
    w = optimize.windows(one, 500, 100, 100).where("symbol = 'A'").orderBy("window").collect()
    assert [(r["train_end"], r["test_start"], r["test_end"]) for r in w] == [(499 + i * 100, 500 + i * 100, 599 + i * 100) for i in range(5)]
    assert optimize.windows(one, 500, 100, 100).groupBy("symbol").count().count() == 2


def test_candidates():
    c = optimize.candidates(DEFAULT_WEIGHTS, 50)
    assert c[0] == DEFAULT_WEIGHTS and len(c) == 50 and all(abs(sum(w.values()) - 1) < 1e-10 for w in c) and c == optimize.candidates(DEFAULT_WEIGHTS, 50)


def test_sampled(spark):
    curve = spark.createDataFrame([("A", i) for i in range(1001)] + [("B", i) for i in range(150)], "k string, t int")
    got = backtest.sampled(curve, ["k"], "t")
    want = {int(i * (1001 / 200)) for i in range(200)} | {1000}
    assert {r["t"] for r in got.where("k = 'A'").collect()} == want and got.where("k = 'B'").count() == 150


def test_limiter(spark):
    asked = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 10, 20, 99, 100, 101, 130])], "key long, ts long, seq long")
    got = [(r["success"], r["remaining"], r["reset"]) for r in limiter.limit(asked, 2, 100).orderBy("seq").collect()]
    assert got == [(True, 1, 100), (True, 0, 110), (False, 0, 100), (False, 0, 100), (True, 0, 200), (False, 0, 110), (True, 0, 230)]


def test_alert_cooldown(spark):
    schema = "alert_id int, type string, symbol string, portfolio int, target double, reference double, percent double, status string, recurring boolean, cooldown_minutes int, last_triggered_at long"
    base = ("price_above", "A", None, 10.0, None, None, "active")
    rows = [(1, *base, True, 1, 940_000), (2, *base, True, 1, 940_001), (3, *base, False, 1, 999_999), (4, *base, True, 1, None), (5, "price_change_pct", "A", None, None, None, 1.0, "active", False, 0, None)]
    a, prices = spark.createDataFrame(rows, schema), spark.createDataFrame([("A", 10.0)], "symbol string, price double")
    fired = alerts.price_alerts(a, prices, 1_000_000)
    assert {r["alert_id"] for r in fired.collect()} == {1, 3, 4}
    state = {r["alert_id"]: r for r in alerts.after(a, fired, 1_000_000).collect()}
    assert state[1]["status"] == "active" and state[1]["last_triggered_at"] == 1_000_000 and state[3]["status"] == "triggered" and state[2]["triggered_at"] is None


def test_tolerance_join(spark):
    left = spark.createDataFrame([("A", t) for t in (0, 100, 250, 1000)], "k string, ts long")
    right = spark.createDataFrame([("A", 99, 3), ("A", 101, 1), ("A", 349, 2), ("B", 0, 0)], "k string, ts long, i int")
    got = {r["ts"]: r["match"] and r["match"]["i"] for r in joins.within(left, right, ["k"], 100, ["i"]).collect()}
    assert got == {0: 3, 100: 1, 250: 2, 1000: None}


def test_news(spark):
    rows = spark.createDataFrame([("BTC rally and surge",), ("Exchange hack",), (None,), ("urban",)], "title string")
    got = rows.select(news.sentiment(F.col("title")).alias("s"), news.topics(F.col("title")).alias("t")).collect()
    assert [(r["s"], r["t"]) for r in got] == [(0.6, []), (-0.3, ["security"]), (0.0, []), (-0.3, ["regulation"])]


def test_text(spark):
    row = spark.range(1).select(
        scalars.quantity_text(F.lit(0.5)).alias("a"), scalars.quantity_text(F.lit(2.0)).alias("b"), scalars.price_text(F.lit(1234.5)).alias("c"), scalars.magnitude_text(F.lit(2.5e6)).alias("d"), scalars.csv_escape(F.lit('a,"b')).alias("e"),
        scalars.strip_quote(F.lit("BTCUSDT")).alias("f"), scalars.first_number(F.lit("RSI: -12.5 now 3")).alias("g"), scalars.utc_time(F.lit(1_700_000_000_123)).alias("h"), scalars.number(F.lit("x")).alias("i"), scalars.ratio_text(F.lit(float("inf"))).alias("j"),
        scalars.first_number(F.lit("none")).alias("k"),
    ).first()
    assert tuple(row) == ("0.50000000", "2.0000", "1234.50", "2.50M", '"a,""b"', "BTC", -12.5, "2023-11-14 22:13:20 UTC", None, "inf", None)


def test_tax_csv(spark, tmp_path):
    t = tx(spark, ("buy", 2, 10, 1.0, 0), ("sell", 1, 20, None, 400)).withColumn("symbol", F.lit("AUSDT")).withColumn("seq", F.struct("seq"))
    rows = export.tax_rows(t, lots.fifo_gains(t, ORDER))
    text = {d: [r["line"] for r in export.tax_csv(rows, d).orderBy("body", "date").collect()] for d in export.HEADERS}
    assert text["generic"][1:] == ["1970-01-01,Buy,A,2.0000,10.00,1.00,,,,", "1971-02-05,Sell,A,1.0000,20.00,0.00,20.00,10.50,9.50,Long-term"]
    assert text["koinly"][1:] == ["1970-01-01 00:00:00 UTC,21.00,USD,2.0000,A,1.00,USD,", "1971-02-05 00:00:00 UTC,1.0000,A,20.00,USD,,,"]
    assert text["cointracker"][1:] == ["1970-01-01,Buy,2.0000,A,20.00,USD,1.00,USD", "1971-02-05,Sell,20.00,USD,1.0000,A,,"]
    assert export.tax_rows(t, lots.fifo_gains(t, ORDER), 1971).count() == 1
    sinks.write_lines(export.tax_csv(rows), str(tmp_path / "csv"), ["body", "date"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()].count(export.HEADERS["generic"]) == 1


def test_closed_bars_come_once(spark, tmp_path):
    """In append mode a bar waits for the watermark; in the end all but the last ones are there."""
    rows = [("A", t, i, float(i)) for i, t in enumerate(range(0, 3_600, 20))]
    spark.createDataFrame(rows, "symbol string, s long, event_id long, price double").select("symbol", F.timestamp_seconds("s").alias("ts"), "event_id", "price").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, event_id long, price double").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.run_available(jobs.bars(stream, "1m", "10 minutes"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert got.count() == got.select("ts").distinct().count() == 49 and {r["volume"] for r in got.collect()} == {3.0}


def test_malformed_messages(spark):
    rows = spark.createDataFrame([('{"s": "A", "c": "1.5", "E": 5}',), ("{",), ('{"s": "B", "c": "x"}',), (None,)], "value string")
    assert [(r["symbol"], r["price"]) for r in jobs.parse_tickers(rows).collect()] == [("A", 1.5)]


def test_once_per_day_state_ends(spark, tmp_path):
    day = 86_400
    rows = lambda *at: spark.createDataFrame([("a", x) for x in at], "symbol string, s long").select("symbol", F.timestamp_seconds("s").alias("ts"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("symbol string, ts timestamp").parquet(str(tmp_path / "in"))
    held = []
    for i in range(4):
        rows(10 * i * day, 10 * i * day + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.once_per_day(stream, ["symbol"]).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination()
        held.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert held[-1] <= 1
    assert sorted(r.day.toordinal() for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [719163 + 10 * i for i in range(4)]


def test_upsert_to_last_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    write = jobs.upsert_to(path, ["k"], "seq")
    for i, rows in enumerate([[(1, 2, "b"), (1, 1, "a"), (2, 1, "x")], [(1, 4, "d"), (1, 3, "c")], [(3, 5, "z")]]):
        for _ in range(2):  # a repeated batch changes nothing
            write(spark.createDataFrame(rows, "k int, seq int, v string"), i)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v=1", "v=2"]
    assert sorted(map(tuple, spark.read.parquet(f"{path}/v=2").collect())) == [(1, 4, "d"), (2, 1, "x"), (3, 5, "z")]


def test_restarting(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    waits, failing = [], [2]

    def each(batch, i):
        if failing[0]:
            failing[0] -= 1
            raise ValueError("lost")

    def start():
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    assert jobs.restarting(start, sleep=waits.append) == 2 and waits == [3.0, 6.0]
    failing[0] = 9
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        jobs.restarting(start, most=1, sleep=waits.append)
    assert waits == [3.0, 6.0, 3.0]


def test_single_flight(spark, tmp_path):
    marker = str(tmp_path / "running")
    inner = lambda: jobs.single_flight(spark, marker, lambda: 1)
    assert jobs.single_flight(spark, marker, lambda: (inner(), 2)) == (None, 2)
    with pytest.raises(ZeroDivisionError):
        jobs.single_flight(spark, marker, lambda: 1 / 0)
    assert inner() == 1

"""Joins, alerts, news, limits, backtests, optimisation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.config import CATEGORIES, DEFAULT_WEIGHTS, STYLES, Backtest, Indicators
from barquet.functions import interpret, scalars, score
from barquet.operators import alerts, backtest, bars, joins, kernels, limiter, news, optimize
from barquet.plans.kernel_sql import score_cte, with_suite
from barquet.sources import readers, sinks
from barquet.sources import tables as t
from barquet.streaming import jobs

QUERIES, SQL = {}, {}
HOUR = 3_600_000


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


# Joins of series: hourly bars of a symbol with events of others.


def _series(s, d, kind, value):
    e = t.read(s, d, "events").where(F.col("event_type") == kind)
    return e.select(F.lit("ALL").alias("symbol"), t.epoch_ms("ts").alias("ts"), "event_id", (F.col("value") / 100_000).alias(value))


SER = lambda kind, value: f"(SELECT 'ALL' AS symbol, (epoch_us(ts) // 1000) AS ts, event_id, value / CAST(100000 AS DOUBLE) AS {value} FROM events WHERE event_type = '{kind}')"
POOL = f"({t.candles_sql('1h', True)})"


def _tolerance(s, d):
    base = t.candles(s, d, "1h", True).select("symbol", "ts", "close")
    return joins.within(base, _series(s, d, "error", "rate"), ["symbol"], HOUR, ["event_id"]).select("symbol", "ts", "close", F.col("match.event_id").cast("double").alias("event_id"), F.col("match.rate").alias("rate"))


add(
    "funding_tolerance_join",
    _tolerance,
    f"""WITH b AS (SELECT symbol, ts, close FROM {POOL}), m AS (SELECT b.symbol, b.ts, f.event_id, f.rate, row_number() OVER (PARTITION BY b.ts ORDER BY f.event_id) AS r FROM b JOIN {SER("error", "rate")} f ON f.ts > b.ts - {HOUR} AND f.ts < b.ts + {HOUR})
SELECT b.symbol, b.ts, close, CAST(event_id AS DOUBLE) AS event_id, rate FROM b LEFT JOIN (SELECT * FROM m WHERE r = 1) m USING (ts)""",
)


def _merge(s, d):
    base = t.candles(s, d, "1h", True).select("symbol", "ts", "close")
    one = lambda kind, c: t.candles(s, d).where(F.col("symbol") == kind).select(F.lit("ALL").alias("symbol"), "ts", F.col(c).alias("v"))
    return joins.merged(base, ["symbol", "ts"], ratio=one("click", "high"), interest=one("view", "volume")).select("symbol", "ts", "close", F.col("ratio.v").alias("ratio"), F.col("interest.v").alias("interest"))


add("snapshot_merge", _merge, f"WITH c AS ({t.candles_sql()}) SELECT 'ALL' AS symbol, b.ts, b.close, r.high AS ratio, i.volume AS interest FROM {POOL} b LEFT JOIN (SELECT * FROM c WHERE symbol = 'click') r USING (ts) LEFT JOIN (SELECT * FROM c WHERE symbol = 'view') i USING (ts)")
INTERVALS = {k: v.intervals for k, v in STYLES.items()}
PAIRS = ", ".join(f"('{s}', '{i}', {n})" for n, (s, i) in enumerate((s, i) for s, xs in INTERVALS.items() for i in xs))
SYMBOLS = "(SELECT DISTINCT event_type AS symbol FROM events)"


def _symbols(s, d):
    return t.read(s, d, "events").select(F.col("event_type").alias("symbol")).distinct()


add("task_cross_product", lambda s, d: joins.tasks(_symbols(s, d), INTERVALS, 30), f"SELECT symbol, style, interval FROM {SYMBOLS} CROSS JOIN (VALUES {PAIRS}) p(style, interval, n) ORDER BY symbol, n LIMIT 30")
add("task_weights", lambda s, d: joins.weights_of(joins.tasks(_symbols(s, d), INTERVALS), optimize.as_runs(s, [STYLES["scalping"].weights]).select(F.lit("scalping").alias("style"), F.lit(True).alias("active"), *CATEGORIES), DEFAULT_WEIGHTS), f"SELECT symbol, style, interval, {', '.join(f'CASE WHEN style = {chr(39)}scalping{chr(39)} THEN CAST({STYLES["scalping"].weights[c]} AS DOUBLE) ELSE CAST({DEFAULT_WEIGHTS[c]} AS DOUBLE) END AS {c}' for c in CATEGORIES)} FROM {SYMBOLS} CROSS JOIN (VALUES {PAIRS}) p(style, interval, n)")


def _unchanged(s, d):
    now = bars.extent(t.candles(s, d)).select("symbol", "interval", F.col("newest").alias("ts"))
    done = now.withColumn("ts", F.when(F.col("symbol") < "e", F.col("ts")).otherwise(F.col("ts") - HOUR))
    return joins.unchanged_out(now, done, ["symbol", "interval", "ts"])


add("unchanged_anti_join", _unchanged, f"SELECT symbol, interval, max(ts) AS ts FROM ({t.candles_sql()}) GROUP BY 1, 2 HAVING symbol >= 'e'")
add("latest_signal_per_style", lambda s, d: joins.newest(t.journal(s, d).select("setup_type", "signal_tier", "created_at", "entry_id"), ["setup_type", "signal_tier"], "created_at", "entry_id"), f"SELECT setup_type, signal_tier, created_at, entry_id FROM ({t.JOURNAL_SQL}) QUALIFY row_number() OVER (PARTITION BY setup_type, signal_tier ORDER BY created_at DESC, entry_id DESC) = 1")
add("latest_n_per_key", lambda s, d: joins.ranked_first(t.journal(s, d).select("user_id", "created_at", "entry_id"), ["user_id"], F.desc("created_at"), "entry_id", n=3), f"SELECT user_id, created_at, entry_id FROM ({t.JOURNAL_SQL}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, entry_id) <= 3")
add("ticker_fallback", lambda s, d: t.holdings(s, d).select("symbol").distinct().join(t.prices(s, d).where("symbol % 2 = 0"), "symbol", "left").join(t.prices(s, d).select("symbol", (F.col("price") * 2).alias("rest")), "symbol", "left").select("symbol", F.coalesce("price", "rest").alias("price")), f"SELECT symbol, CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN price ELSE price * 2 END AS price FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS symbol FROM lineitem) LEFT JOIN ({t.PRICES_SQL}) USING (symbol)")
add("user_fan_out", lambda s, d: joins.fan_out(t.candles(s, d, "1d").select("symbol", "ts", "close"), t.read(s, d, "events").select(F.col("event_type").alias("symbol"), "user_id").distinct(), ["symbol"]).where("ts % 10 = 0"), f"SELECT symbol, user_id, ts, close FROM (SELECT DISTINCT event_type AS symbol, user_id FROM events) JOIN ({t.candles_sql('1d')}) USING (symbol) WHERE ts % 10 = 0")
add("symbol_union", lambda s, d: joins.union_distinct(_symbols(s, d), t.prices(s, d).select("symbol"), t.holdings(s, d).select("symbol")), f"SELECT symbol FROM {SYMBOLS} UNION SELECT symbol FROM ({t.PRICES_SQL}) UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem")
add("composite_key_in", lambda s, d: joins.in_list(t.candles(s, d), t.candles(s, d, "4h").select("symbol", "ts"), ["symbol", "ts"]), f"SELECT * FROM ({t.candles_sql()}) c WHERE (symbol, ts) IN (SELECT symbol, ts FROM ({t.candles_sql('4h')}))")
add("template_comparison", lambda s, d: _template_comparison(s), "SELECT * FROM (VALUES ('scalping', 1e0, 0.5e0, 2, 0.8e0), ('day_trading', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 1, 1.5e0)) t(style, active_version, active_sharpe, new_version, new_sharpe)")
TEMPLATES = [("scalping", 1, True, 0.5, 9), ("scalping", 2, False, 0.8, 9), ("day_trading", 1, False, 1.5, 9), ("swing_trading", 1, True, 1.0, 9), ("swing_trading", 2, False, 1.05, 20), ("position_trading", 1, True, 1.0, 9), ("position_trading", 2, False, 2.0, 3)]


def _templates(s):
    return s.createDataFrame(TEMPLATES, "style string, version int, active boolean, avg_sharpe double, total_backtests int")


def _template_comparison(s):
    x = _templates(s)
    new = x.where("(style, version) in (('scalping', 2), ('day_trading', 1))").select("style", F.col("version").alias("new_version"), F.col("avg_sharpe").alias("new_sharpe"))
    return new.join(x.where("active").select("style", F.col("version").cast("double").alias("active_version"), F.col("avg_sharpe").alias("active_sharpe")), "style", "left")


# Readers and caches.
add("symbols_suffix_filter", lambda s, d: readers.tickers(t.read(s, d, "customer").select(F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "USDT").otherwise("BTC")).alias("symbol"), F.col("c_acctbal").cast("string").alias("quote_volume"))), "SELECT c_name || 'USDT' AS symbol, c_acctbal AS quote_volume FROM customer WHERE c_custkey % 2 = 0")
add("top_symbols_by_volume", lambda s, d: joins.top_by(t.read(s, d, "customer").select(F.concat("c_name", F.lit("USDT")).alias("symbol"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).otherwise(float("nan")).alias("volume")), "volume", 20, "USDT"), "SELECT c_name || 'USDT' AS symbol, c_acctbal AS volume FROM customer WHERE c_custkey % 5 <> 0 ORDER BY volume DESC, symbol LIMIT 20")
add("symbol_catalog", lambda s, d: readers.symbols(t.read(s, d, "customer").select(F.col("c_name").alias("symbol"), F.col("c_name").alias("base_asset"), F.when(F.col("c_nationkey") < 12, "USDT").otherwise("BTC").alias("quote_asset"), F.when(F.col("c_custkey") % 3 == 0, "BREAK").otherwise("TRADING").alias("status"))), "SELECT c_name AS symbol, c_name AS base_asset, 'USDT' AS quote_asset FROM customer WHERE c_nationkey < 12 AND c_custkey % 3 <> 0")
add("kline_parse", lambda s, d: readers.klines(t.candles(s, d).select("symbol", F.array(*[F.col(c).cast("string") for c in ("ts", "open", "high", "low", "close", "volume")]).alias("k")), F.col("symbol"), "1h"), t.candles_sql())
add("futures_parse", lambda s, d: readers.futures(_series(s, d, "error", "rate").select("symbol", F.col("ts").cast("string").alias("time"), F.col("rate").cast("string").alias("rate")), "time", "rate"), f"SELECT symbol, ts, rate FROM {SER('error', 'rate')}")
add("fear_greed_parse", lambda s, d: readers.fear_greed(t.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("timestamp"), F.when(F.col("p_partkey") % 10 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("value"), F.col("p_brand").alias("value_classification"))), "SELECT p_partkey * 1000 AS ts, p_size AS value, p_brand AS label FROM part WHERE p_partkey % 10 <> 0")
add("cache_eviction", lambda s, d: sinks.evicted(t.read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") % 2 == 0, "1d").otherwise("1h").alias("interval"), (F.col("c_custkey") * 20_000).alias("fetched_at")), 30_000_000), "WITH c AS (SELECT c_custkey AS key, CASE WHEN c_nationkey % 2 = 0 THEN '1d' ELSE '1h' END AS interval, c_custkey * 20000 AS fetched_at FROM customer), l AS (SELECT key FROM c WHERE 30000000 - fetched_at < CASE WHEN interval = '1d' THEN 21600000 ELSE 3600000 END ORDER BY fetched_at DESC, key LIMIT 50) SELECT * FROM c WHERE key NOT IN (SELECT key FROM l)")
add("sine_market", lambda s, d: readers.sine_market(s, 500).select("ts"), "SELECT i * 3600000 AS ts FROM range(500) r(i)")
add("price_map", lambda s, d: readers.price_map(t.prices(s, d), ["1", "5", "9"]).select(F.explode("prices").alias("symbol", "price")), f"SELECT * FROM ({t.PRICES_SQL}) WHERE symbol IN ('1', '5', '9')")

# Futures and sentiment components.
FUT = "CASE WHEN r < -0.001 THEN least(90, abs(r) * 10000) WHEN r < -0.0001 THEN 40 WHEN r > 0.001 THEN -least(90, abs(r) * 10000) WHEN r > 0.0001 THEN -40 ELSE 0 END"
LS = "CASE WHEN x > 2 THEN -least(80, (x - 1) * 40) WHEN x > 1.3 THEN -40 WHEN x < 0.5 THEN least(80, (1 / x - 1) * 40) WHEN x < 0.77 THEN 40 ELSE 0 END"


def _futures_component(s, d):
    e = t.read(s, d, "events").select("event_id", ((F.col("value") - 100) / 50_000).alias("r"), F.when(F.col("event_id") % 3 != 0, (F.col("value") + 1) / 64).alias("x"))
    signals = F.array_compact(F.array(interpret.funding(F.col("r")), interpret.long_short(F.col("x"))))
    return e.select("event_id", score.category_score(signals).alias("score"), F.size(signals).alias("signals"))


add("futures_component", _futures_component, f"WITH e AS (SELECT event_id, (value - 100) / CAST(50000 AS DOUBLE) AS r, CASE WHEN event_id % 3 <> 0 THEN (value + 1) / CAST(64 AS DOUBLE) END AS x FROM events) SELECT event_id, CASE WHEN x IS NULL THEN CAST({FUT} AS DOUBLE) ELSE (CAST({FUT} AS DOUBLE) + CAST({LS} AS DOUBLE)) / 2 END AS score, CASE WHEN x IS NULL THEN 1 ELSE 2 END AS signals FROM e")


def _sentiment_component(s, d):
    p = t.read(s, d, "part").select("p_partkey", (F.col("p_size") * 2).alias("fg"))
    g = interpret.fear_greed(F.col("fg"))
    return p.select("p_partkey", "fg", (score.multiplier(g["direction"]) * g["strength"] + 0.0).alias("score"))


add("sentiment_component", _sentiment_component, "SELECT p_partkey, p_size * 2 AS fg, CAST(CASE WHEN p_size * 2 <= 10 THEN 80 WHEN p_size * 2 <= 25 THEN 60 WHEN p_size * 2 >= 90 THEN -80 WHEN p_size * 2 >= 75 THEN -60 WHEN p_size * 2 >= 60 THEN -20 WHEN p_size * 2 <= 40 THEN 20 ELSE 0 END AS DOUBLE) AS score FROM part")
add("confidence", lambda s, d: t.read(s, d, "part").select("p_partkey", score.confidence(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0, DEFAULT_WEIGHTS).alias("confidence")), "SELECT p_partkey, CAST(100 - CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 15 END - CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 10 END AS INTEGER) AS confidence FROM part")

# Alerts, at a fixed time.
NOW = 900_000_000_000
KINDS = ["price_above", "price_below", "price_change_pct", "portfolio_value_above", "portfolio_value_below", "holding_change_pct"]


def _alerts(s, d):
    k = F.col("c_custkey")
    return t.read(s, d, "customer").select(
        k.alias("alert_id"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 6 + 1).cast("int")).alias("type"), (k % 2000 + 1).cast("string").alias("symbol"), (k % 100 + 1).alias("portfolio"),
        F.when(k % 6 < 2, 900 + k % 100).when(k % 6 < 5, F.col("c_acctbal") * 3000).cast("double").alias("target"), F.when(k % 5 != 0, (900 + k % 90).cast("double")).alias("reference"), (k % 9).cast("double").alias("percent"),
        F.when(k % 13 == 0, "triggered").otherwise("active").alias("status"), (k % 2 == 0).alias("recurring"), (k % 60).alias("cooldown_minutes"), F.when(k % 4 == 0, NOW - (k % 100) * 60_000).alias("last_triggered_at"),
    )


ALERTS = f"""al AS (SELECT c_custkey AS alert_id, [{", ".join(f"'{x}'" for x in KINDS)}][CAST(c_custkey % 6 + 1 AS INTEGER)] AS type, CAST(c_custkey % 2000 + 1 AS VARCHAR) AS symbol, c_custkey % 100 + 1 AS portfolio,
  CASE WHEN c_custkey % 6 < 2 THEN CAST(900 + c_custkey % 100 AS DOUBLE) WHEN c_custkey % 6 < 5 THEN c_acctbal * 3000 END AS target, CASE WHEN c_custkey % 5 <> 0 THEN CAST(900 + c_custkey % 90 AS DOUBLE) END AS reference, CAST(c_custkey % 9 AS DOUBLE) AS percent,
  CASE WHEN c_custkey % 13 = 0 THEN 'triggered' ELSE 'active' END AS status, c_custkey % 2 = 0 AS recurring, c_custkey % 60 AS cooldown_minutes, CASE WHEN c_custkey % 4 = 0 THEN {NOW} - (c_custkey % 100) * 60000 END AS last_triggered_at FROM customer),
ok AS (SELECT * FROM al WHERE status = 'active' AND NOT (recurring AND coalesce({NOW} - last_triggered_at < cooldown_minutes * 60000, FALSE))), p AS ({t.PRICES_SQL}), h AS ({t.HOLDINGS_SQL}),
pr AS (SELECT alert_id FROM ok JOIN p USING (symbol) WHERE (type = 'price_above' AND price >= target) OR (type = 'price_below' AND price <= target) OR (type = 'price_change_pct' AND abs((price - reference) / reference * 100) >= abs(percent))),
pv AS (SELECT portfolio, coalesce(CAST(sum(CAST(quantity * price AS DECIMAL(28,8))) AS DOUBLE), 0) AS v FROM h LEFT JOIN p USING (symbol) GROUP BY portfolio),
po AS (SELECT alert_id FROM ok JOIN pv USING (portfolio) WHERE (type = 'portfolio_value_above' AND v >= target) OR (type = 'portfolio_value_below' AND v <= target)),
ho AS (SELECT alert_id FROM ok JOIN h USING (portfolio, symbol) JOIN p USING (symbol) WHERE type = 'holding_change_pct' AND avg_price <> 0 AND abs((price - avg_price) / avg_price * 100) >= abs(percent)),
fired AS (SELECT * FROM pr UNION ALL SELECT * FROM po UNION ALL SELECT * FROM ho)"""
_price = lambda s, d: alerts.price_alerts(_alerts(s, d), t.prices(s, d), NOW)
_folio = lambda s, d: alerts.portfolio_alerts(_alerts(s, d), t.holdings(s, d), t.prices(s, d), NOW)
_hold = lambda s, d: alerts.holding_alerts(_alerts(s, d), t.holdings(s, d), t.prices(s, d), NOW)
add("alerts_price", lambda s, d: _price(s, d).select("alert_id", "type"), f"WITH {ALERTS} SELECT alert_id, type FROM al JOIN pr USING (alert_id)")
add("alerts_portfolio", lambda s, d: _folio(s, d).select("alert_id", "type"), f"WITH {ALERTS} SELECT alert_id, type FROM al JOIN po USING (alert_id)")
add("alerts_holding", lambda s, d: _hold(s, d).select("alert_id", "type"), f"WITH {ALERTS} SELECT alert_id, type FROM al JOIN ho USING (alert_id)")
add("alerts_cooldown", lambda s, d: _alerts(s, d).select("alert_id", alerts.cooling(NOW).alias("cooling")), f"WITH {ALERTS} SELECT alert_id, recurring AND coalesce({NOW} - last_triggered_at < cooldown_minutes * 60000, FALSE) AS cooling FROM al")
add("alerts_state", lambda s, d: alerts.after(_alerts(s, d), _price(s, d).unionByName(_folio(s, d)).unionByName(_hold(s, d)), NOW).select("alert_id", "status", F.col("last_triggered_at").cast("double"), F.col("triggered_at").cast("double")), f"WITH {ALERTS} SELECT alert_id, CASE WHEN f.alert_id IS NOT NULL AND NOT recurring THEN 'triggered' ELSE status END AS status, CAST(CASE WHEN f.alert_id IS NOT NULL AND recurring THEN {NOW} ELSE last_triggered_at END AS DOUBLE) AS last_triggered_at, CAST(CASE WHEN f.alert_id IS NOT NULL THEN {NOW} END AS DOUBLE) AS triggered_at FROM al LEFT JOIN fired f USING (alert_id)")
add("alerts_needed_symbols", lambda s, d: alerts.needed_symbols(_alerts(s, d), t.holdings(s, d)), f"WITH {ALERTS} SELECT symbol FROM al WHERE status = 'active' UNION SELECT symbol FROM h WHERE portfolio IN (SELECT portfolio FROM al WHERE status = 'active')")

# News: headlines from documents and a literal list.
HEADLINES = ["Bitcoin rally continues as ETF approved", "Exchange hack leads to lawsuit", "New DEX yield fund launch", "Urban mining difficulty drops", "Nothing happens", None]
HSQL = "(VALUES " + ", ".join(f"({i}, {'NULL' if h is None else chr(39) + h + chr(39)})" for i, h in enumerate(HEADLINES)) + ") v(i, title)"
KW = lambda words: " + ".join(f"contains(x, '{w}')::INT" for w in words)
NS = f"greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), ({KW(news.BULLISH)} - ({KW(news.BEARISH)})) * 3 / CAST(10 AS DOUBLE)))"


def _headlines(s, d):
    fixed = s.createDataFrame(list(enumerate(HEADLINES)), "i long, title string").select(F.lit("list").alias("source"), "i", "title")
    return fixed.unionByName(t.read(s, d, "documents").select("source", F.col("doc_id").alias("i"), F.col("text").alias("title")))


NEWS = f"n AS (SELECT 'list' AS source, i, title FROM {HSQL} UNION ALL SELECT source, doc_id, text FROM documents), l AS (SELECT *, lower(coalesce(title, '')) AS x FROM n), sc AS (SELECT *, {NS} AS s FROM l)"
add("headline_sentiment", lambda s, d: _headlines(s, d).select("source", "i", news.sentiment(F.col("title")).alias("sentiment"), F.array_join(news.topics(F.col("title")), ",").alias("topics")), f"WITH {NEWS} SELECT source, i, s AS sentiment, array_to_string(list_filter([{', '.join(f'CASE WHEN {KW(w)} > 0 THEN {chr(39)}{k}{chr(39)} END' for k, w in news.TOPICS.items())}], lambda y: y IS NOT NULL), ',') AS topics FROM sc")
add("news_sentiment", lambda s, d: news.summarize(_headlines(s, d), ["source"]).select("source", "count", "avg_sentiment", F.array_join("topics", ",").alias("topics")), f"WITH {NEWS}, tp AS (SELECT source, topic FROM (SELECT source, unnest([{', '.join(f'CASE WHEN {KW(w)} > 0 THEN {chr(39)}{k}{chr(39)} END' for k, w in news.TOPICS.items())}]) AS topic FROM sc) WHERE topic IS NOT NULL GROUP BY ALL), tg AS (SELECT source, string_agg(topic, ',' ORDER BY topic) AS topics FROM tp GROUP BY source) SELECT source, count(*) AS count, CAST(sum(CAST(s AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_sentiment, coalesce(any_value(topics), '') AS topics FROM sc LEFT JOIN tg USING (source) GROUP BY source")

# Rate limiter.
DAY = 86_400_000
add(
    "rate_limiter",
    lambda s, d: limiter.limit(t.read(s, d, "events").select(F.col("user_id").alias("key"), t.epoch_ms("ts").alias("ts"), F.col("event_id").alias("seq")), 3, 5 * DAY),
    f"""WITH RECURSIVE e AS (SELECT user_id AS key, (epoch_us(ts) // 1000) AS ts, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS held, FALSE AS success, CAST(0 AS BIGINT) AS reset FROM (SELECT DISTINCT key FROM e)
UNION ALL SELECT key, n, ts, seq, CASE WHEN len(h) < 3 THEN list_append(h, ts) ELSE h END, len(h) < 3, CASE WHEN len(h) < 3 THEN ts ELSE h[1] END + {5 * DAY} FROM (SELECT e.*, list_filter(r.held, lambda x: x > e.ts - {5 * DAY}) AS h FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT key, ts, seq, success, CAST(CASE WHEN success THEN 3 - len(held) ELSE 0 END AS INTEGER) AS remaining, reset FROM r WHERE n > 0""",
)

# Backtests.
CFG, BT = Indicators(), Backtest(entry=15.0, exit=0.0, short_entry=-15.0, short_exit=0.0, allow_shorts=True)
SCORED = ["symbol", "interval", "n", "ts", "open", "high", "low", "close", *[f"score_{c}" for c in CATEGORIES[:4]]]


def _scored(s, d):
    suites = kernels.suite(t.candles(s, d), CFG)
    ready = score.composite(suites, DEFAULT_WEIGHTS).select(*SCORED)
    return ready.join(F.broadcast(kernels.warmup(suites)), ["symbol", "interval"]).where(F.col("n") > F.col("warmup")).drop("warmup")  # a row per series


def _runs(s, n=3):
    return optimize.as_runs(s, optimize.candidates(DEFAULT_WEIGHTS, n))


def _events(s, d):
    return backtest.run_all(_scored(s, d), _runs(s), BT)


def _run_sql(count: int = 3, last: int = 10**9) -> str:
    """Scored bars up to ``last`` of each run and the state of its backtest after each bar."""
    runs = ", ".join(f"('c{i}', " + ", ".join(f"CAST({w[c]!r} AS DOUBLE)" for c in CATEGORIES[:4]) + ")" for i, w in enumerate(optimize.candidates(DEFAULT_WEIGHTS, count)))
    total, x = "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)"
    for c in CATEGORIES[:4]:
        total = f"({total} + w_{c})"
    for c in CATEGORIES[:4]:
        x = f"({x} + score_{c} * (w_{c} / {total}))"
    return f"""{with_suite(CFG)},\n{score_cte(DEFAULT_WEIGHTS)},
ru AS (SELECT * FROM (VALUES {runs}) v(run_id, {", ".join(f"w_{c}" for c in CATEGORIES[:4])})),
s0 AS (SELECT run_id, sc.symbol, sc.interval, sc.n, sc.ts, high, low, sc.close, greatest(CAST(-100 AS DOUBLE), least(CAST(100 AS DOUBLE), {x})) AS sco FROM scored sc JOIN roll USING (symbol, interval, n) CROSS JOIN ru WHERE sc.n BETWEEN 200 AND {last}),
bt AS (SELECT run_id, symbol, interval, 199 AS n, CAST(0 AS BIGINT) AS ts, CAST(10000 AS DOUBLE) AS eq, CAST(10000 AS DOUBLE) AS peak, 0 AS side, CAST(0 AS DOUBLE) AS ep, CAST(0 AS DOUBLE) AS q, 0 AS eb, CAST(0 AS BIGINT) AS et, CAST(0 AS DOUBLE) AS es,
  CAST(NULL AS VARCHAR) AS reason, CAST(0 AS DOUBLE) AS xp, 0 AS xside, CAST(0 AS DOUBLE) AS xep, CAST(0 AS DOUBLE) AS xq, 0 AS xeb, CAST(0 AS BIGINT) AS xet, CAST(0 AS DOUBLE) AS xes, CAST(0 AS DOUBLE) AS xs FROM (SELECT DISTINCT run_id, symbol, interval FROM s0)
UNION ALL SELECT run_id, symbol, interval, n, ts, eq1, greatest(peak, eq1), CASE WHEN enter <> 0 THEN enter WHEN reason1 IS NULL THEN side ELSE 0 END, CASE WHEN enter <> 0 THEN close ELSE ep END, CASE WHEN enter <> 0 THEN eq1 * 0.1e0 / close ELSE q END,
  CASE WHEN enter <> 0 THEN n ELSE eb END, CASE WHEN enter <> 0 THEN ts ELSE et END, CASE WHEN enter <> 0 THEN sco ELSE es END, reason1, xp, side, ep, q, eb, et, es, CASE WHEN reason1 = 'signal' THEN sco ELSE 0 END
  FROM (SELECT *, CASE WHEN reason1 IS NULL AND side <> 0 OR reason1 = 'signal' THEN 0 WHEN sco >= 15 THEN 1 WHEN sco <= -15 THEN -1 ELSE 0 END AS enter,
      CASE WHEN reason1 IS NULL THEN eq ELSE eq + (CASE WHEN side = 1 THEN xp - ep ELSE ep - xp END * q - (q * ep * 0.001e0 + q * xp * 0.001e0)) END AS eq1
    FROM (SELECT *, CASE WHEN stop IS NOT NULL THEN stop WHEN side = 1 AND sco <= 0 OR side = -1 AND sco >= 0 THEN 'signal' END AS reason1,
        CASE WHEN stop = 'stop_loss' THEN ep * (1 - side * 0.05e0) WHEN stop = 'take_profit' THEN ep * (1 + side * 0.1e0) ELSE close END AS xp
      FROM (SELECT b.eq, b.peak, b.side, b.ep, b.q, b.eb, b.et, b.es, s0.*, CASE WHEN b.side = 1 THEN CASE WHEN low <= ep * (1 - 0.05e0) THEN 'stop_loss' WHEN high >= ep * (1 + 0.1e0) THEN 'take_profit' END
          WHEN b.side = -1 THEN CASE WHEN high >= ep * (1 + 0.05e0) THEN 'stop_loss' WHEN low <= ep * (1 - 0.1e0) THEN 'take_profit' END END AS stop
        FROM bt b JOIN s0 ON s0.run_id = b.run_id AND s0.symbol = b.symbol AND s0.n = b.n + 1)))),
lastbar AS (SELECT bt.*, s0.close FROM bt JOIN s0 USING (run_id, symbol, n) QUALIFY row_number() OVER (PARTITION BY bt.run_id, bt.symbol ORDER BY n DESC) = 1),
closes AS (SELECT run_id, symbol, interval, xeb AS entry_bar, n AS exit_bar, xet AS entry_time, ts AS exit_time, xside AS sd, xep AS entry_price, xp AS exit_price, xq AS quantity, reason AS exit_reason, xes AS entry_score, xs AS exit_score FROM bt WHERE reason IS NOT NULL
  UNION ALL SELECT run_id, symbol, interval, eb, n, et, ts, side, ep, close, q, 'end_of_data', es, 0 FROM lastbar WHERE side <> 0),
pn AS (SELECT *, quantity * entry_price * 0.001e0 + quantity * exit_price * 0.001e0 AS fees, CASE WHEN sd = 1 THEN exit_price - entry_price ELSE entry_price - exit_price END * quantity AS gross FROM closes),
tr AS (SELECT run_id, symbol, interval, entry_bar, exit_bar, entry_time, exit_time, CASE WHEN sd = 1 THEN 'long' ELSE 'short' END AS side, entry_price, exit_price, quantity, gross - fees AS pnl, (gross - fees) / (quantity * entry_price) * 100 AS pnl_percent, fees, exit_reason, entry_score, exit_score,
  CASE WHEN entry_score > 60 THEN 'strong_buy' WHEN entry_score > 30 THEN 'buy' WHEN entry_score < -60 THEN 'strong_sell' WHEN entry_score < -30 THEN 'sell' ELSE 'neutral' END AS entry_tier, exit_bar - entry_bar AS hold_bars FROM pn),
ec AS (SELECT b.run_id, b.symbol, b.interval, b.n AS bar, b.ts AS time, CASE WHEN l.n IS NOT NULL AND l.side <> 0 THEN b.eq + (SELECT any_value(pnl) FROM tr WHERE tr.run_id = b.run_id AND tr.symbol = b.symbol AND tr.exit_reason = 'end_of_data') ELSE b.eq END AS equity, (b.peak - b.eq) / b.peak * 100 AS drawdown
  FROM bt b LEFT JOIN lastbar l ON l.run_id = b.run_id AND l.symbol = b.symbol AND l.n = b.n WHERE b.n >= 200)"""


BTS = _run_sql()
add("backtest_trades", lambda s, d: backtest.trades(_events(s, d)), f"{BTS} SELECT * FROM tr")
add("backtest_equity", lambda s, d: backtest.equity(_events(s, d)), f"{BTS} SELECT * FROM ec")


def _metrics(s, d):
    from barquet.operators.checkpoints import kept

    e = kept(_events(s, d))
    return backtest.metrics(backtest.trades(e), backtest.equity(e), BT.start_equity)


VX = lambda x, p=10: f"coalesce(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(32,{p}))) AS DOUBLE), 0)"
METRICS = f"""{BTS}, tm AS (SELECT run_id, symbol, interval, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl <= 0) AS losing_trades, {VX("CASE WHEN pnl > 0 THEN pnl END")} AS profit, abs({VX("CASE WHEN pnl <= 0 THEN pnl END")}) AS loss,
  {VX("CASE WHEN pnl > 0 THEN pnl_percent END")} AS wp, abs({VX("CASE WHEN pnl <= 0 THEN pnl_percent END")}) AS lp, {VX("fees")} AS total_fees FROM tr GROUP BY ALL),
e1 AS (SELECT *, lag(equity, 1, 10000) OVER (PARTITION BY run_id, symbol ORDER BY bar) AS before, greatest(10000, max(equity) OVER (PARTITION BY run_id, symbol ORDER BY bar)) AS pk FROM ec),
e2 AS (SELECT *, (equity - before) / before AS ret, pk - equity AS dd FROM e1),
em AS (SELECT run_id, symbol, interval, arg_max(equity, bar) AS fin, count(*) AS n, {VX("ret", 14)} AS s, {VX("ret * ret", 18)} AS ss, {VX("CASE WHEN ret < 0 THEN ret * ret END", 18)} AS down, count(*) FILTER (ret < 0) AS falls, max(dd) AS dd, arg_max(pk, (dd, -bar)) AS pk FROM e2 GROUP BY ALL),
st1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, symbol ORDER BY exit_bar, entry_bar) - row_number() OVER (PARTITION BY run_id, symbol, pnl > 0 ORDER BY exit_bar, entry_bar) AS g FROM tr),
st2 AS (SELECT run_id, symbol, pnl > 0 AS win, count(*) AS c FROM st1 GROUP BY run_id, symbol, pnl > 0, g), sk AS (SELECT run_id, symbol, coalesce(max(c) FILTER (win), 0) AS max_wins, coalesce(max(c) FILTER (NOT win), 0) AS max_losses FROM st2 GROUP BY ALL)"""
add("streaks", lambda s, d: backtest.streaks(backtest.trades(_events(s, d))), f"{METRICS} SELECT run_id, symbol, '1h' AS interval, max_wins, max_losses FROM sk")
add(
    "backtest_metrics",
    _metrics,
    f"""{METRICS}, m AS (SELECT em.*, coalesce(total_trades, 0) AS total_trades, coalesce(winning_trades, 0) AS winning_trades, coalesce(losing_trades, 0) AS losing_trades, coalesce(profit, 0) AS profit, coalesce(loss, 0) AS loss, coalesce(wp, 0) AS wp, coalesce(lp, 0) AS lp, coalesce(total_fees, 0) AS total_fees,
  coalesce(max_wins, 0) AS max_wins, coalesce(max_losses, 0) AS max_losses, CASE WHEN dd > 0 THEN dd / pk * 100 ELSE 0 END AS ddp, sqrt(greatest(0, ss - s * s / em.n) / (em.n - 1)) AS sd FROM em LEFT JOIN tm USING (run_id, symbol, interval) LEFT JOIN sk USING (run_id, symbol))
SELECT run_id, symbol, interval, total_trades, winning_trades, losing_trades, total_fees, fin - 10000 AS total_pnl, (fin - 10000) / 10000 * 100 AS total_pnl_percent, coalesce(winning_trades / nullif(total_trades, 0), 0) AS win_rate,
  CASE WHEN loss > 0 THEN profit / loss WHEN profit > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS profit_factor, greatest(0, dd) AS max_drawdown, ddp AS max_drawdown_percent, CASE WHEN ddp > 0 THEN (fin - 10000) / 10000 * 100 / ddp ELSE 0 END AS calmar_ratio,
  CASE WHEN sd > 1e-15 THEN s / n / sd * sqrt(252e0) ELSE 0 END AS sharpe_ratio, CASE WHEN falls = 0 THEN CASE WHEN s > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE s / n / sqrt(down / falls) * sqrt(252e0) END AS sortino_ratio,
  coalesce(profit / nullif(winning_trades, 0), 0) AS avg_win, coalesce(loss / nullif(losing_trades, 0), 0) AS avg_loss, coalesce(wp / nullif(winning_trades, 0), 0) AS avg_win_percent, coalesce(lp / nullif(losing_trades, 0), 0) AS avg_loss_percent, max_wins, max_losses FROM m""",
)
add("trade_summary", lambda s, d: backtest.trade_summary(backtest.trades(_events(s, d))), f"{BTS} SELECT run_id, symbol, interval, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, CAST(sum(hold_bars) AS DOUBLE) / count(*) AS avg_hold_bars, max(pnl) AS best_pnl, arg_max(entry_time, (pnl, -exit_bar)) AS best_time, min(pnl) AS worst_pnl, arg_min(entry_time, (pnl, exit_bar)) AS worst_time FROM tr GROUP BY ALL")
add("equity_downsample", lambda s, d: backtest.sampled(t.candles(s, d).select("symbol", "ts", "close"), ["symbol"], "ts"), f"""WITH c AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({t.candles_sql()})),
k AS (SELECT DISTINCT symbol, CAST(floor(g * (n / 200e0)) AS BIGINT) AS i FROM c, range(200) r(g) WHERE n > 200 UNION SELECT DISTINCT symbol, n - 1 FROM c)
SELECT symbol, ts, close FROM c WHERE n <= 200 OR (symbol, i) IN (SELECT symbol, i FROM k)""")
add("position_sizing", lambda s, d: _sizing(s, d), "SELECT p_partkey, CASE WHEN p_size = 25 THEN 0 ELSE 10000 * 0.01e0 / abs(p_retailprice - p_retailprice * (1 - (p_size - 25) / 100e0)) END AS quantity FROM part")


def _sizing(s, d):
    entry = F.col("p_retailprice")
    stop = entry * (1 - (F.col("p_size") - 25) / 100)
    return t.read(s, d, "part").select("p_partkey", backtest.fractional_size(F.lit(10_000.0), F.lit(0.01), entry, stop).alias("quantity"))


_KELLY = {"rate": "(p_partkey % 11) / 10.0", "win": "(p_partkey % 7) * 25.0", "loss": "(p_partkey % 5) * -20.0"}
add(
    "kelly_sizing",
    lambda s, d: t.read(s, d, "part").select("p_partkey", F.round(backtest.kelly_size(F.lit(10_000.0), *[F.expr(e).cast("double") for e in _KELLY.values()], F.col("p_retailprice"), F.lit(0.5)), 9).alias("quantity")),
    f"""SELECT p_partkey, round(CASE WHEN win = 0 OR loss = 0 THEN 0 ELSE 10000 * least(1, greatest(0, (rate * odds - (1 - rate)) / odds * 0.5e0)) / p_retailprice END, 9) AS quantity
FROM (SELECT *, win / abs(nullif(loss, 0)) AS odds FROM (SELECT p_partkey, p_retailprice, {", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in _KELLY.items())} FROM part))""",
)


# Optimisation.
add("walk_forward_windows", lambda s, d: optimize.windows(bars.extent(t.candles(s, d)).select("symbol", "interval", "bars"), 300, 100, 100), f"""WITH RECURSIVE b AS (SELECT symbol, interval, count(*) AS bars FROM ({t.candles_sql()}) GROUP BY 1, 2), w AS (SELECT symbol, interval, bars, CAST(0 AS BIGINT) AS "window", CAST(299 AS BIGINT) AS e FROM b WHERE 299 + 100 < bars UNION ALL SELECT symbol, interval, bars, "window" + 1, e + 100 FROM w WHERE e + 100 + 100 < bars)
SELECT symbol, interval, bars, "window", CAST(0 AS BIGINT) AS train_start, e AS train_end, e + 1 AS test_start, least(e + 100, bars - 1) AS test_end FROM w""")
CAND = f"""WITH RECURSIVE l AS (SELECT 0 AS i, CAST(42 AS BIGINT) AS x UNION ALL SELECT i + 1, (x * 1664525 + 1013904223) % 4294967296 FROM l WHERE i < 294),
raw AS (SELECT CAST((i - 1) // 6 + 1 AS INTEGER) AS place, (i - 1) % 6 AS k, x / 4294967296e0 AS u FROM l WHERE i > 0),
base AS (SELECT * FROM (VALUES {", ".join(f"({k}, CAST({DEFAULT_WEIGHTS[c]!r} AS DOUBLE))" for k, c in enumerate(CATEGORIES))}) b(k, b)),
v AS (SELECT place, k, b * (1 - 0.2e0) + u * (b * (1 + 0.2e0) - b * (1 - 0.2e0)) AS y FROM raw JOIN base USING (k)),
p AS (SELECT place, {", ".join(f"max(y) FILTER (k = {k}) AS y{k}" for k in range(6))} FROM v GROUP BY place),
q AS (SELECT *, y0 + y1 + y2 + y3 + y4 + y5 AS t FROM p),
cand AS (SELECT 'c' || place AS run_id, place, {", ".join(f"y{k} / t AS {c}" for k, c in enumerate(CATEGORIES))} FROM q UNION ALL SELECT 'c0', 0, {", ".join(f"CAST({DEFAULT_WEIGHTS[c]!r} AS DOUBLE)" for c in CATEGORIES)})"""
add("weight_candidates", lambda s, d: optimize.as_runs(s, optimize.candidates(DEFAULT_WEIGHTS)), f"{CAND} SELECT * FROM cand")
add("weight_validation", lambda s, d: optimize.as_runs(s, [*optimize.candidates(DEFAULT_WEIGHTS, 5), {c: 0.2 for c in CATEGORIES}]).select("place", optimize.valid().alias("valid")), "SELECT CAST(i AS INTEGER) AS place, i < 5 AS valid FROM range(6) r(i)")


def _results(s, d):
    k = F.col("p_partkey")
    return t.read(s, d, "part").select(F.concat(F.lit("r"), k).alias("run_id"), F.when(k % 10 != 0, F.col("p_size") / 25.0).alias("sharpe_ratio"), (k % 100 / 100.0).alias("win_rate"), (k % 50 / 100.0).alias("drawdown"), (k % 80).alias("trades"), F.lit(None).cast("double").alias("sortino_ratio"), *[((k + i) % 64 / 64.0).alias(c) for i, c in enumerate(CATEGORIES)])


RES = f"r AS (SELECT 'r' || p_partkey AS run_id, CASE WHEN p_partkey % 10 <> 0 THEN p_size / 25e0 END AS sharpe_ratio, p_partkey % 100 / 100e0 AS win_rate, p_partkey % 50 / 100e0 AS drawdown, p_partkey % 80 AS trades, {', '.join(f'(p_partkey + {i}) % 64 / 64e0 AS {c}' for i, c in enumerate(CATEGORIES))} FROM part)"
OK = "trades >= 10 AND coalesce(sharpe_ratio, CAST('-inf' AS DOUBLE)) >= 0.5e0 AND win_rate >= 0.4e0 AND abs(drawdown) <= 0.3e0"
COLS = ("sharpe_ratio", "win_rate", "drawdown", "trades")
add("robust_filter", lambda s, d: _results(s, d).where(optimize.robust(*[F.col(c) for c in COLS])).select("run_id", "sharpe_ratio"), f"WITH {RES} SELECT run_id, sharpe_ratio FROM r WHERE {OK}")
add("robustness_score", lambda s, d: _results(s, d).select("run_id", optimize.robustness(*[F.col(c) for c in COLS]).alias("robustness")), f"WITH {RES} SELECT run_id, CASE WHEN {OK} THEN least(sharpe_ratio / 2, 1) * 0.4e0 + win_rate * 0.3e0 + (1 - least(abs(drawdown) / 0.3e0, 1)) * 0.2e0 + least(trades / 50e0, 1) * 0.1e0 ELSE 0 END AS robustness FROM r")
add("top_performers", lambda s, d: optimize.top(_results(s, d), 12).select("run_id", "sharpe_ratio"), f"WITH {RES} SELECT run_id, sharpe_ratio FROM r ORDER BY sharpe_ratio DESC NULLS LAST, run_id LIMIT 12")
add("ensemble_weights", lambda s, d: optimize.ensemble(_results(s, d)).drop("sortino_ratio"), f"WITH {RES}, t AS (SELECT * FROM r ORDER BY sharpe_ratio DESC NULLS LAST, run_id LIMIT 5) SELECT count(*) AS contributors, {', '.join(f'CAST(sum(CAST(CAST({c} AS VARCHAR) AS DECIMAL(32,14))) AS DOUBLE) / count(*) AS {c}' for c in (*CATEGORIES, 'sharpe_ratio', 'win_rate'))} FROM t")
add("auto_activation", lambda s, d: optimize.activation(joins.newest(_templates(s), ["style"], "version"), _templates(s).where("active")), "SELECT * FROM (VALUES ('scalping', 'improved', TRUE, (0.8e0 - 0.5e0) / 0.5e0 * 100), ('day_trading', 'first version', TRUE, 100), ('swing_trading', 'not improved', FALSE, (1.05e0 - 1) / 1 * 100), ('position_trading', 'few backtests', FALSE, 0)) t(style, reason, activate, improvement)")
add("template_next_version", lambda s, d: optimize.next_versions(_templates(s)), "SELECT * FROM (VALUES ('scalping', 3), ('day_trading', 2), ('swing_trading', 3), ('position_trading', 3)) t(style, version)")
add("template_activate", lambda s, d: optimize.activate(_templates(s), _templates(s).where("style = 'scalping' and version = 2")).select("style", "version", "active"), "SELECT * FROM (VALUES ('scalping', 1, FALSE), ('scalping', 2, TRUE), ('day_trading', 1, FALSE), ('swing_trading', 1, TRUE), ('swing_trading', 2, FALSE), ('position_trading', 1, TRUE), ('position_trading', 2, FALSE)) t(style, version, active)")
add("job_progress", lambda s, d: optimize.progress(t.read(s, d, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_size").cast("long").alias("done"), F.lit(50).cast("long").alias("total"), F.lit(0).cast("long").alias("started_at")), 100_000).select("job_id", "percent", "eta_ms"), "SELECT p_partkey AS job_id, CAST(p_size * 2 AS INTEGER) AS percent, CASE WHEN p_size > 0 THEN CAST(floor(100000e0 / p_size * (50 - p_size)) AS BIGINT) END AS eta_ms FROM part")


def _searched(s, d):
    from barquet.operators.checkpoints import kept

    return kept(_scored(s, d))


def _walk_forward(s, d):
    """All defaults but the entry and exit thresholds of BT."""
    return optimize.walk_forward(_searched(s, d), DEFAULT_WEIGHTS, BT)


_RATIOS = ("sharpe_ratio", "sortino_ratio", "max_drawdown_percent")
#: Hourly series of these tables have one window: bars 200 to 499, by the candidates of seed 42.
add(
    "walk_forward_training",
    lambda s, d: optimize.training(_searched(s, d), DEFAULT_WEIGHTS, BT).withColumns({c: F.round(c, 6) for c in _RATIOS}),
    f"""SELECT symbol, interval, CAST(0 AS BIGINT) AS "window", place, {", ".join(CATEGORIES)}, {", ".join(f"round({c}, 6) AS {c}" for c in _RATIOS)}, win_rate, total_trades, total_pnl
FROM ({SQL["backtest_metrics"].replace(BTS, _run_sql(50, 499))}) JOIN (SELECT * FROM ({CAND} SELECT * FROM cand)) USING (run_id)""",
)
add("walk_forward", _walk_forward)
#: No candidate is robust on the random prices of these tables; with limits that let all pass, the best ones show.
add("walk_forward_loose", lambda s, d: optimize.walk_forward(_searched(s, d), DEFAULT_WEIGHTS, BT, limits={"min_sharpe": -100.0, "min_win_rate": 0.0, "max_drawdown": 1.0, "min_trades": 1}))
add("walk_forward_ensemble", lambda s, d: optimize.ensembles(QUERIES["walk_forward_loose"](s, d), ["symbol", "interval"]))
add(
    "candidates_by_weights",
    lambda s, d: optimize.same_weights(_results(s, d).select("run_id", "trades", *CATEGORIES), _results(s, d).where("trades = 7").select(F.col("run_id").alias("of"), *CATEGORIES)).select("run_id", F.col("of_right").alias("of")),
    f"WITH {RES} SELECT r.run_id, o.run_id AS of FROM r JOIN (SELECT * FROM r WHERE trades = 7) o ON {' AND '.join(f'r.{c} = o.{c}' for c in CATEGORIES)}",
)
add("ensembles", lambda s, d: optimize.ensembles(_results(s, d).withColumn("grp", F.col("trades") % 4), ["grp"], tie="run_id").drop("sortino_ratio"), f"WITH {RES}, t AS (SELECT *, trades % 4 AS grp FROM r QUALIFY row_number() OVER (PARTITION BY trades % 4 ORDER BY sharpe_ratio DESC NULLS LAST, run_id) <= 5) SELECT grp, count(*) AS contributors, {', '.join(f'CAST(sum(CAST(CAST(coalesce({c}, 0) AS VARCHAR) AS DECIMAL(32,14))) AS DOUBLE) / count(*) AS {c}' for c in (*CATEGORIES, 'sharpe_ratio', 'win_rate'))} FROM t GROUP BY grp")

# Streams, run over what is there and compared with the batch.


def _folder(s):
    from barquet.operators.checkpoints import shared_folder

    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


def _stream_bars(s, d):
    folder = _folder(s)
    jobs.run_available(jobs.bars(jobs.read_ticks(s, d), "1h"), folder, each=jobs.upsert_to(f"{folder}/rows", ["symbol", "interval", "ts"]), mode="update")
    return _last_version(s, f"{folder}/rows")


def _last_version(s, path):
    versions = s.read.parquet(path)
    return versions.where(F.col("v") == versions.agg(F.max("v")).first()[0]).drop("v")


add("stream_bars", _stream_bars, t.candles_sql())


def _stream_latest(s, d):
    folder = _folder(s)
    jobs.run_available(jobs.latest(jobs.read_ticks(s, d)), folder, each=jobs.upsert_to(f"{folder}/rows", ["symbol"]), mode="update")
    return _last_version(s, f"{folder}/rows").select("symbol", "event_id", "price")


add("stream_latest_price", _stream_latest, "SELECT event_type AS symbol, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY event_type")


def _stream_alerts(s, d):
    folder = _folder(s)
    levels = s.createDataFrame([(1, "click", "price_above", 200.0), (2, "view", "price_below", 1.0)], "alert_id int, symbol string, type string, target double")
    jobs.run_available(jobs.alerts(jobs.read_ticks(s, d), levels), folder)
    return s.read.parquet(f"{folder}/rows").select("alert_id", "symbol", "event_id", "price")


add("stream_alerts", _stream_alerts, "SELECT CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS alert_id, event_type AS symbol, event_id, value AS price FROM events WHERE (event_type = 'click' AND value >= 200) OR (event_type = 'view' AND value <= 1)")


def _stream_once(s, d):
    folder = _folder(s)
    jobs.run_available(jobs.once_per_day(jobs.read_ticks(s, d), ["symbol"]), folder)
    return s.read.parquet(f"{folder}/rows").select("symbol", F.unix_date("day").alias("day"))


add("stream_once_per_day", _stream_once, "SELECT DISTINCT event_type AS symbol, CAST((epoch_us(ts) // 1000) // 86400000 AS INTEGER) AS day FROM events")
add("stream_parse", lambda s, d: jobs.parse_tickers(t.read(s, d, "events").select(F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.to_json(F.struct(F.col("event_type").alias("s"), F.col("value").cast("string").alias("c"), F.col("event_id").alias("E")))).alias("value"))).select("symbol", F.unix_millis("ts").alias("ms"), "price"), "SELECT event_type AS symbol, event_id AS ms, value AS price FROM events WHERE event_id % 10 <> 0")


def _kline_messages(s, d):
    """A message a bar; the last bar of each series is open."""
    c = t.candles(s, d).withColumn("x", F.lead("ts").over(W.partitionBy("symbol").orderBy("ts")).isNotNull())
    text = [F.col(c).cast("string").alias(k) for k, c in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)]
    return c.select(F.to_json(F.struct(F.struct(F.col("symbol").alias("s"), F.col("interval").alias("i"), F.col("ts").alias("t"), *text, "x").alias("k"))).alias("value"))


add("kline_messages", lambda s, d: jobs.parse_klines(_kline_messages(s, d)), f"SELECT *, ts < max(ts) OVER (PARTITION BY symbol) AS closed FROM ({t.candles_sql()})")


def _stream_limiter(s, d):
    folder = _folder(s)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    requests = jobs.read_ticks(s, d).select(F.col("user_id").alias("key"), F.unix_millis("ts").alias("ts"), F.col("event_id").alias("seq"))
    jobs.run_available(jobs.limited(requests, 3, 5 * DAY), folder)
    return s.read.parquet(f"{folder}/rows")


add("stream_rate_limiter", _stream_limiter, SQL["rate_limiter"])
_STYLE = f"element_at(array({', '.join(chr(39) + x + chr(39) for x in [*STYLES, 'other'])}), CAST(p_partkey % 5 + 1 AS INT))"
add("scalar_styles", lambda s, d: t.read(s, d, "part").select("p_partkey", scalars.style_interval(F.expr(_STYLE)).alias("interval")), f"SELECT p_partkey, ['5m', '1h', '4h', '1d', '1h'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS interval FROM part")
add("scalar_ages", lambda s, d: t.read(s, d, "part").select("p_partkey", scalars.age_text(F.col("p_partkey") * 7000, 14_000_000).alias("age"), scalars.style_interval(F.col("p_brand")).alias("interval")), "SELECT p_partkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' END AS age, '1h' AS interval FROM (SELECT p_partkey, CAST(floor((14000000 - p_partkey * 7000) / 1000) AS BIGINT) AS s FROM part)")


# Stored signals, snapshots and pages of them.


def _stored(s, d):
    """One row per bar: the stored signal of a series in a style, alternating by hour."""
    hour = (F.col("ts") / HOUR).cast("long")
    return t.candles(s, d).select("symbol", "interval", "ts", F.element_at(F.array(*[F.lit(x) for x in STYLES]), (hour % 4 + 1).cast("int")).alias("style"), "close")


STORED = f"st AS (SELECT symbol, interval, ts, [{', '.join(chr(39) + x + chr(39) for x in STYLES)}][CAST(ts // {HOUR} % 4 + 1 AS INTEGER)] AS style, close FROM ({t.candles_sql()}))"
END = 1_705_276_800_000
add("signals_live", lambda s, d: joins.live(_stored(s, d), {k: v.ttl_days for k, v in STYLES.items()}, END), f"WITH {STORED} SELECT * FROM st WHERE ts + CASE style WHEN 'scalping' THEN 1 WHEN 'day_trading' THEN 7 WHEN 'swing_trading' THEN 30 ELSE 90 END * CAST(86400000 AS BIGINT) > {END}")
add("signals_latest_per_style", lambda s, d: joins.newest(_stored(s, d), ["symbol", "style"], "ts"), f"WITH {STORED} SELECT symbol, style, interval, ts, close FROM st QUALIFY row_number() OVER (PARTITION BY symbol, style ORDER BY ts DESC) = 1")
add("snapshot_stats", lambda s, d: joins.stats(_stored(s, d), "symbol").select("total", "oldest", "newest", F.explode("counts").alias("symbol", "count")), f"WITH {STORED} SELECT (SELECT count(*) FROM st) AS total, (SELECT min(ts) FROM st) AS oldest, (SELECT max(ts) FROM st) AS newest, symbol, count(*) AS count FROM st GROUP BY symbol")
add("history_with_fallback", lambda s, d: joins.filled(t.candles(s, d, "1d", True).select("ts"), t.candles(s, d, "1d").where("symbol = 'click' and ts % 172800000 = 0").select("ts", F.col("close").alias("price")), ["ts"], "price", 50.0), f"WITH c AS (SELECT ts, close FROM ({t.candles_sql('1d')}) WHERE symbol = 'click' AND ts % 172800000 = 0) SELECT ts, coalesce(c.close, 50) AS price FROM ({t.candles_sql('1d', True)}) LEFT JOIN c USING (ts)")
add("cursor_json", lambda s, d: t.candles(s, d, "1d").select(F.from_json(F.to_json(F.struct("symbol", "ts", "close")), "symbol string, ts long, close double").alias("j")).select("j.*"), f"SELECT symbol, ts, close FROM ({t.candles_sql('1d')})")
add("write_split", lambda s, d: sinks.split_valid(t.read(s, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") > 0)[1], "SELECT c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal > 0")
add("round_robin", lambda s, d: optimize.round_robin(list(STYLES), s.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "symbol string, place long")), "SELECT * FROM (VALUES ('scalping', 'A'), ('day_trading', 'B'), ('swing_trading', 'C'), ('position_trading', 'A')) v(style, symbol)")


def _live_merge(s, d):
    """500 bars of history and then the stream: each live bar replaces or extends it by its time."""
    folder = _folder(s)
    old = bars.scan(t.candles(s, d).where(F.col("ts") < END), limit=500)
    old.write.parquet(f"{folder}/rows/v=0")
    write = jobs.upsert_to(f"{folder}/rows", ["symbol", "interval", "ts"])
    live = jobs.bars(jobs.read_ticks(s, d), "1h").where(F.col("ts") >= END - 5 * HOUR)
    jobs.run_available(live, folder, each=lambda df, i: write(df, i + 1), mode="update")
    return _last_version(s, f"{folder}/rows")


add("stream_history_merge", _live_merge, f"WITH c AS ({t.candles_sql()}), h AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM c WHERE ts < {END}) WHERE r <= 500) SELECT * FROM h UNION SELECT * FROM c WHERE ts >= {END - 5 * HOUR}")

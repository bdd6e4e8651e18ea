"""Bars, indicators, signals and scores over candles made of events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barquet.config import DEFAULT_WEIGHTS, STYLES, Indicators
from barquet.functions import interpret, score
from barquet.operators import bars, kernels, overlays
from barquet.operators.checkpoints import shared_folder
from barquet.plans.kernel_sql import W, _ema, _wilder, frame, rolling_cte, score_cte, signals_sql, total, vals, with_suite
from barquet.sources import pages
from barquet.sources.tables import candles, candles_sql

DAY = Indicators()
BAR = ["symbol", "interval", "ts"]
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


for _interval in ("15m", "1h", "4h", "1d"):
    QUERIES[f"bars_rollup_{_interval}"] = lambda spark, d, i=_interval: candles(spark, d, i)
    SQL[f"bars_rollup_{_interval}"] = candles_sql(_interval)

QUERIES["bars_pooled"] = lambda spark, d: candles(spark, d, "1h", True)
SQL["bars_pooled"] = candles_sql("1h", True)

QUERIES["bars_resample"] = lambda spark, d: bars.resample(candles(spark, d, "15m"), "4h")
SQL["bars_resample"] = candles_sql("4h")

QUERIES["candles_latest_n"] = lambda spark, d: bars.scan(candles(spark, d), limit=100)
SQL["candles_latest_n"] = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM ({candles_sql()})) WHERE r <= 100"

#: A range inside the events, in ms: chosen from their own first day.
START, END = 1_704_412_800_000, 1_705_276_800_000

QUERIES["candles_range"] = lambda spark, d: bars.scan(candles(spark, d), START, END, limit=150)
SQL["candles_range"] = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r FROM ({candles_sql()}) WHERE ts BETWEEN {START} AND {END}) WHERE r <= 150"



def _paged(spark, d):
    """The candles once more, as pages of an endpoint: a folder in which they lie."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    candles(spark, d).write.parquet(folder)
    series = [(r["symbol"], "1h") for r in candles(spark, d).select("symbol").distinct().collect()]  # a request names its series
    return pages.read(spark, pages.FolderPages(folder), series, START, END, page=100, span=7 * 86_400_000)


QUERIES["candles_paged"] = _paged
SQL["candles_paged"] = f"SELECT * FROM ({candles_sql()}) WHERE ts BETWEEN {START} AND {END}"

QUERIES["candles_extent"] = lambda spark, d: bars.extent(candles(spark, d))
SQL["candles_extent"] = f"SELECT symbol, interval, min(ts) AS oldest, max(ts) AS newest, count(*) AS bars FROM ({candles_sql()}) GROUP BY 1, 2"

QUERIES["candles_missing"] = lambda spark, d: bars.missing_bars(candles(spark, d), "1h")
SQL["candles_missing"] = f"""WITH b AS ({candles_sql()}), e AS (SELECT symbol, interval, min(ts) AS a, max(ts) AS z FROM b GROUP BY 1, 2)
SELECT symbol, interval, ts FROM (SELECT symbol, interval, unnest(generate_series(a, z, 3600000)) AS ts FROM e) ANTI JOIN b USING (symbol, interval, ts)"""

QUERIES["backfill_gaps"] = lambda spark, d: bars.missing_ranges(candles(spark, d), START, END + 10**10)
SQL["backfill_gaps"] = f"""WITH e AS (SELECT symbol, interval, min(ts) AS a, max(ts) AS z FROM ({candles_sql()}) GROUP BY 1, 2)
SELECT symbol, interval, 'head' AS part, CAST({START} AS BIGINT) AS "from", a - 1 AS "to" FROM e WHERE a > {START} UNION ALL SELECT symbol, interval, 'tail', z + 1, CAST({END + 10**10} AS BIGINT) FROM e WHERE z < {END + 10**10}"""


@query("candles_upsert", f"WITH b AS ({candles_sql()}) SELECT symbol, interval, ts, open, high, low, CASE WHEN ts >= {END} THEN close + 1 ELSE close END AS close, volume FROM b")
def _upsert(spark, d):
    old = candles(spark, d)
    corrected = old.where(F.col("ts") >= END).withColumn("close", F.col("close") + 1)
    return bars.upsert(old, corrected, BAR)


@query("candles_inserted", f"WITH b AS ({candles_sql()}) SELECT count(*) AS inserted FROM b WHERE ts > {END}")
def _inserted(spark, d):
    old = candles(spark, d)
    return bars.inserted(old.where(F.col("ts") <= END), old.where(F.col("ts") >= START), BAR)


@query("candles_dedupe_keep_first", f"SELECT * FROM ({candles_sql()})")
def _dedupe(spark, d):
    one = candles(spark, d)
    pages = one.withColumn("page", F.lit(1)).unionByName(one.where(F.col("ts") > START).withColumns({"page": F.lit(2), "close": F.lit(0.0)}))
    return bars.keep_first(pages, BAR, ["page"]).drop("page")


@query("candles_incremental_sync", f"SELECT * FROM ({candles_sql()}) WHERE ts > {END}")
def _sync(spark, d):
    now = candles(spark, d)
    return bars.newer(now, now.where(F.col("ts") <= END))


@query("candles_retained", f"SELECT * FROM ({candles_sql('5m')}) WHERE ts > {END} - CAST(14 AS BIGINT) * 86400000")
def _retained(spark, d):
    return bars.retained(candles(spark, d, "5m"), END)


@query("align_timestamp", "SELECT event_id, (epoch_us(ts) // 1000) // 900000 * 900000 AS a15, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS a1d FROM events")
def _align(spark, d):
    from barquet.sources.tables import epoch_ms, read

    return read(spark, d, "events").select("event_id", bars.align(epoch_ms("ts"), "15m").alias("a15"), bars.align(epoch_ms("ts"), "1d").alias("a1d"))


ROLLING = {
    "sma": ["sma_medium", "sma_long"],
    "bollinger": ["bb_middle", "bb_upper", "bb_lower", "bb_pb"],
    "williams_r": ["williams_r"],
    "ichimoku": ["ichimoku_conversion", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b"],
    "obv": ["obv", "obv_sma"],
    "mfi": ["mfi"],
    "volume_ratio": ["volume_ratio"],
}
for _name, _cols in ROLLING.items():
    QUERIES[_name] = lambda spark, d, c=_cols: kernels.rolling(candles(spark, d), DAY).select(*BAR, *c)
    SQL[_name] = f"WITH {rolling_cte(DAY)} SELECT symbol, interval, ts, {', '.join(_cols)} FROM roll"

RECURSIVE = {
    "ema": ["ema_fast", "ema_slow"],
    "rsi": ["rsi"],
    "macd": ["macd", "macd_signal", "macd_histogram"],
    "atr": ["atr"],
    "stoch_rsi": ["stoch_rsi", "stoch_k", "stoch_d"],
    "supertrend": ["supertrend", "supertrend_direction"],
}


def _signed_trend(df):
    """supertrend_direction: 1 up, -1 down, as a number that both engines show alike where it is null."""
    return df.withColumn("supertrend_direction", F.when(F.col("supertrend_up"), 1.0).when(~F.col("supertrend_up"), -1.0))


SUITE = "(SELECT *, CASE WHEN supertrend_up THEN CAST(1 AS DOUBLE) WHEN NOT supertrend_up THEN CAST(-1 AS DOUBLE) END AS supertrend_direction FROM suite)"
for _name, _cols in RECURSIVE.items():
    QUERIES[_name] = lambda spark, d, c=_cols: _signed_trend(kernels.recursive(candles(spark, d), DAY)).select(*BAR, *c)
    SQL[_name] = f"{with_suite(DAY)} SELECT symbol, interval, ts, {', '.join(_cols)} FROM {SUITE}"

_SUITE = [c for cols in [*ROLLING.values(), *RECURSIVE.values()] for c in cols]


@query("indicator_suite", f"{with_suite(DAY)} SELECT symbol, interval, ts, n, {', '.join(_SUITE)} FROM {SUITE} WHERE symbol IN (SELECT symbol FROM suite GROUP BY symbol HAVING count(*) >= 210)")
def _suite(spark, d):
    return _signed_trend(kernels.suite(candles(spark, d), DAY)).select(*BAR, "n", *_SUITE)


for _style in ("scalping", "swing_trading", "position_trading"):
    _cfg = STYLES[_style].indicators
    QUERIES[f"suite_{_style}"] = lambda spark, d, c=_cfg: _signed_trend(kernels.suite(candles(spark, d), c)).select(*BAR, "n", *_SUITE)
    SQL[f"suite_{_style}"] = f"{with_suite(_cfg)} SELECT symbol, interval, ts, n, {', '.join(_SUITE)} FROM {SUITE} WHERE symbol IN (SELECT symbol FROM suite GROUP BY symbol HAVING count(*) >= {_cfg.min_candles})"


@query("warmup_bars", f"{with_suite(DAY)} SELECT symbol, interval, CAST(min(n) - 1 AS BIGINT) AS warmup FROM suite WHERE ema_slow IS NOT NULL AND sma_long IS NOT NULL AND rsi IS NOT NULL AND macd IS NOT NULL AND bb_middle IS NOT NULL AND atr IS NOT NULL AND stoch_d IS NOT NULL AND williams_r IS NOT NULL AND obv IS NOT NULL AND mfi IS NOT NULL AND ichimoku_span_b IS NOT NULL GROUP BY 1, 2")
def _warmup(spark, d):
    return kernels.warmup(kernels.suite(candles(spark, d), DAY))


@query("min_candles", f"WITH b AS ({candles_sql()}) SELECT symbol, CAST(count(*) AS BIGINT) AS bars, count(*) >= 88 AS scalping, count(*) >= 210 AS day_trading, count(*) >= 210 AS swing_trading, count(*) >= 410 AS position_trading FROM b GROUP BY symbol")
def _min_candles(spark, d):
    n = F.count("*")
    return candles(spark, d).groupBy("symbol").agg(n.alias("bars"), *[(n >= s.indicators.min_candles).alias(name) for name, s in STYLES.items()])


def _scored(spark, d, pooled=False, live=False, weights=None, cfg=DAY, skip_ichimoku=False):
    return score.composite(kernels.suite(candles(spark, d, "1h", pooled), cfg), weights or DEFAULT_WEIGHTS, live, skip_ichimoku=skip_ichimoku)


_SIGNALS = {"trend": ["ema_cross", "sma_trend", "ichimoku", "supertrend"], "momentum": ["rsi", "macd", "stoch", "williams"], "volume": ["obv", "mfi", "volume"], "volatility": ["bollinger", "atr"]}
_LABEL = {"EMA Cross": "ema_cross", "SMA Trend": "sma_trend", "Ichimoku": "ichimoku", "SuperTrend": "supertrend", "RSI": "rsi", "MACD": "macd", "StochRSI": "stoch", "Williams %R": "williams", "OBV": "obv", "MFI": "mfi", "Volume": "volume", "Bollinger": "bollinger", "ATR": "atr"}
for _category, _names in _SIGNALS.items():

    def _interpret(spark, d, category=_category, names=_names):
        suites = kernels.suite(candles(spark, d), DAY)
        rows = suites.select(*BAR, F.explode(interpret.by_category()[category]).alias("s"))
        label = F.create_map(*[F.lit(x) for kv in _LABEL.items() for x in kv])[F.col("s.name")]
        return rows.select(*BAR, label.alias("signal"), (score.multiplier(F.col("s.direction")) * F.col("s.strength")).alias("signed"))

    QUERIES[f"interpret_{_category}"] = _interpret
    _s = signals_sql()
    SQL[f"interpret_{_category}"] = f"{with_suite(DAY)},\n{vals(DAY)}\n" + " UNION ALL ".join(f"SELECT symbol, interval, ts, '{x}' AS signal, {_s[x]} + 0 AS signed FROM vals WHERE ({_s[x]}) IS NOT NULL" for x in _names)


@query("category_scores", f"{with_suite(DAY)},\n{score_cte(DEFAULT_WEIGHTS)} SELECT symbol, interval, ts, score_trend, score_momentum, score_volume, score_volatility FROM scored")
def _categories(spark, d):
    return _scored(spark, d).select(*BAR, "score_trend", "score_momentum", "score_volume", "score_volatility")


@query("composite_at_bar", f"{with_suite(DAY)},\n{score_cte(DEFAULT_WEIGHTS)} SELECT symbol, interval, ts, score, tier, confidence FROM scored")
def _at_bar(spark, d):
    return _scored(spark, d).select(*BAR, "score", "tier", "confidence")


@query("composite_score", f"{with_suite(DAY, pooled=True)},\n{score_cte(DEFAULT_WEIGHTS, live=True)} SELECT symbol, interval, ts, close, score_trend, score_momentum, score_volume, score_volatility, score, tier, confidence FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def composite_score(spark, d):
    cols = [*BAR, "close", "score_trend", "score_momentum", "score_volume", "score_volatility", "score", "tier", "confidence"]
    return score.latest(_scored(spark, d, pooled=True, live=True).select(*cols))


@query("style_scores", " UNION ALL ".join(f"SELECT * FROM ({with_suite(s.indicators)},\n{score_cte(s.weights, live=True, cfg=s.indicators, skip_ichimoku=s.skip_ichimoku)} SELECT symbol, interval, ts, '{name}' AS style, score, tier, confidence FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)" for name, s in STYLES.items()))
def _style_scores(spark, d):
    out = None
    for name, s in STYLES.items():
        one = score.latest(_scored(spark, d, live=True, weights=s.weights, cfg=s.indicators, skip_ichimoku=s.skip_ichimoku).select(*BAR, F.lit(name).alias("style"), "score", "tier", "confidence"))
        out = one if out is None else out.unionByName(one)
    return out


_MEANS = ["ema_fast", "ema_slow", "rsi", "macd", "macd_signal", "macd_histogram", "atr"]


@query("means_by_ranges", f"{with_suite(DAY, interval='15m')} SELECT symbol, interval, ts, {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)} FROM suite")
def _means_by_ranges(spark, d):
    return kernels.long_means(candles(spark, d, "15m"), DAY).select(*BAR, *[F.round(c, 6).alias(c) for c in _MEANS])


@query("tiers", f"{with_suite(DAY)},\n{score_cte(DEFAULT_WEIGHTS)} SELECT symbol, tier, count(*) AS bars FROM scored GROUP BY 1, 2")
def _tiers(spark, d):
    return _scored(spark, d).groupBy("symbol", "tier").agg(F.count("*").alias("bars"))


_MA = [f"ma_{p}" for p in (5, 10, 30, 60)] + [f"volume_ma_{p}" for p in (5, 10, 20)]


@query("chart_means", f"WITH b AS ({candles_sql()}), c AS (SELECT *, row_number() {W} AS n FROM b) SELECT symbol, interval, ts, " + ", ".join(f"CASE WHEN n >= {p} THEN {total('close', p)} / {p} END AS ma_{p}" for p in (5, 10, 30, 60)) + ", " + ", ".join(f"CASE WHEN n >= {p} THEN {total('volume', p)} / {p} END AS volume_ma_{p}" for p in (5, 10, 20)) + " FROM c")
def _chart_means(spark, d):
    return overlays.means(candles(spark, d)).select(*BAR, *_MA)


_LINES = ["ema_6", "ema_20", "rsi_6", "rsi_24", "kdj_k", "kdj_d", "kdj_j", "sar"]


@query(
    "chart_overlays",
    f"""WITH RECURSIVE c AS ({candles_sql()}), b AS (SELECT *, CAST(row_number() {W} AS INTEGER) AS n, lag(close) {W} AS before, max(high) {frame(9)} AS hh, min(low) {frame(9)} AS ll, lag(low) {W} AS l1, lag(low, 2) {W} AS l2, lag(high) {W} AS h1, lag(high, 2) {W} AS h2 FROM c),
r AS (SELECT symbol, interval, ts, n, close AS e6, close AS e20, CAST(0 AS DOUBLE) AS g6, CAST(0 AS DOUBLE) AS x6, CAST(0 AS DOUBLE) AS g24, CAST(0 AS DOUBLE) AS x24, CAST(50 AS DOUBLE) AS k, CAST(50 AS DOUBLE) AS d, TRUE AS up, low AS sar, high AS ext, CAST(0.02 AS DOUBLE) AS sp FROM b WHERE n = 1
UNION ALL SELECT symbol, interval, ts, n, e6, e20, g6, x6, g24, x24, k1, CASE WHEN n >= 9 THEN (2 * d + k1) / 3 ELSE d END, CASE WHEN hit THEN NOT up ELSE up END, CASE WHEN hit THEN ext ELSE aim END,
  CASE WHEN hit THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ext, high) ELSE least(ext, low) END, CASE WHEN hit THEN CAST(0.02 AS DOUBLE) WHEN (up AND high > ext) OR (NOT up AND low < ext) THEN least(sp + 0.02e0, 0.2e0) ELSE sp END
  FROM (SELECT *, CASE WHEN up THEN low < aim ELSE high > aim END AS hit FROM (SELECT b.symbol, b.interval, b.ts, b.n, b.high, b.low, r.up, r.ext, r.sp, r.d,
    {_ema(6, "b.close", "b.n", "r.e6")} AS e6, {_ema(20, "b.close", "b.n", "r.e20")} AS e20,
    {_wilder(6, "greatest(b.close - b.before, 0)", "(b.n - 1)", "r.g6")} AS g6, {_wilder(6, "greatest(b.before - b.close, 0)", "(b.n - 1)", "r.x6")} AS x6, {_wilder(24, "greatest(b.close - b.before, 0)", "(b.n - 1)", "r.g24")} AS g24, {_wilder(24, "greatest(b.before - b.close, 0)", "(b.n - 1)", "r.x24")} AS x24,
    CASE WHEN b.n >= 9 THEN (2 * r.k + CASE WHEN hh > ll THEN (b.close - ll) / (hh - ll) * 100 ELSE 0 END) / 3 ELSE r.k END AS k1,
    CASE WHEN r.up THEN least(r.sar + r.sp * (r.ext - r.sar), l1, coalesce(l2, l1)) ELSE greatest(r.sar + r.sp * (r.ext - r.sar), h1, coalesce(h2, h1)) END AS aim
    FROM r JOIN b ON b.symbol = r.symbol AND b.n = r.n + 1)))
SELECT symbol, interval, ts, CASE WHEN n >= 6 THEN e6 END AS ema_6, CASE WHEN n >= 20 THEN e20 END AS ema_20, CASE WHEN n > 6 THEN CASE WHEN x6 = 0 THEN 100 ELSE 100 - 100 / (1 + g6 / x6) END END AS rsi_6, CASE WHEN n > 24 THEN CASE WHEN x24 = 0 THEN 100 ELSE 100 - 100 / (1 + g24 / x24) END END AS rsi_24,
  CASE WHEN n >= 9 THEN k END AS kdj_k, CASE WHEN n >= 9 THEN d END AS kdj_d, CASE WHEN n >= 9 THEN 3 * k - 2 * d END AS kdj_j, CASE WHEN n > 1 THEN sar END AS sar FROM r""",
)
def _chart_overlays(spark, d):
    return overlays.overlays(candles(spark, d)).select(*BAR, *_LINES)

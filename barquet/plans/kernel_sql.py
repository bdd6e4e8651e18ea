"""SQL of indicators and scores over candles, as common table expressions."""

from __future__ import annotations

from barquet.config import CATEGORIES, Indicators
from barquet.sources.tables import candles_sql

W = "OVER (PARTITION BY symbol, interval ORDER BY ts)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol, interval ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def total(x: str, n: int) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,8))) {frame(n)} AS DOUBLE)"


def rolling_cte(cfg: Indicators, interval: str = "1h", pooled: bool = False) -> str:
    """CTEs up to ``roll``: bars with n and the rolling indicators."""
    p, k = cfg.bollinger
    conv, base, span = cfg.ichimoku
    hl = lambda n: f"(max(high) {frame(n)} + min(low) {frame(n)}) / 2"
    return f"""bars AS ({candles_sql(interval, pooled)}),
b0 AS (SELECT *, CAST(row_number() {W} AS INTEGER) AS n, lag(close) {W} AS before, lag(high + low + close) {W} AS tp0 FROM bars),
b1 AS (SELECT *, coalesce(sign(close - before) * volume, CAST(0 AS DOUBLE)) AS signed,
  CASE WHEN high + low + close - tp0 > 0 THEN (high + low + close) * volume ELSE 0 END AS up, CASE WHEN high + low + close - tp0 < 0 THEN (high + low + close) * volume ELSE 0 END AS down FROM b0),
b2 AS (SELECT *, CAST(sum(CAST(signed AS DECIMAL(28,8))) {W} AS DOUBLE) AS o FROM b1),
b3 AS (SELECT *, {total("close", p)} AS s, {total("close * close", p)} AS ss, {total("up", cfg.mfi)} AS u, {total("down", cfg.mfi)} AS d,
  CASE WHEN n >= {cfg.volume} THEN {total("volume", cfg.volume)} / {cfg.volume} ELSE volume END AS vm, max(high) {frame(cfg.williams)} AS hh, min(low) {frame(cfg.williams)} AS ll FROM b2),
b4 AS (SELECT *, sqrt(greatest((ss - s * s / {p}) / {p}, 0)) AS sd FROM b3),
b5 AS (SELECT symbol, interval, ts, open, high, low, close, volume, n, before,
  CASE WHEN n >= {cfg.sma[0]} THEN {total("close", cfg.sma[0])} / {cfg.sma[0]} END AS sma_medium, CASE WHEN n >= {cfg.sma[1]} THEN {total("close", cfg.sma[1])} / {cfg.sma[1]} END AS sma_long,
  CASE WHEN n >= {p} THEN s / {p} END AS bb_middle, CASE WHEN n >= {p} THEN s / {p} + sd * CAST({k} AS DOUBLE) END AS bb_upper, CASE WHEN n >= {p} THEN s / {p} - sd * CAST({k} AS DOUBLE) END AS bb_lower,
  CASE WHEN n >= {cfg.williams} AND hh <> ll THEN (hh - close) * -100 / (hh - ll) END AS williams_r,
  CASE WHEN n >= {conv} THEN {hl(conv)} END AS ichimoku_conversion, CASE WHEN n >= {base} THEN {hl(base)} END AS ichimoku_base, CASE WHEN n >= {span} THEN {hl(span)} END AS ichimoku_span_b,
  CASE WHEN n > 1 THEN o END AS obv, CASE WHEN n >= 21 THEN {total("o", 20)} / 20 ELSE o END AS obv_sma,
  CASE WHEN n >= {cfg.mfi + 1} THEN CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END END AS mfi, CASE WHEN vm > 0 THEN volume / vm ELSE 1 END AS volume_ratio FROM b4),
roll AS (SELECT *, CASE WHEN bb_upper <> bb_lower THEN (close - bb_lower) / (bb_upper - bb_lower) END AS bb_pb, CASE WHEN ichimoku_span_b IS NOT NULL THEN (ichimoku_conversion + ichimoku_base) / 2 END AS ichimoku_span_a FROM b5)"""


def _ema(p: int, x: str, n: str, old: str) -> str:
    """New accumulator of an EMA after its n-th value x: a sum before p, then the mean."""
    k = 2 / (p + 1)
    return f"CASE WHEN {n} < {p} THEN {old} + {x} WHEN {n} = {p} THEN ({old} + {x}) / {p} ELSE ({x} - {old}) * CAST({k!r} AS DOUBLE) + {old} END"


def _wilder(p: int, x: str, n: str, old: str) -> str:
    return f"CASE WHEN {n} < {p} THEN {old} + {x} WHEN {n} = {p} THEN ({old} + {x}) / {p} ELSE ({old} * {p - 1} + {x}) / {p} END"


def recursive_cte(cfg: Indicators) -> str:
    """CTEs from ``roll`` to ``suite``: WITH RECURSIVE is needed."""
    fast, slow, (mf, ms, sig) = cfg.ema[0], cfg.ema[1], cfg.macd
    sp, sm = cfg.supertrend
    gain, loss, n = "greatest(b.close - b.before, 0)", "greatest(b.before - b.close, 0)", "(b.n - 1)"
    tr = "greatest(b.high - b.low, abs(b.high - b.before), abs(b.low - b.before))"
    zero = "CAST(0 AS DOUBLE)"
    first = max(mf, ms)
    return f"""r1 AS (SELECT symbol, interval, n, close, close AS e1, close AS e2, close AS e3, close AS e4, {zero} AS g, {zero} AS l, {zero} AS a, {zero} AS g2, {zero} AS l2, {zero} AS a2 FROM roll WHERE n = 1
  UNION ALL SELECT b.symbol, b.interval, b.n, b.close, {_ema(fast, "b.close", "b.n", "r.e1")}, {_ema(slow, "b.close", "b.n", "r.e2")}, {_ema(mf, "b.close", "b.n", "r.e3")}, {_ema(ms, "b.close", "b.n", "r.e4")},
  {_wilder(cfg.rsi, gain, n, "r.g")}, {_wilder(cfg.rsi, loss, n, "r.l")}, {_wilder(cfg.atr, tr, n, "r.a")},
  {_wilder(cfg.stoch[0], gain, n, "r.g2")}, {_wilder(cfg.stoch[0], loss, n, "r.l2")}, {_wilder(sp, tr, n, "r.a2")}
  FROM r1 r JOIN roll b ON b.symbol = r.symbol AND b.interval = r.interval AND b.n = r.n + 1),
r2 AS (SELECT symbol, interval, n, CASE WHEN n >= {fast} THEN e1 END AS ema_fast, CASE WHEN n >= {slow} THEN e2 END AS ema_slow, CASE WHEN n >= {first} THEN e3 - e4 END AS macd,
  CASE WHEN n > {cfg.rsi} THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi, CASE WHEN n > {cfg.atr} THEN a END AS atr,
  CASE WHEN n > {cfg.stoch[0]} THEN CASE WHEN l2 = 0 THEN 100 ELSE 100 - 100 / (1 + g2 / l2) END END AS srsi, CASE WHEN n > {sp} THEN a2 END AS st_atr FROM r1),
r3 AS (SELECT symbol, interval, n, macd AS acc FROM r2 WHERE n = {first}
  UNION ALL SELECT b.symbol, b.interval, b.n, {_ema(sig, "b.macd", f"(b.n - {first - 1})", "r.acc")} FROM r3 r JOIN r2 b ON b.symbol = r.symbol AND b.interval = r.interval AND b.n = r.n + 1),
st AS (SELECT r2.symbol, r2.interval, r2.n, (high + low) / 2 + {sm} * st_atr AS upper, (high + low) / 2 - {sm} * st_atr AS lower, close >= (high + low) / 2 - {sm} * st_atr AS up, close
  FROM r2 JOIN roll USING (symbol, interval, n) WHERE r2.n = {sp + 1}
  UNION ALL SELECT symbol, interval, n, upper, lower, CASE WHEN was THEN close >= lower ELSE close > upper END, close FROM (SELECT b.symbol, b.interval, b.n, b.close, r.up AS was,
    CASE WHEN r.close <= r.upper THEN least((b.high + b.low) / 2 + {sm} * q.st_atr, r.upper) ELSE (b.high + b.low) / 2 + {sm} * q.st_atr END AS upper,
    CASE WHEN r.close >= r.lower THEN greatest((b.high + b.low) / 2 - {sm} * q.st_atr, r.lower) ELSE (b.high + b.low) / 2 - {sm} * q.st_atr END AS lower
    FROM st r JOIN roll b ON b.symbol = r.symbol AND b.interval = r.interval AND b.n = r.n + 1 JOIN r2 q ON q.symbol = b.symbol AND q.interval = b.interval AND q.n = b.n)),
k0 AS (SELECT r2.*, ts, min(srsi) {frame(cfg.stoch[1])} AS lo, max(srsi) {frame(cfg.stoch[1])} AS hi FROM r2 JOIN roll USING (symbol, interval, n)),
k1 AS (SELECT *, CASE WHEN n >= {cfg.stoch[0] + cfg.stoch[1]} THEN CASE WHEN hi > lo THEN (srsi - lo) / (hi - lo) * 100 ELSE 0 END END AS raw FROM k0),
k2 AS (SELECT *, (lag(raw, 2) {W} + lag(raw) {W} + raw) / 3 AS k FROM k1),
k3 AS (SELECT *, (lag(k, 2) {W} + lag(k) {W} + k) / 3 AS d FROM k2),
suite AS (SELECT roll.*, ema_fast, ema_slow, rsi, k3.macd, CASE WHEN k3.macd IS NOT NULL THEN coalesce(CASE WHEN n >= {first + sig - 1} THEN acc END, 0) END AS macd_signal,
  CASE WHEN k3.macd IS NOT NULL THEN CASE WHEN n >= {first + sig - 1} THEN k3.macd - acc ELSE 0 END END AS macd_histogram, atr,
  CASE WHEN d IS NOT NULL THEN raw END AS stoch_rsi, CASE WHEN d IS NOT NULL THEN k END AS stoch_k, d AS stoch_d, CASE WHEN up THEN lower ELSE upper END AS supertrend, up AS supertrend_up
  FROM roll JOIN k3 USING (symbol, interval, n) LEFT JOIN r3 USING (symbol, interval, n) LEFT JOIN (SELECT symbol, interval, n, upper, lower, up FROM st) USING (symbol, interval, n))"""


def _signed(*cases: tuple[str, float | str, int]) -> str:
    """Signed strength: condition, strength, sign of the first case that holds."""
    whens = " ".join(f"WHEN {c} THEN {s} * greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), {x}))" for c, x, s in cases[:-1])
    _, x, s = cases[-1]
    return f"CASE {whens} ELSE {s} * greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), {x})) END"


def signals_sql(live: bool = False) -> dict[str, str]:
    """Signed strength of each signal over columns of ``vals``."""
    p = "fast" if live else "close"
    s = "least(100, abs((fast - slow) / slow * 100) * 20)"
    m = "least(100, abs(hist) * 1000)"
    dist = "coalesce(CASE WHEN osma <> 0 THEN abs(obv0 - osma) / abs(osma) * 100 END, 0)"
    return {
        "ema_cross": _signed((f"fast > slow AND {p} > fast", s, 1), ("fast > slow", f"{s} * 0.6e0", 1), (f"NOT {p} > fast", s, -1), ("", f"{s} * 0.6e0", -1)),
        "sma_trend": _signed((f"{p} > sm AND {p} > sl AND sm > sl", 80, 1), (f"NOT {p} > sm AND NOT {p} > sl AND NOT sm > sl", 80, -1), (f"{p} > sm AND sm > sl", 50, 1), (f"NOT {p} > sm AND NOT sm > sl", 50, -1), ("", 30, 0)),
        "ichimoku": "CASE WHEN sb IS NOT NULL THEN " + _signed((f"{p} > greatest(sa, sb) AND ic > ib", 75, 1), (f"{p} < least(sa, sb) AND ic < ib", 75, -1), (f"{p} > greatest(sa, sb)", 50, 1), (f"{p} < least(sa, sb)", 50, -1), ("", 25, 0)) + " END",
        "supertrend": "CASE WHEN up THEN CAST(60 AS DOUBLE) WHEN NOT up THEN CAST(-60 AS DOUBLE) END",
        "rsi": _signed(("rsi0 >= 80", 90, -1), ("rsi0 >= 70", 65, -1), ("rsi0 <= 20", 90, 1), ("rsi0 <= 30", 65, 1), ("rsi0 >= 60", 30, 1), ("rsi0 <= 40", 30, -1), ("", 10, 0)),
        "macd": _signed(("line > 0 AND hist > 0", m, 1), ("line > 0 AND hist < 0", 30, 1), ("line < 0 AND hist < 0", m, -1), ("line < 0 AND hist > 0", 30, -1), ("", 10, 0)),
        "stoch": _signed(("k > 80 AND d > 80", 70, -1), ("k < 20 AND d < 20", 70, 1), ("k > d AND k < 80", 40, 1), ("k < d AND k > 20", 40, -1), ("", 20, 0)),
        "williams": _signed(("wr > -20", 65, -1), ("wr < -80", 65, 1), ("", 20, 0)),
        "obv": _signed(("obv0 > osma", dist, 1), ("", dist, -1)),
        "mfi": _signed(("mfi0 >= 80", 70, -1), ("mfi0 <= 20", 70, 1), ("mfi0 >= 60", 30, 1), ("mfi0 <= 40", 30, -1), ("", 10, 0)),
        "volume": _signed(("ratio > 2", 90, 0), ("ratio > 1.5", 60, 0), ("ratio < 0.5", 40, 0), ("", 20, 0)),
        "bollinger": _signed(("pb > 1", 70, -1), ("pb < 0", 70, 1), ("pb > 0.8", 40, -1), ("pb < 0.2", 40, 1), ("", 10, 0)),
        "atr": _signed(("TRUE", 50, 0), ("", 30, 0)),
    }


def vals(cfg: Indicators) -> str:
    """Values of signals in series with enough bars, neutral while an indicator warms up."""
    return f"""vals AS (SELECT *, coalesce(ema_fast, close) AS fast, coalesce(ema_slow, close) AS slow, coalesce(sma_medium, close) AS sm, coalesce(sma_long, close) AS sl, coalesce(rsi, 50) AS rsi0, coalesce(macd, 0) AS line,
  coalesce(macd_histogram, 0) AS hist, coalesce(stoch_k, 50) AS k, coalesce(stoch_d, 50) AS d, coalesce(williams_r, -50) AS wr, coalesce(obv, 0) AS obv0, coalesce(obv_sma, 0) AS osma, coalesce(mfi, 50) AS mfi0, volume_ratio AS ratio,
  coalesce(bb_pb, 0.5) AS pb, ichimoku_conversion AS ic, ichimoku_base AS ib, ichimoku_span_a AS sa, ichimoku_span_b AS sb, supertrend_up AS up FROM suite QUALIFY count(*) OVER (PARTITION BY symbol, interval) >= {cfg.min_candles})"""


def score_cte(weights: dict[str, float], live: bool = False, cfg: Indicators = Indicators(), skip_ichimoku: bool = False) -> str:
    """CTEs from ``suite`` to ``scored``: category scores, score, tier, without futures and sentiment."""
    sig = signals_sql(live) | ({"ichimoku": "CAST(NULL AS DOUBLE)"} if skip_ichimoku else {})
    w = [weights[c] for c in CATEGORIES[:4]]
    total = "0"
    for x in w:
        total = f"({total} + CAST({x!r} AS DOUBLE))"
    score = "CAST(0 AS DOUBLE)"
    for c, x in zip(CATEGORIES[:4], w, strict=True):
        score = f"({score} + score_{c} * (CAST({x!r} AS DOUBLE) / avail))"
    missing = weights["futures"] * 100 + weights["sentiment"] * 100
    return f"""{vals(cfg)},
sig AS (SELECT symbol, interval, ts, n, close, {", ".join(f"{s} AS s_{name}" for name, s in sig.items())} FROM vals),
cat AS (SELECT symbol, interval, ts, n, close, (s_ema_cross + s_sma_trend + coalesce(s_ichimoku, 0) + coalesce(s_supertrend, 0)) / (2 + (s_ichimoku IS NOT NULL)::INT + (s_supertrend IS NOT NULL)::INT) AS score_trend,
  (s_rsi + s_macd + s_stoch + s_williams) / 4 AS score_momentum, (s_obv + s_mfi + s_volume) / 3 AS score_volume, (s_bollinger + s_atr) / 2 AS score_volatility, CAST({total} AS DOUBLE) AS avail FROM sig),
scored0 AS (SELECT *, greatest(CAST(-100 AS DOUBLE), least(CAST(100 AS DOUBLE), {score})) AS score FROM cat),
scored AS (SELECT *, CASE WHEN score > 60 THEN 'strong_buy' WHEN score > 30 THEN 'buy' WHEN score < -60 THEN 'strong_sell' WHEN score < -30 THEN 'sell' ELSE 'neutral' END AS tier,
  CAST(greatest(0, floor(CAST(100 AS DOUBLE) - CAST({missing!r} AS DOUBLE) + 0.5)) AS INTEGER) AS confidence FROM scored0)"""


def with_suite(cfg: Indicators, interval: str = "1h", pooled: bool = False) -> str:
    return f"WITH RECURSIVE {rolling_cte(cfg, interval, pooled)},\n{recursive_cte(cfg)}"

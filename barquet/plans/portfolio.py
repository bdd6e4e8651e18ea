"""Journal, portfolio, lots and risk over orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet.functions import scalars
from barquet.operators import export, journal, lots, portfolio
from barquet.sources import tables as t

QUERIES, SQL = {}, {}
PNL = "CAST(pnl AS DECIMAL(28,8))"
SUMMARY = f"""count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, coalesce(CAST(sum({PNL}) AS DOUBLE), 0) AS total_pnl, max(pnl) AS best_trade, min(pnl) AS worst_trade,
  coalesce(count(*) FILTER (pnl > 0) * CAST(100 AS DOUBLE) / nullif(count(pnl), 0), 0) AS win_rate, coalesce(CAST(sum({PNL}) AS DOUBLE) / nullif(count(pnl), 0), 0) AS avg_pnl,
  CASE WHEN sum({PNL}) FILTER (pnl < 0) < 0 THEN coalesce(CAST(sum({PNL}) FILTER (pnl > 0) AS DOUBLE), 0) / abs(CAST(sum({PNL}) FILTER (pnl < 0) AS DOUBLE)) END AS profit_factor"""
J = f"({t.JOURNAL_SQL})"


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def perf(column: str, source: str = J, top: str = "") -> str:
    return f"""SELECT {column}, count(*) AS count, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, count(*) FILTER (pnl > 0) * CAST(100 AS DOUBLE) / count(*) AS win_rate,
  CAST(sum({PNL}) AS DOUBLE) / count(*) AS avg_pnl FROM {source} WHERE pnl IS NOT NULL AND {column} IS NOT NULL GROUP BY {column} {top}"""


add("journal_summary", lambda s, d: journal.summary(t.journal(s, d)), f"SELECT {SUMMARY} FROM {J}")
add("journal_summary_by_user", lambda s, d: journal.summary(t.journal(s, d), ["user_id"]), f"SELECT user_id, {SUMMARY} FROM {J} GROUP BY user_id")
add("journal_by_tag", lambda s, d: journal.by_tag(t.journal(s, d)), perf("tag", f"(SELECT pnl, unnest(tags) AS tag FROM {J})", "ORDER BY count DESC, tag LIMIT 50"))
add("journal_by_setup", lambda s, d: journal.performance(t.journal(s, d), "setup_type", 20), perf("setup_type", top="ORDER BY count DESC, setup_type LIMIT 20"))
add("journal_by_condition", lambda s, d: journal.performance(t.journal(s, d), "market_condition"), perf("market_condition"))
add("journal_by_tier", lambda s, d: journal.performance(t.journal(s, d), "signal_tier"), perf("signal_tier"))
add("journal_by_action", lambda s, d: journal.by_action(t.journal(s, d)), f"SELECT action, count(*) AS count, count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM orders) AS percentage FROM {J} GROUP BY action")
MONTHS = f"SELECT strftime(make_timestamp(created_at * 1000), '%Y-%m') AS month, CAST(sum({PNL}) AS DOUBLE) AS pnl, count(*) AS trades FROM {J} WHERE pnl IS NOT NULL GROUP BY 1"
add("journal_by_month", lambda s, d: journal.by_month(t.journal(s, d)), MONTHS)
add("journal_tags", lambda s, d: journal.tag_counts(t.journal(s, d)), f"SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM {J}) GROUP BY tag")
SORTS = ["created_at", "pnl", "entry_price"]
add("journal_page", lambda s, d: journal.page(journal.matching(t.journal(s, d), action="buy", setup_type=None), "-pnl", SORTS, 3, 40).select("entry_id", "pnl"), f"SELECT entry_id, pnl FROM {J} WHERE action = 'buy' ORDER BY pnl DESC NULLS LAST, entry_id LIMIT 40 OFFSET 80")
add("journal_page_fallback_sort", lambda s, d: journal.page(t.journal(s, d), "secret", SORTS, 1, 500).select("entry_id", "created_at"), f"SELECT entry_id, created_at FROM {J} ORDER BY created_at DESC, entry_id LIMIT 100")
add("journal_page_count", lambda s, d: journal.page_count(journal.closed(t.journal(s, d)), 50), f"SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM {J} WHERE exit_price IS NOT NULL")
add("journal_open", lambda s, d: journal.opened(t.journal(s, d)).select("entry_id", "user_id"), f"SELECT entry_id, user_id FROM {J} WHERE entry_price IS NOT NULL AND exit_price IS NULL")
add("journal_closed", lambda s, d: journal.closed(t.journal(s, d)).select("entry_id", "pnl"), f"SELECT entry_id, pnl FROM {J} WHERE exit_price IS NOT NULL")
add("journal_unreviewed", lambda s, d: journal.unreviewed(t.journal(s, d)).select("entry_id"), f"SELECT entry_id FROM {J} WHERE exit_price IS NOT NULL AND reviewed_at IS NULL")
add("journal_tagged", lambda s, d: journal.tagged(t.journal(s, d), "1-URGENT").select("entry_id"), f"SELECT entry_id FROM {J} WHERE list_contains(tags, '1-URGENT')")
add("journal_enum_guard", lambda s, d: journal.one_of(t.journal(s, d), "action", "nonsense", ["buy", "sell", "hold"]).select("entry_id"), f"SELECT entry_id FROM {J}")
add("journal_between", lambda s, d: journal.since(t.journal(s, d), 800_000_000_000, 860_000_000_000).select("entry_id"), f"SELECT entry_id FROM {J} WHERE created_at BETWEEN 800000000000 AND 860000000000")
add("notes_search", lambda s, d: journal.titled(t.read(s, d, "part"), "p_name", "ReD").select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red')")
add("journal_outcome", lambda s, d: t.journal(s, d).select("entry_id", journal.outcome(F.col("action"), F.col("entry_price"), F.col("entry_price") + 10).alias("outcome")), f"SELECT entry_id, CASE WHEN action = 'sell' THEN -((entry_price + 10 - entry_price) / entry_price * 100) ELSE (entry_price + 10 - entry_price) / entry_price * 100 END AS outcome FROM {J}")
NOTED = {"symbol": "concat('S', user_id)", "interval": "'1h'", "signal_score": "pnl * 4", "notes": "CASE WHEN entry_id % 3 = 0 THEN concat('said \"', action, '\", once') WHEN entry_id % 3 = 1 THEN 'plain' END"}
CSV_FIELD = "CASE WHEN contains({0}, ',') OR contains({0}, '\"') OR contains({0}, chr(10)) THEN concat('\"', replace({0}, '\"', '\"\"'), '\"') ELSE coalesce({0}, '') END"


def fixed(x: str, n: int) -> str:
    """printf rounds the exact value, halves to even; halves are moved away from zero first."""
    return f"printf('%.{n}f', CASE WHEN abs({x}) * {2 ** (n + 1)} = floor(abs({x}) * {2 ** (n + 1)}) AND floor(abs({x}) * {2 ** (n + 1)}) % 2 = 1 THEN ({x}) + sign({x}) * 1e-{n + 1} ELSE ({x}) END)"


def plain(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-6 AND {x} <> 0 THEN regexp_replace(CAST({x} AS VARCHAR), 'e-0', 'e-') ELSE rtrim(rtrim(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,24)) AS VARCHAR), '0'), '.') END"


JOURNAL_FIELDS = ["strftime(make_timestamp(created_at * 1000), '%Y-%m-%d')", "symbol", "interval", "action", "CAST(CAST(floor(signal_score + 0.5) AS BIGINT) AS VARCHAR)", "signal_tier", plain("entry_price"), plain("exit_price"), fixed("pnl", 2), "setup_type", "market_condition", "array_to_string(tags, '; ')", "notes", "CASE WHEN reviewed_at IS NULL THEN 'No' ELSE 'Yes' END"]
JOURNAL_CSV = f"""SELECT CAST(NULL AS BIGINT) AS entry_id, '{export.JOURNAL_HEADER}' AS line UNION ALL
SELECT entry_id, concat({", ',', ".join(CSV_FIELD.format(f) for f in JOURNAL_FIELDS)}) AS line FROM (SELECT *, {", ".join(f"{e} AS {c}" for c, e in NOTED.items())} FROM {J})"""
add("journal_csv", lambda s, d: export.journal_csv(t.journal(s, d).withColumns({c: F.expr(e) for c, e in NOTED.items()})), JOURNAL_CSV)


#: Prices of coins, from tiny to huge, and gains that are halves of a cent in decimal or in binary.
EXTREME = NOTED | {"entry_price": "entry_price / (CASE WHEN entry_id % 2 = 0 THEN 1e10 ELSE 1e-2 END)", "exit_price": "CASE WHEN entry_id % 3 <> 0 THEN entry_price * 64 END", "pnl": "CASE WHEN entry_id % 4 = 0 THEN entry_id % 997 + 0.005 WHEN entry_id % 4 = 1 THEN (entry_id % 997) / 8 WHEN entry_id % 4 = 2 THEN -(entry_id % 997) / 1000 END"}
EXTREME |= {k: f"CAST({EXTREME[k]} AS DOUBLE)" for k in ("entry_price", "exit_price", "pnl")}
add("journal_csv_extremes", lambda s, d: export.journal_csv(t.journal(s, d).select("*", F.struct(*[F.expr(e).alias(c) for c, e in EXTREME.items()]).alias("x")).withColumns({c: F.col("x")[c] for c in EXTREME})), JOURNAL_CSV.split("FROM (SELECT *")[0] + f"FROM (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in EXTREME.items() if c not in NOTED)}), {', '.join(f'{e} AS {c}' for c, e in NOTED.items())} FROM {J})")


def _patterns(s, d):
    j = t.journal(s, d)
    months = j.where("pnl is not null").groupBy("user_id", F.date_format(scalars.utc("created_at"), "yyyy-MM").alias("month")).agg(F.sum(F.col("pnl").cast(t.EXACT)).cast("double").alias("pnl"), F.count("*").alias("trades"))
    return journal.patterns(journal.summary(j, ["user_id"]), months).select("user_id", F.explode("patterns").alias("pattern"))


add(
    "trading_patterns",
    _patterns,
    f"""WITH j AS {J}, s AS (SELECT user_id, {SUMMARY} FROM j GROUP BY user_id),
m AS (SELECT user_id, strftime(make_timestamp(created_at * 1000), '%Y-%m') AS month, CAST(sum({PNL}) AS DOUBLE) AS pnl, count(*) AS trades FROM j WHERE pnl IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month) - row_number() OVER (PARTITION BY user_id, pnl < 0 ORDER BY month) AS grp, avg(trades) OVER (PARTITION BY user_id) AS mean FROM m),
streak AS (SELECT user_id, max(c) AS streak FROM (SELECT user_id, count(*) AS c FROM g WHERE pnl < 0 GROUP BY user_id, grp) GROUP BY user_id),
a AS (SELECT user_id, count(*) AS n, count(*) FILTER (pnl > 0) * 100.0 / count(*) AS rate, any_value(mean) AS mean, min(pnl) FILTER (trades > mean * 2) AS worst FROM g GROUP BY user_id),
f AS (SELECT s.user_id, list_filter([
  CASE WHEN wins >= 5 AND win_rate >= 70 THEN 'Strong Win Rate' END, CASE WHEN losses >= 5 AND win_rate < 40 THEN 'Low Win Rate' END,
  CASE WHEN profit_factor >= 2 THEN 'High Profit Factor' WHEN profit_factor < 1 AND wins + losses >= 5 THEN 'Negative Expectancy' END,
  CASE WHEN n >= 3 AND rate >= 70 THEN 'Consistent Monthly Profits' END, CASE WHEN n >= 3 AND streak >= 3 THEN 'Losing Streak' END,
  CASE WHEN mean >= 3 AND worst < 0 THEN 'Possible Overtrading' END], lambda x: x IS NOT NULL) AS ps FROM s LEFT JOIN a USING (user_id) LEFT JOIN streak USING (user_id))
SELECT user_id, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE ['Insufficient Data'] END) AS pattern FROM f""",
)

HP = f"WITH h AS ({t.HOLDINGS_SQL}), p AS ({t.PRICES_SQL})"
EX = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(28,8))) AS DOUBLE)"
add(
    "valuation",
    lambda s, d: portfolio.valuation(t.holdings(s, d), t.prices(s, d)),
    f"{HP}, v AS (SELECT portfolio, {EX('quantity * price')} AS value, {EX('quantity * avg_price')} AS cost, count(*) AS holdings FROM h JOIN p USING (symbol) GROUP BY portfolio) SELECT *, value - cost AS pnl, CASE WHEN cost > 0 THEN (value - cost) / cost * 100 ELSE 0 END AS pnl_percent FROM v",
)
add(
    "holding_rows",
    lambda s, d: portfolio.valued(t.holdings(s, d), t.prices(s, d).where("symbol % 3 <> 0"), t.prices(s, d).withColumn("price", F.col("price") + 1)),
    f"""{HP}, v AS (SELECT portfolio, symbol, quantity, avg_price, CASE WHEN CAST(symbol AS INT) % 3 <> 0 THEN price ELSE price + 1 END AS price, quantity * avg_price AS cost FROM h LEFT JOIN p USING (symbol))
SELECT *, quantity * price AS value, quantity * price - cost AS pnl, CASE WHEN cost > 0 THEN (quantity * price - cost) / cost * 100 ELSE 0 END AS pnl_percent,
  coalesce(quantity * price / CAST(sum(CAST(quantity * price AS DECIMAL(28,8))) OVER (PARTITION BY portfolio) AS DOUBLE) * 100, 0) AS allocation FROM v""",
)
add(
    "change_24h",
    lambda s, d: portfolio.day_change(t.holdings(s, d), t.prices(s, d).withColumn("open", F.col("price") - F.col("symbol").cast("int") % 7)),
    f"{HP}, v AS (SELECT portfolio, {EX('quantity * price')} AS value, {EX('quantity * (price - CAST(symbol AS INT) % 7)')} AS before FROM h JOIN p USING (symbol) GROUP BY portfolio) SELECT portfolio, value, value - before AS change, CASE WHEN before > 0 THEN (value - before) / before * 100 ELSE 0 END AS change_percent FROM v",
)
add(
    "nested_holdings",
    lambda s, d: portfolio.flat(t.holdings(s, d).groupBy("portfolio").agg(F.collect_list(F.struct("symbol", "quantity", "avg_price")).alias("holdings"))),
    t.HOLDINGS_SQL,
)

ORDER = ["date", "seq"]
TX = f"tx AS ({t.TRANSACTIONS_SQL})"
add(
    "holding_state",
    lambda s, d: portfolio.holding_state(t.transactions(s, d), ORDER),
    f"""WITH RECURSIVE {TX}, r AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS a FROM (SELECT DISTINCT symbol FROM tx)
UNION ALL SELECT r.symbol, tx.seq, CASE WHEN tx.type = 'buy' THEN r.q + tx.quantity ELSE r.q - tx.quantity END,
  CASE WHEN tx.type = 'buy' THEN CASE WHEN r.q + tx.quantity > 0 THEN (r.q * r.a + tx.quantity * tx.price + tx.fee) / (r.q + tx.quantity) ELSE 0 END ELSE r.a END FROM r JOIN tx ON tx.symbol = r.symbol AND tx.seq = r.seq + 1)
SELECT symbol, greatest(0, arg_max(q, seq)) AS quantity, CASE WHEN arg_max(q, seq) > 0 THEN arg_max(a, seq) ELSE 0 END AS avg_price FROM r GROUP BY symbol""",
)
add(
    "holding_state_by_ranges",
    lambda s, d: portfolio.long_holding_state(t.transactions(s, d), ORDER).withColumn("avg_price", F.round("avg_price", 6)),
    SQL["holding_state"].replace("SELECT symbol, greatest(0, arg_max(q, seq)) AS quantity, CASE WHEN arg_max(q, seq) > 0 THEN arg_max(a, seq) ELSE 0 END AS avg_price", "SELECT symbol, greatest(0, arg_max(q, seq)) AS quantity, round(CASE WHEN arg_max(q, seq) > 0 THEN arg_max(a, seq) ELSE 0 END, 6) AS avg_price"),
)
#: Symbols stand side by side on one axis of quantity, so that lots and sales meet by their intervals alone.
FIFO = f"""WITH {TX}, c AS (SELECT *, sum(CASE WHEN type = 'buy' THEN quantity ELSE 0 END) OVER w AS b, sum(CASE WHEN type = 'buy' THEN 0 ELSE quantity END) OVER w AS s FROM tx WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
e AS (SELECT *, s - greatest(0, max(s - b) OVER (PARTITION BY symbol ORDER BY seq)) AS m FROM c), f AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY symbol ORDER BY seq), 0) AS m0 FROM e),
axis AS (SELECT symbol, sum(t) OVER (ORDER BY symbol) - t AS z FROM (SELECT symbol, max(b) + 1 AS t FROM f GROUP BY symbol)),
lot AS (SELECT f.symbol, CAST(seq AS INTEGER) AS buy_seq, date AS buy_date, z + b - quantity AS lo, z + b AS hi, price + fee / quantity AS unit_cost, quantity, z FROM f JOIN axis USING (symbol) WHERE type = 'buy'),
sale AS (SELECT f.symbol AS sold_symbol, CAST(seq AS INTEGER) AS sell_seq, date AS sell_date, z + m0 AS m0, z + m AS m, price, quantity AS sold, fee FROM f JOIN axis USING (symbol) WHERE type = 'sell' AND m > m0),
g AS (SELECT symbol, buy_seq, sell_seq, buy_date, sell_date, least(hi, m) - greatest(lo, m0) AS quantity, (least(hi, m) - greatest(lo, m0)) * price - (least(hi, m) - greatest(lo, m0)) / sold * fee AS proceeds, (least(hi, m) - greatest(lo, m0)) * unit_cost AS cost_basis
  FROM lot JOIN sale ON lo < m AND m0 < hi),
gains AS (SELECT *, proceeds - cost_basis AS gain, CASE WHEN sell_date - buy_date > 31536000000 THEN 'long-term' ELSE 'short-term' END AS holding_period FROM g),
opens AS (SELECT symbol, buy_seq, buy_date, quantity, unit_cost, least(quantity, hi - z - mm) AS remaining FROM lot JOIN (SELECT symbol, max(m) AS mm FROM f GROUP BY symbol) USING (symbol) WHERE least(quantity, hi - z - mm) > 0)"""
GAIN = ["symbol", "buy_seq", "sell_seq", "buy_date", "sell_date", "quantity", "proceeds", "cost_basis", "gain", "holding_period"]
add("gains_fifo", lambda s, d: lots.fifo_gains(t.transactions(s, d), ORDER), f"{FIFO} SELECT * FROM gains")
add("lots_fifo", lambda s, d: lots.fifo_open(t.transactions(s, d), ORDER), f"{FIFO} SELECT * FROM opens")


def _gains(method):
    return lambda s, d: lots.matches(t.transactions(s, d), ORDER, method).where("kind = 'gain'").select(*[F.col(c).cast("int") if c.endswith("_seq") else F.col(c) for c in GAIN])


add("gains_fifo_scan", _gains("fifo"), f"{FIFO} SELECT * FROM gains")


def _recursive_lots(pick: str) -> str:
    """Lots of a method by recursion over transactions: state is a list of lots, the one to use first at the end."""
    return f"""WITH RECURSIVE {TX}, k AS (SELECT symbol, max(seq) AS last FROM tx GROUP BY symbol),
r AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS rest, CAST([] AS STRUCT(c DOUBLE, s BIGINT, d BIGINT, q DOUBLE)[]) AS lots, CAST(NULL AS STRUCT(c DOUBLE, s BIGINT, d BIGINT, q DOUBLE)) AS used, CAST(0 AS DOUBLE) AS amount FROM k
UNION ALL SELECT r.symbol, CASE WHEN r.rest > 0 THEN r.seq ELSE tx.seq END, CASE WHEN r.rest > 0 THEN greatest(0, r.rest - r.lots[-1].q) WHEN tx.type = 'sell' AND len(r.lots) > 0 THEN tx.quantity ELSE 0 END
    * CASE WHEN r.rest > 0 AND len(r.lots) = 1 THEN 0 ELSE 1 END,
  CASE WHEN r.rest > 0 THEN CASE WHEN r.lots[-1].q > r.rest THEN list_append(r.lots[:-2], {{'c': r.lots[-1].c, 's': r.lots[-1].s, 'd': r.lots[-1].d, 'q': r.lots[-1].q - r.rest}}) ELSE r.lots[:-2] END
    WHEN tx.type = 'buy' THEN {pick} ELSE r.lots END,
  CASE WHEN r.rest > 0 THEN r.lots[-1] END, CASE WHEN r.rest > 0 THEN least(r.rest, r.lots[-1].q) END
  FROM r JOIN k USING (symbol) LEFT JOIN tx ON tx.symbol = r.symbol AND tx.seq = r.seq + 1 WHERE r.rest > 0 OR r.seq < k.last),
g AS (SELECT r.symbol, CAST(used.s AS INTEGER) AS buy_seq, CAST(r.seq AS INTEGER) AS sell_seq, used.d AS buy_date, tx.date AS sell_date, amount AS quantity, amount * tx.price - amount / tx.quantity * tx.fee AS proceeds, amount * used.c AS cost_basis FROM r JOIN tx ON tx.symbol = r.symbol AND tx.seq = r.seq WHERE used IS NOT NULL)
SELECT *, proceeds - cost_basis AS gain, CASE WHEN sell_date - buy_date > 31536000000 THEN 'long-term' ELSE 'short-term' END AS holding_period FROM g"""


_NEW = "{'c': tx.price + tx.fee / tx.quantity, 's': tx.seq, 'd': tx.date, 'q': tx.quantity}"
add("gains_lifo", _gains("lifo"), _recursive_lots(f"list_append(r.lots, {_NEW})"))
add("gains_hifo", _gains("hifo"), _recursive_lots(f"list_concat(list_append(list_filter(r.lots, lambda x: x.c < tx.price + tx.fee / tx.quantity), {_NEW}), list_filter(r.lots, lambda x: x.c >= tx.price + tx.fee / tx.quantity))"))
add(
    "cost_basis_rollup",
    lambda s, d: lots.rollup(lots.matches(t.transactions(s, d), ORDER, "fifo")),
    f"""{FIFO}, o AS (SELECT symbol, {EX("remaining")} AS total_quantity, {EX("remaining * unit_cost")} AS total_cost FROM opens GROUP BY symbol), x AS (SELECT symbol, {EX("gain")} AS total_realized_gain FROM gains GROUP BY symbol)
SELECT symbol, coalesce(total_quantity, 0) AS total_quantity, coalesce(total_cost, 0) AS total_cost, coalesce(total_realized_gain, 0) AS total_realized_gain, coalesce(total_cost / total_quantity, 0) AS average_cost FROM o FULL JOIN x USING (symbol)""",
)
add(
    "tax_csv_rows",
    lambda s, d: export.tax_rows(t.transactions(s, d), lots.fifo_gains(t.transactions(s, d), ORDER), 1996).drop("seq"),
    f"""{FIFO} SELECT date, 'buy' AS type, symbol, quantity, price, fee, CAST(NULL AS DOUBLE) AS proceeds, CAST(NULL AS DOUBLE) AS cost_basis, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS VARCHAR) AS holding_period FROM tx WHERE type = 'buy' AND year(make_timestamp(date * 1000)) = 1996
UNION ALL SELECT sell_date, 'sell', symbol, quantity, proceeds / quantity, 0, proceeds, cost_basis, gain, holding_period FROM gains WHERE year(make_timestamp(sell_date * 1000)) = 1996""",
)

def _line(*fields: str) -> str:
    return "concat(" + ", ',', ".join(CSV_FIELD.format(f"({f})") for f in fields) + ")"


QTY = f"CASE WHEN quantity < 1 THEN {fixed('quantity', 8)} ELSE {fixed('quantity', 4)} END"
DAY_TEXT, TIME_TEXT, ASSET = "strftime(make_timestamp(date * 1000), '%Y-%m-%d')", "strftime(make_timestamp(date * 1000), '%Y-%m-%d %H:%M:%S UTC')", "regexp_replace(symbol, 'USDT$', '')"
FEE, UNIT, GOT = f"CASE WHEN fee > 0 THEN {fixed('fee', 2)} END", "CASE WHEN fee > 0 THEN 'USD' END", fixed("coalesce(proceeds, quantity * price)", 2)
LINES = {
    "generic": _line(DAY_TEXT, "CASE WHEN type = 'buy' THEN 'Buy' ELSE 'Sell' END", ASSET, QTY, *[fixed(c, 2) for c in ("price", "fee", "proceeds", "cost_basis", "gain")], "CASE holding_period WHEN 'long-term' THEN 'Long-term' WHEN 'short-term' THEN 'Short-term' END"),
    "koinly": f"CASE WHEN type = 'buy' THEN {_line(TIME_TEXT, fixed('quantity * price + fee', 2), chr(39) + 'USD' + chr(39), QTY, ASSET, FEE, UNIT, chr(39) * 2)} ELSE {_line(TIME_TEXT, QTY, ASSET, GOT, chr(39) + 'USD' + chr(39), FEE, UNIT, chr(39) * 2)} END",
    "cointracker": f"CASE WHEN type = 'buy' THEN {_line(DAY_TEXT, chr(39) + 'Buy' + chr(39), QTY, ASSET, fixed('quantity * price', 2), chr(39) + 'USD' + chr(39), FEE, UNIT)} ELSE {_line(DAY_TEXT, chr(39) + 'Sell' + chr(39), GOT, chr(39) + 'USD' + chr(39), QTY, ASSET, FEE, UNIT)} END",
}
for _dialect in LINES:
    add(
        f"tax_csv_{_dialect}",
        lambda s, d, x=_dialect: export.tax_csv(export.tax_rows(t.transactions(s, d), lots.fifo_gains(t.transactions(s, d), ORDER)), x).select("date", "symbol", "line"),
        f"""{FIFO}, ro AS (SELECT date, 'buy' AS type, symbol, quantity, price, fee, CAST(NULL AS DOUBLE) AS proceeds, CAST(NULL AS DOUBLE) AS cost_basis, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS VARCHAR) AS holding_period FROM tx WHERE type = 'buy'
UNION ALL SELECT sell_date, 'sell', symbol, quantity, proceeds / quantity, 0, proceeds, cost_basis, gain, holding_period FROM gains)
SELECT CAST(NULL AS BIGINT) AS date, CAST(NULL AS VARCHAR) AS symbol, '{export.HEADERS[_dialect]}' AS line UNION ALL SELECT date, symbol, {LINES[_dialect]} FROM ro""",
    )

SN = f"v AS ({t.SNAPSHOTS_SQL})"
RET = f"{SN}, r AS (SELECT *, lag(total_value) OVER (PARTITION BY portfolio ORDER BY day) AS before FROM v), x AS (SELECT portfolio, day, total_value, CASE WHEN before <> 0 THEN (total_value - before) / before END AS ret FROM r)"
DD = ", p AS (SELECT *, max(total_value) OVER (PARTITION BY portfolio ORDER BY day) AS peak FROM x), q AS (SELECT *, CASE WHEN peak > 0 THEN (total_value - peak) / peak ELSE 0 END AS drawdown FROM p)"
add("daily_returns", lambda s, d: portfolio.returns(t.snapshots(s, d)), f"WITH {RET} SELECT * FROM x")
add("drawdown_series", lambda s, d: portfolio.drawdowns(t.snapshots(s, d)), f"WITH {RET}{DD} SELECT portfolio, day, total_value, peak, drawdown FROM q")
R12 = lambda x: f"CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30,12))) AS DOUBLE)"
add(
    "risk_metrics",
    lambda s, d: portfolio.risk(t.snapshots(s, d)),
    f"""WITH {RET}{DD}, a AS (SELECT portfolio, count(*) AS points, count(ret) AS n, min(day) AS d0, max(day) AS d1, arg_min(total_value, day) AS v0, arg_max(total_value, day) AS v1, {R12("ret")} AS s, {R12("ret * ret")} AS ss,
  CAST(sum(CAST(CAST(ret * ret AS VARCHAR) AS DECIMAL(30,12))) FILTER (ret < 0) AS DOUBLE) AS down, count(*) FILTER (ret < 0) AS losses, max(ret) AS best_return, min(ret) AS worst_return,
  arg_max(day, (ret, -day)) FILTER (ret IS NOT NULL) AS best_day, arg_min(day, (ret, day)) FILTER (ret IS NOT NULL) AS worst_day, min(drawdown) AS dd, arg_min(day, (drawdown, day)) AS dd_day FROM q GROUP BY portfolio),
b AS (SELECT *, CASE WHEN v0 > 0 THEN (v1 - v0) / v0 END AS total_return FROM a WHERE points >= 2 AND n >= 1),
c AS (SELECT *, CASE WHEN d1 > d0 THEN pow(1 + total_return, CAST(365 AS DOUBLE) / ((d1 - d0) / 86400000e0)) - 1 END AS annualized_return, sqrt(greatest(ss - s * s / n, 0) / nullif(n - 1, 0)) * sqrt(365e0) AS annualized_volatility FROM b)
SELECT portfolio, points, best_return, worst_return, best_day, worst_day, total_return, annualized_return, annualized_volatility, CASE WHEN points >= 7 THEN dd END AS max_drawdown, CASE WHEN points >= 7 THEN dd_day END AS max_drawdown_day,
  CASE WHEN n >= 30 AND annualized_volatility > 0 THEN (annualized_return - 0.05e0) / annualized_volatility END AS sharpe,
  CASE WHEN n >= 30 AND annualized_volatility > 0 AND losses > 0 THEN (annualized_return - 0.05e0) / (sqrt(down / losses) * sqrt(365e0)) END AS sortino FROM c""",
)
add("period_return", lambda s, d: portfolio.period_return(t.snapshots(s, d)), f'WITH {SN}, a AS (SELECT portfolio, arg_min(total_value, day) AS "first", arg_max(total_value, day) AS "last" FROM v GROUP BY portfolio) SELECT *, CASE WHEN "first" > 0 THEN ("last" - "first") / "first" * 100 END AS period_return FROM a')


def _snapshot_upsert(s, d):
    from barquet.operators.bars import upsert

    old = t.snapshots(s, d)
    new = old.where("day % 172800000 = 0").withColumn("total_value", F.col("total_value") * 2)
    return upsert(old, new, ["portfolio", "day"])


add("snapshot_upsert", _snapshot_upsert, f"WITH {SN} SELECT portfolio, day, CASE WHEN day % 172800000 = 0 THEN total_value * 2 ELSE total_value END AS total_value FROM v")
add(
    "scalar_text",
    lambda s, d: t.read(s, d, "part").select(
        "p_partkey",
        scalars.strip_quote(F.concat("p_brand", F.lit("USDT"))).alias("asset"),
        scalars.csv_escape("p_name").alias("escaped"),
        scalars.first_number(F.concat(F.lit("RSI "), F.col("p_size").cast("string"), F.lit(".5 now"))).alias("number"),
        scalars.spaced(F.regexp_replace("p_type", " ", "_")).alias("spaced"),
        scalars.is_quoted_in(F.concat("p_brand", F.lit("USDT"))).alias("quoted"),
        scalars.magnitude_unit(F.col("p_retailprice") * 1000).alias("unit"),
    ),
    """SELECT p_partkey, p_brand AS asset, CASE WHEN regexp_matches(p_name, '[,"\n]') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END AS escaped, CAST(p_size AS DOUBLE) + 0.5 AS number, p_type AS spaced, TRUE AS quoted,
  CASE WHEN p_retailprice * 1000 >= 1e9 THEN 'B' WHEN p_retailprice * 1000 >= 1e6 THEN 'M' WHEN p_retailprice * 1000 >= 1e3 THEN 'K' ELSE '' END AS unit FROM part""",
)
add("scalar_bands", lambda s, d: t.read(s, d, "part").select("p_partkey", scalars.fear_greed_band(F.col("p_size") * 2).alias("band"), scalars.days_between(F.lit(0), F.col("p_partkey") * 43_200_000).alias("days")), "SELECT p_partkey, CASE WHEN p_size * 2 <= 20 THEN 'extreme_fear' WHEN p_size * 2 <= 40 THEN 'fear' WHEN p_size * 2 <= 60 THEN 'neutral' WHEN p_size * 2 <= 80 THEN 'greed' ELSE 'extreme_greed' END AS band, p_partkey / 2 AS days FROM part")
add("scalar_sparkline", lambda s, d: scalars.sparkline(t.snapshots(s, d), "portfolio", "total_value"), f"WITH {SN} SELECT *, (total_value - least(-10, min(total_value) OVER (PARTITION BY portfolio))) / (greatest(10, max(total_value) OVER (PARTITION BY portfolio)) - least(-10, min(total_value) OVER (PARTITION BY portfolio))) AS scaled FROM v")
#: Numbers of all sizes: whole eighths and 512ths, which are ties in binary, thousandths that end in 5, tiny and huge ones.
NUMBERS = "CAST(CASE p_partkey % 6 WHEN 0 THEN p_partkey / 8e0 WHEN 1 THEN p_partkey / 512e0 WHEN 2 THEN p_partkey / 1000e0 + 0.005e0 WHEN 3 THEN -p_partkey / 1e7 WHEN 4 THEN p_partkey * 1.7e9 ELSE p_retailprice END AS DOUBLE)"
add(
    "scalar_numbers",
    lambda s, d: t.read(s, d, "part").withColumn("x", F.expr(NUMBERS)).select("p_partkey", *[scalars.fixed("x", n).alias(f"fixed_{n}") for n in (0, 2, 4, 6, 8)], scalars.quantity_text("x").alias("quantity"), scalars.price_text("x").alias("price"), scalars.ratio_text("x").alias("ratio"), scalars.magnitude_text("x").alias("magnitude"), scalars.number_text("x").alias("number")),
    f"""WITH v AS (SELECT p_partkey, {NUMBERS} AS x FROM part), y AS (SELECT *, CASE WHEN x >= 1e9 THEN x / 1e9 WHEN x >= 1e6 THEN x / 1e6 WHEN x >= 1e3 THEN x / 1e3 ELSE x END AS z FROM v)
SELECT p_partkey, {", ".join(f"{fixed('x', n)} AS fixed_{n}" for n in (0, 2, 4, 6, 8))}, CASE WHEN x < 1 THEN {fixed("x", 8)} ELSE {fixed("x", 4)} END AS quantity, CASE WHEN x >= 1000 THEN {fixed("x", 2)} WHEN x >= 1 THEN {fixed("x", 4)} ELSE {fixed("x", 6)} END AS price, {fixed("x", 2)} AS ratio,
  concat({fixed("z", 2)}, CASE WHEN x >= 1e9 THEN 'B' WHEN x >= 1e6 THEN 'M' WHEN x >= 1e3 THEN 'K' ELSE '' END) AS magnitude, {plain("x")} AS number FROM y""",
)
add("scalar_days", lambda s, d: t.read(s, d, "events").select("event_id", scalars.midnight(t.epoch_ms("ts")).alias("day"), scalars.midnight(t.epoch_ms("ts"), 30).alias("month_before")), "SELECT event_id, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS day, (epoch_us(ts) // 1000) // 86400000 * 86400000 - 2592000000 AS month_before FROM events")
add("scalar_futures_bands", lambda s, d: t.read(s, d, "part").select("p_partkey", scalars.funding_band((F.col("p_size") - 25) / 1e4).alias("funding"), scalars.long_short_band(F.col("p_size") / 25).alias("long_short")), "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'positive' WHEN p_size < 25 THEN 'negative' ELSE 'flat' END AS funding, CASE WHEN p_size > 25 THEN 'long' WHEN p_size < 25 THEN 'short' ELSE 'even' END AS long_short FROM part")

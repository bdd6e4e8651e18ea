"""Weight search: candidates, walk-forward windows, robustness, ensembles, template versions, activation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.config import CATEGORIES, ROBUST, WALK_FORWARD, Backtest
from barquet.operators import backtest, search
from barquet.operators.checkpoints import kept
from barquet.operators.scan import ordered_scan

T = TypeVar("T")
RESULT_KEYS = ["run_id", "symbol", "interval"]


def uniform(seed: int) -> Iterator[float]:
    """Numbers from 0 to 1 by the linear congruential rule x -> 1664525 x + 1013904223 modulo 2**32."""
    while True:
        seed = (seed * 1664525 + 1013904223) % 2**32
        yield seed / 2**32


def candidates(base: dict[str, float], count: int = WALK_FORWARD["candidates"], constraint: float = WALK_FORWARD["constraint"], seed: int = 42) -> list[dict[str, float]]:
    """``base`` and count - 1 weightings drawn within ``constraint`` of it, each with sum 1."""
    draws, out = uniform(seed), [dict(base)]
    while len(out) < count:
        raw = {}
        for c in CATEGORIES:
            low, high = base[c] * (1 - constraint), base[c] * (1 + constraint)
            raw[c] = low + next(draws) * (high - low)
        total = 0.0
        for c in CATEGORIES:
            total += raw[c]
        out.append({c: raw[c] / total for c in CATEGORIES})
    return out[:count]


def as_runs(spark: SparkSession, weights: list[dict[str, float]], prefix: str = "c") -> DataFrame:
    """run_id, place and a column per category."""
    rows = [(f"{prefix}{i}", i, *(w[c] for c in CATEGORIES)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "run_id string, place int, " + ", ".join(f"{c} double" for c in CATEGORIES))


def valid(tolerance: float = 1e-10) -> Column:
    """Whether a row's weights are none below zero and sum to 1."""
    total, positive = F.lit(0.0), F.lit(True)
    for c in CATEGORIES:
        total, positive = total + F.col(c), positive & (F.col(c) >= 0)
    return positive & (F.abs(total - 1) < tolerance)


def windows(series: DataFrame, train: int = WALK_FORWARD["train"], test: int = WALK_FORWARD["test"], step: int = WALK_FORWARD["step"]) -> DataFrame:
    """Windows of each series (keys and bars, its number of bars), anchored at its start: window, train_start, train_end, test_start, test_end, from 0 and inclusive."""
    last = F.floor((F.col("bars") - test - train) / F.lit(step))
    rows = series.where(F.col("bars") >= train + test).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    end = F.lit(train - 1) + F.col("window") * step
    rows = rows.withColumns({"train_start": F.lit(0).cast("long"), "train_end": end, "test_start": end + 1})
    return rows.withColumn("test_end", F.least(F.col("test_start") + test - 1, F.col("bars") - 1))


def robust(sharpe: Column, win_rate: Column, drawdown: Column, trades: Column, limits: dict = ROBUST) -> Column:
    """Missing figures count as the worst; the drawdown is a fraction."""
    enough = (trades >= limits["min_trades"]) & (F.coalesce(sharpe, F.lit(float("-inf"))) >= limits["min_sharpe"])
    return enough & (F.coalesce(win_rate, F.lit(0.0)) >= limits["min_win_rate"]) & (F.abs(F.coalesce(drawdown, F.lit(float("inf")))) <= limits["max_drawdown"])


def robustness(sharpe: Column, win_rate: Column, drawdown: Column, trades: Column, limits: dict = ROBUST) -> Column:
    """From 0 to 1: four parts Sharpe, three win rate, two drawdown, one number of trades; 0 if not robust."""
    one = F.lit(1.0)
    parts = F.least(sharpe / 2, one) * 0.4 + win_rate * 0.3 + (1 - F.least(F.abs(drawdown) / limits["max_drawdown"], one)) * 0.2 + F.least(trades / F.lit(50.0), one) * 0.1
    return F.when(robust(sharpe, win_rate, drawdown, trades, limits), parts).otherwise(0.0)


def top(results: DataFrame, n: int, metric: str = "sharpe_ratio", tie: str = "run_id") -> DataFrame:
    """The n results with the highest metric; a missing one is the lowest."""
    return results.orderBy(F.desc_nulls_last(metric), tie).limit(n)


def _means() -> list[Column]:
    """Mean weights and figures. Means are taken over decimals of fourteen places."""
    mean = lambda c: (F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(32,14)")).cast("double") / F.count("*")).alias(c)
    return [F.count("*").alias("contributors"), *[mean(c) for c in (*CATEGORIES, "sharpe_ratio", "win_rate", "sortino_ratio")]]


def ensemble(results: DataFrame, n: int = 5, metric: str = "sharpe_ratio") -> DataFrame:
    """Mean weights and figures of the n best results: one row."""
    return top(results, n, metric).agg(*_means())


def ensembles(results: DataFrame, by: list[str], n: int = 5, metric: str = "sharpe_ratio", tie: str = "window") -> DataFrame:
    """A row per key: mean weights and figures of its n best results, as at the end of a walk-forward search the n windows that tested best."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(metric), tie))
    return results.withColumn("_r", rank).where(F.col("_r") <= n).groupBy(*by).agg(*_means())


def activation(proposed: DataFrame, active: DataFrame, min_backtests: int = 5, min_gain: float = 10.0) -> DataFrame:
    """For each style's proposed template (style, avg_sharpe, total_backtests) whether it replaces the active one (style, avg_sharpe), and why.

    improvement is in percent; 100 where nothing valid is active.
    """
    j = proposed.join(active.select("style", F.col("avg_sharpe").alias("_now"), F.lit(True).alias("_has")), "style", "left")
    new, now = F.col("avg_sharpe"), F.coalesce("_now", F.lit(0.0))
    gain = F.try_divide(new - now, now) * 100
    no_metrics, invalid = new.isNull(), F.isnan(new) | (new <= 0)
    few, fresh, broken = F.coalesce("total_backtests", F.lit(0)) < min_backtests, F.col("_has").isNull(), F.isnan(now) | (now <= 0)
    reason = (
        F.when(no_metrics, "missing metrics").when(invalid, "invalid Sharpe").when(few, "few backtests").when(fresh, "first version").when(broken, "replaces invalid")
        .when(gain >= min_gain, "improved").otherwise("not improved")
    )
    out = j.withColumn("reason", reason)
    yes = F.col("reason").isin("first version", "replaces invalid", "improved")
    improvement = F.when(F.col("reason").isin("first version", "replaces invalid"), 100.0).when(F.col("reason").isin("improved", "not improved"), gain).otherwise(0.0)
    return out.select("style", "reason", yes.alias("activate"), improvement.alias("improvement"))


def next_versions(templates: DataFrame) -> DataFrame:
    """style and version: the highest so far and one more."""
    return templates.groupBy("style").agg((F.max("version") + 1).alias("version"))


def activate(templates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Templates (style, version, active) with the chosen version of a style its only active one; other styles stay."""
    j = templates.join(chosen.select("style", F.col("version").alias("_v")), "style", "left")
    return j.withColumn("active", F.when(F.col("_v").isNull(), F.col("active")).otherwise(F.col("version") == F.col("_v"))).drop("_v")


def progress(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs (job_id, done, total, started_at in ms) with percent and eta_ms, the time left at the speed so far; null before the first."""
    elapsed = F.lit(now) - F.col("started_at")
    percent = F.floor(F.coalesce(F.try_divide(F.col("done") * 100.0, F.col("total").cast("double")), F.lit(0.0)) + 0.5).cast("int")
    eta = F.when(F.col("done") > 0, (elapsed / F.col("done") * (F.col("total") - F.col("done"))).cast("long"))
    return jobs.withColumns({"percent": percent, "eta_ms": eta})


def _placed(bars: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Bars with _at, their place in the series from 0, and _windows, the number of its windows; of series without one no bar."""
    w = W.partitionBy("symbol", "interval")
    out = bars.withColumns({"_at": F.row_number().over(w.orderBy("n")) - 1, "_windows": F.floor((F.count("*").over(w) - test - train) / F.lit(step)) + 1})
    return out.where("_windows > 0")


def training(bars: DataFrame, base: dict[str, float], rules: Backtest = Backtest(), count: int = WALK_FORWARD["candidates"], train: int = WALK_FORWARD["train"], test: int = WALK_FORWARD["test"], step: int = WALK_FORWARD["step"], constraint: float = WALK_FORWARD["constraint"], windows_a_task: int = 20) -> DataFrame:
    """Figures of every candidate on the training bars of every window: symbol, interval, window, place, weights, FIGURES of ``search``.

    bars and windows as in ``walk_forward``. A bar is repeated for each group of ``windows_a_task`` windows that it is in, not for
    candidates: each group is one pass over its bars with arrays over windows and candidates.
    """
    keys = ["symbol", "interval"]
    draw = lambda window: candidates(base, count, constraint, 42 + window)
    groups = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_windows") - 1) / F.lit(windows_a_task)))
    rows = _placed(bars, train, test, step).withColumn("_group", F.explode(groups))
    last = F.least((F.col("_group") + 1) * windows_a_task, F.col("_windows")) - 1
    rows = rows.where(F.col("_at") <= F.lit(train - 1) + last * step)
    columns = ["_at", "_windows", "high", "low", "close", *[f"score_{c}" for c in CATEGORIES[:4]]]
    return ordered_scan(rows, [*keys, "_group"], ["_at"], columns, lambda s, i, g: search.Training(g, windows_a_task, draw, rules, train, step), search.OUT).drop("_group")


def walk_forward(bars: DataFrame, base: dict[str, float], rules: Backtest = Backtest(), count: int = WALK_FORWARD["candidates"], train: int = WALK_FORWARD["train"], test: int = WALK_FORWARD["test"], step: int = WALK_FORWARD["step"], limits: dict = ROBUST, constraint: float = WALK_FORWARD["constraint"]) -> DataFrame:
    """The best robust candidate of each series and window, and its figures on the bars that follow.

    bars: scored bars (symbol, interval, n from 1, prices, score_*) after their warm-up, so that indicators know the whole past
    and a test window needs no warm-up of its own. Windows count the bars given; their training begins with the series. Each window has its own candidates;
    ties go to the first candidate. Windows without a robust candidate are left out.
    Returns window, symbol, interval, candidate, weights, train_sharpe, test_sharpe_ratio and others.
    """
    keys = ["symbol", "interval"]
    found = training(bars, base, rules, count, train, test, step, constraint)
    ok = robust(F.col("sharpe_ratio"), F.col("win_rate"), F.col("max_drawdown_percent") / 100, F.col("total_trades"), limits)
    best = found.where(ok).withColumn("_r", F.row_number().over(W.partitionBy(*keys, "window").orderBy(F.desc("sharpe_ratio"), "place"))).where("_r = 1")
    best = best.select(F.concat_ws(":", "window", "place").alias("run_id"), *keys, "window", "place", *CATEGORIES, F.col("sharpe_ratio").alias("train_sharpe"))
    # A bar knows which windows test on it, so that bars and winners meet by window.
    into = F.col("_at") - train
    low, high = F.greatest(F.lit(0).cast("long"), F.ceil((into - test + 1) / F.lit(step))), F.least(F.floor(into / F.lit(step)), F.col("_windows") - 1)
    rows = _placed(bars, train, test, step).where(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    rows = rows.join(best.select("run_id", *keys, "window", *CATEGORIES[:4]), [*keys, "window"])
    rows = backtest.scored(rows)
    events = backtest.run(rows, rules)
    tested = backtest.metrics(backtest.trades(events), backtest.equity(events), rules.start_equity).select(*RESULT_KEYS, "sharpe_ratio", "sortino_ratio", "win_rate", "total_trades", "total_pnl")
    return best.join(tested, RESULT_KEYS).withColumnRenamed("place", "candidate")


def same_weights(left: DataFrame, right: DataFrame, keys: list[str] | None = None, places: int = 12, pairs_a_task: int = 1 << 20) -> DataFrame:
    """Rows of ``left`` with those of ``right`` (renamed with _right) that have the same keys and weights, which is how results find their candidate where they carry no id.

    Weights are equal if they are when rounded to ``places``; so 0.1 + 0.2 is 0.3, and -0.0 is 0.0. NaN and null equal
    themselves only. Two rows with the same weights each meet each partner: keys tell them apart, such as a window. Pairs of a group are
    counted first, and where there are more than ``pairs_a_task`` it is cut into pieces: a row of ``left``, by a hash of it, is in one, a row of ``right`` in each.
    """
    keys = keys or []
    named = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns})

    def weighed(df: DataFrame, side: str) -> DataFrame:
        """With _w, the weights as text that is never null, and _k0 and so on, the keys."""
        weight = lambda c: F.when(F.isnan(F.col(c + side)), F.lit(float("nan"))).otherwise(F.round(F.col(c + side), places) + 0.0)
        return df.withColumns({"_w": F.to_json(F.struct(*[weight(c).alias(c) for c in CATEGORIES]))} | {f"_k{i}": F.col(k + side) for i, k in enumerate(keys)})

    left, named, by = weighed(left, ""), weighed(named, "_right"), ["_w", *[f"_k{i}" for i in range(len(keys))]]
    same = lambda a, b: [a["_w"] == b["_w"], *[a[k].eqNullSafe(b[k]) for k in by[1:]]]
    n, m = left.groupBy(*by).agg(F.count("*").alias("_n")), named.groupBy(*by).agg(F.count("*").alias("_m"))
    sizes = kept(n.join(m, same(n, m)).select(*[n[k] for k in by], (F.col("_n") * F.col("_m")).alias("_pairs")))
    tasks = int(sizes.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]) // pairs_a_task + 1
    cuts = sizes.where(F.col("_pairs") > pairs_a_task).select(*by, F.ceil(F.col("_pairs") / pairs_a_task).alias("_cuts"))  # no more rows than tasks

    def cut(df: DataFrame, piece: Callable[[Column], Column]) -> DataFrame:
        found = df.join(F.broadcast(cuts), same(df, cuts), "left").select(*[df[c] for c in df.columns], piece(F.coalesce("_cuts", F.lit(1).cast("long"))).alias("_piece"))
        return found.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_w", "_piece")

    own = [c for c, kind in left.dtypes if "map<" not in kind]  # maps have no hash
    left = cut(left, lambda x: F.pmod(F.xxhash64(*[left[c] for c in own]), x))
    named = cut(named, lambda x: F.explode(F.sequence(F.lit(0).cast("long"), x - 1)))
    pairs = left.join(named, [*same(left, named), left["_piece"] == named["_piece"]])
    return pairs.select(*[left[c] for c in left.columns if c not in (*by, "_piece")], *[named[c] for c in named.columns if c not in (*by, "_piece")])


def round_robin(styles: list[str], symbols: DataFrame) -> DataFrame:
    """style and symbol: the symbols (symbol, place from 0) dealt to the styles in turn, each style the one at its own place, beginning anew after the last."""
    n = symbols.agg(F.count("*").alias("n"))
    rows = symbols.sparkSession.createDataFrame(list(enumerate(styles)), "at long, style string").join(F.broadcast(n)).where("n > 0")  # one row
    return rows.join(symbols, F.col("at") % F.col("n") == F.col("place")).select("style", "symbol")


def isolated(tasks: dict[str, Callable[[], T]]) -> tuple[dict[str, T], dict[str, str]]:
    """Runs jobs one after another; what fails is reported by name and doesn't stop the others."""
    done, failed = {}, {}
    for name, task in tasks.items():
        try:
            done[name] = task()
        except Exception as e:  # the caller gets them all
            failed[name] = str(e)
    return done, failed

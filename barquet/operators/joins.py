"""Joins of series and tasks: tolerance, snapshots, task products, latest rows, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, order: list[str]) -> DataFrame:
    """``left`` and match: the first row of ``right`` by ``order`` whose ts is less than ``tolerance`` away; null without one.

    Both have the keys and ts. Times are cut into buckets of the tolerance, and a left row meets the three buckets around its own, so
    that the join is an equi-join whatever the lengths of the series. Repeated left rows give one row.
    """
    names = [c for c in right.columns if c not in keys]
    lid = [F.col(f"l.{c}") for c in [*keys, "ts"]]
    near = left.select(*keys, "ts").distinct().withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("ts") / tolerance) + i)))
    found = near.alias("l").join(right.withColumn("_b", F.floor(F.col("ts") / tolerance)).alias("r"), [*[F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], F.col("l._b") == F.col("r._b")])
    found = found.where(F.abs(F.col("l.ts") - F.col("r.ts")) < tolerance)
    first = found.groupBy(*lid).agg(F.min_by(F.struct(*[F.col(f"r.{c}") for c in names]), F.struct(*[F.col(f"r.{c}") for c in order])).alias("match"))
    return left.join(first, [*keys, "ts"], "left")


def merged(base: DataFrame, keys: list[str], **series: DataFrame) -> DataFrame:
    """``base`` and a struct for each named series with equal keys; null where it has no row. A series should have one row per key."""
    for name, df in series.items():
        base = base.join(df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name)), keys, "left")
    return base


def tasks(symbols: DataFrame, styles: dict[str, tuple[str, ...]], limit: int | None = None) -> DataFrame:
    """A row per symbol, style and interval of the style; the first ``limit`` in the order of symbols, styles and intervals."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("style"), F.lit(x).alias("interval")) for i, (s, x) in enumerate((s, x) for s, xs in styles.items() for x in xs)])
    out = symbols.select("symbol", F.explode(pairs).alias("p")).select("symbol", "p.*")
    return (out if limit is None else out.orderBy("symbol", "place").limit(limit)).drop("place")


def unchanged_out(task_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that ``done`` doesn't hold with the same keys, the time of the newest bar among them."""
    return task_rows.join(done.select(*keys), keys, "left_anti")


def newest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The row of each key that is largest in ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def ranked_first(rows: DataFrame, keys: list[str], *order, n: int = 1) -> DataFrame:
    """The first n rows of each key, by window."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def weights_of(task_rows: DataFrame, templates: DataFrame, default: dict[str, float]) -> DataFrame:
    """Tasks with the weights of their style's active template, or ``default``."""
    active = templates.where("active").select("style", *[F.col(c).alias(f"_{c}") for c in default])
    out = task_rows.join(active, "style", "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit(v)) for c, v in default.items()}).drop(*[f"_{c}" for c in default])


def fan_out(computed: DataFrame, subscriptions: DataFrame, keys: list[str]) -> DataFrame:
    """What was computed once per pair, for each subscriber of the pair."""
    return subscriptions.join(computed, keys)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def in_list(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are listed."""
    return rows.join(listed.select(*keys), keys, "left_semi")


def top_by(rows: DataFrame, measure: str, n: int, suffix: str = "") -> DataFrame:
    """The n symbols with the largest measure that end in ``suffix``; NaN and null take no part, ties go by name."""
    return rows.where(F.endswith("symbol", F.lit(suffix)) & F.col(measure).isNotNull() & ~F.isnan(measure)).orderBy(F.desc(measure), "symbol").limit(n)


def live(signals: DataFrame, ttl_days: dict[str, int], now: int) -> DataFrame:
    """Signals (style, ts in ms) that have not expired; of an unknown style none has a time to live."""
    days = F.create_map(*[F.lit(x) for kv in ttl_days.items() for x in kv])[F.col("style")]
    return signals.where(F.col("ts") + days.cast("long") * 86_400_000 > now)


def stats(rows: DataFrame, key: str) -> DataFrame:
    """One row: total, oldest and newest ts, and counts, a map with an entry per key."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.min("a").alias("oldest"), F.max("z").alias("newest"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def filled(rows: DataFrame, known: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    """Rows with the known value of their keys, else the default."""
    return rows.join(known.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))

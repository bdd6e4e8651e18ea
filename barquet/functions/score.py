"""Composite scores: signals to category scores, category scores to one score, its tier and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.config import CATEGORIES, DEFAULT_WEIGHTS
from barquet.functions import interpret
from barquet.functions.interpret import clamp


def multiplier(direction: Column) -> Column:
    return F.when(direction == "bullish", 1.0).when(direction == "bearish", -1.0).otherwise(0.0)


def category_score(signals: Column) -> Column:
    """Mean of signed strengths; 0 of none."""
    total = F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + multiplier(s["direction"]) * s["strength"])
    return F.coalesce(F.try_divide(total, F.size(signals).cast("double")), F.lit(0.0))


def tier(score: Column) -> Column:
    return F.when(score > 60, "strong_buy").when(score > 30, "buy").when(score < -60, "strong_sell").when(score < -30, "sell").otherwise("neutral")


def confidence(has_futures: Column, has_sentiment: Column, weights: dict[str, float]) -> Column:
    """100 less the weights, in percent, of what is missing; halves are rounded up."""
    missing = F.when(has_futures, 0.0).otherwise(weights["futures"] * 100) + F.when(has_sentiment, 0.0).otherwise(weights["sentiment"] * 100)
    return F.greatest(F.lit(0), F.floor(100 - missing + 0.5)).cast("int")


def composite(suites: DataFrame, weights: dict[str, float] | None = None, live: bool = False, funding: Column | None = None, long_short: Column | None = None, fear_greed: Column | None = None, futures_given: bool = False, skip_ichimoku: bool = False) -> DataFrame:
    """``suites`` and signals_* (arrays), score_* (by category), score, tier, confidence.

    Weights of categories without signals are shared out among the others. Futures and sentiment come as
    columns of ``suites``. ``futures_given``: confidence counts futures data as there even where both figures
    are null, as live scores do.
    """
    weights = weights or DEFAULT_WEIGHTS
    null = F.lit(None).cast("double")
    futures = F.array_compact(F.array(interpret.funding(null if funding is None else funding), interpret.long_short(null if long_short is None else long_short)))
    mood = F.array_compact(F.array(interpret.fear_greed(null if fear_greed is None else fear_greed)))
    out = suites.withColumns({f"signals_{c}": s for c, s in (interpret.by_category(live, skip_ichimoku) | {"futures": futures, "sentiment": mood}).items()})
    out = out.withColumns({f"score_{c}": category_score(F.col(f"signals_{c}")) for c in CATEGORIES})
    has = {c: F.size(f"signals_{c}") > 0 for c in CATEGORIES}
    available = sum((F.when(has[c], weights[c]).otherwise(0.0) for c in CATEGORIES), F.lit(0.0))
    total = sum((F.when(has[c], F.col(f"score_{c}") * F.try_divide(F.lit(weights[c]), available)).otherwise(0.0) for c in CATEGORIES), F.lit(0.0))
    out = out.withColumn("score", clamp(F.coalesce(total, F.lit(0.0)), -100, 100))
    return out.withColumns({"tier": tier(F.col("score")), "confidence": confidence(F.lit(True) if futures_given else has["futures"], has["sentiment"], weights)})


def latest(scored: DataFrame) -> DataFrame:
    """The last bar of each series."""
    row = F.max_by(F.struct(*scored.columns), "ts").alias("row")
    return scored.groupBy("symbol", "interval").agg(row).select("row.*")

"""Sentiment of headlines by keywords. Keywords match anywhere, also within words, and count once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords and topics.
BULLISH = ("rally", "surge", "gain", "rise", "bull", "breakout", "adoption", "institutional", "etf approved", "upgrade", "partnership", "launch")
BEARISH = ("crash", "fall", "drop", "decline", "bear", "sell-off", "regulation", "ban", "hack", "scam", "fraud", "lawsuit", "investigation")
TOPICS = {
    "regulation": ("regulation", "sec", "government", "ban", "law"),
    "institutional": ("institutional", "etf", "fund", "investment"),
    "defi": ("defi", "decentralized", "dex", "yield"),
    "nft": ("nft", "opensea", "metaverse"),
    "security": ("hack", "security", "breach", "exploit"),
    "mining": ("mining", "hashrate", "difficulty"),
}


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def sentiment(title: Column, bullish: tuple[str, ...] = BULLISH, bearish: tuple[str, ...] = BEARISH) -> Column:
    """Three tenths for each bullish keyword less as much for each bearish one, between -1 and 1; null counts as no words."""
    text = F.lower(F.coalesce(title, F.lit("")))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (_hits(text, bullish) - _hits(text, bearish)) * 3 / F.lit(10.0)))


def topics(title: Column, known: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    text = F.lower(F.coalesce(title, F.lit("")))
    return F.array_compact(F.array(*[F.when(_hits(text, words) > 0, F.lit(t)) for t, words in known.items()]))


def summarize(news: DataFrame, by: list[str], bullish=BULLISH, bearish=BEARISH, known=TOPICS) -> DataFrame:
    """Headlines (title) by key: count, avg_sentiment, and the sorted set of topics, which has as many entries as ``known`` at most."""
    scored = news.withColumns({"_s": sentiment(F.col("title"), bullish, bearish), "_t": topics(F.col("title"), known)})
    counted = scored.groupBy(*by).agg(F.count("*").alias("count"), (F.sum(F.col("_s").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_sentiment"))
    found = scored.select(*by, F.explode("_t").alias("_t")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("_t")).alias("topics"))
    return counted.join(found, by, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def latest_headlines(news: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """The first n headlines of each key, newest first."""
    from barquet.operators.joins import ranked_first

    return ranked_first(news, by, F.desc("ts"), "title", n=n)

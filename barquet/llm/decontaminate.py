"""Benchmark decontamination: a prefix-filtered set join of benchmark windows and documents.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window),
and a window is the set of its word shingles. A document contains a window only if it has all of its
shingles, so the prefix that must be joined is one token: the window's rarest shingle, by counts over
all documents. Each occurrence of that token in a document fixes where the window would start; length
and position bounds drop starts outside the document, and the words of what is left are compared.

DataFrame functions only. Documents are never shuffled: tokens are exploded and joined in the
scan, and of each document only a small row and its true occurrences go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _token(all_words: str, at: str, size: int) -> str:
    """SQL for the hash of ``size`` words from the 0-based position ``at``; null beyond the end."""
    parts = ", ".join(f"get({all_words}, {at} + {i})" for i in range(size))
    return f"if({at} + {size} <= size({all_words}), xxhash64({size}, {parts}), null)"


def _windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct windows: item_words, ids of items that hold it, whether an item without an id does (unnamed), its length and the size of its shingles."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    w = w.select("item_id", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")).alias("at"))
    w = w.select("item_id", F.expr(f"slice(w, at + 1, {window})").alias("item_words"))
    w = w.groupBy("item_words").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    return w.withColumn("len", F.size("item_words")).withColumn("token_size", F.least("len", F.lit(shingle)))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, most_windows: int = 200_000) -> DataFrame:
    """Finds the words of each document that occur in a window of a benchmark item.

    documents: doc_id and text; benchmark: item_id and text; other columns are left out. Returns for
    each document doc_id, version (xxhash64 of its text), n_words, n_hit (words inside any occurrence of a window), n_items (items with
    such windows), items (their ids as strings, sorted), items_sha256 (of those joined by commas),
    contaminated (n_hit > 0).

    Texts that are null, empty or without words have no words, and such items no windows. Rows that
    repeat both doc_id and text give one row; a doc_id with other texts, one for each; a null doc_id
    stays null. Items that share windows all count. Windows of items with a null item_id count like any
    other, in n_items as one item; only items and items_sha256 can't name it. Empty tables: no documents
    give no rows, no items no hits.

    most_windows bounds what is broadcast. A larger benchmark is joined by shuffling the documents'
    tokens (a hash and a position, not the words), and candidates meet their documents again.
    """
    docs = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("version"), words(F.col("text").cast("string")).alias("w"))
    windows = _windows(benchmark, window, shingle)
    windows = windows.withColumn("window_id", F.xxhash64("item_words", "len"))
    sizes = sorted(r[0] for r in windows.select("token_size").distinct().collect())  # 1 to shingle
    small = windows.count() <= most_windows
    near = F.broadcast if small else (lambda df: df)
    tokens = windows.select("window_id", "items", "unnamed", "item_words", "len", F.explode(F.expr("sequence(0, len - token_size)")).alias("offset"), "token_size")
    token = F.lit(None).cast("long")
    for size in sizes:
        token = F.when(F.col("token_size") == size, F.expr(_token("item_words", "offset", size))).otherwise(token)
    tokens = tokens.withColumn("token", token).drop("token_size")

    exploded = docs.select("doc_id", "version", "w", F.posexplode_outer("w").alias("pos", "word")).drop("word")
    if len(sizes) == 1:
        exploded = exploded.withColumn("doc_token", F.expr(_token("w", "pos", sizes[0])))
    elif sizes:
        every = ", ".join(_token("w", "pos", s) for s in sizes)
        exploded = exploded.withColumn("doc_token", F.explode(F.expr(f"array({every})")))
    else:
        exploded = exploded.withColumn("doc_token", F.lit(None).cast("long"))

    # Rarity over all documents, of the benchmark's own tokens only: as many counts as it has tokens.
    known = tokens.select("token").distinct()
    rarity = exploded.join(near(known), exploded.doc_token == known.token).groupBy("token").agg(F.count("*").alias("uses"))
    rarest = W.partitionBy("window_id").orderBy(F.coalesce("uses", F.lit(0)), "offset")
    prefix = tokens.join(rarity, "token", "left").withColumn("rank", F.row_number().over(rarest)).where("rank = 1")
    prefix = prefix.where("uses > 0").select("window_id", F.col("token").alias("prefix_token"), "offset", "len", "item_words", "items", "unnamed")

    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.size("w"))
    same = F.expr("slice(w, pos - offset + 1, len)") == F.col("item_words")
    if small:
        found = exploded.join(F.broadcast(prefix), (exploded.doc_token == prefix.prefix_token) & (F.col("pos") >= F.col("offset")), "left")
        # The first row of each document stands for it, whether it has a hit or not.
        hit = F.coalesce(F.col("prefix_token").isNotNull() & inside & F.when(inside, same), F.lit(False))
        found = found.withColumn("hit", hit).where("hit or coalesce(pos, 0) = 0")
    else:
        # Rows that repeat doc_id and text have the same candidates: one of each, or they would meet m times m.
        candidates = exploded.drop("w").join(prefix, F.col("doc_token") == F.col("prefix_token")).where(start >= 0)
        candidates = candidates.dropDuplicates(["doc_id", "version", "pos", "window_id"])
        texts = docs.select(F.col("doc_id").alias("text_id"), F.col("version").alias("text_version"), "w")
        again = F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("version") == F.col("text_version"))  # a null doc_id is one, too
        candidates = candidates.join(texts, again).where(inside).where(same).drop("text_id", "text_version").withColumn("hit", F.lit(True))
        alone = docs.select("doc_id", "version", "w", F.lit(False).alias("hit"))
        found = candidates.unionByName(alone, allowMissingColumns=True)
    found = found.select("doc_id", "version", F.size("w").alias("n_words"), "hit", F.when(F.col("hit"), start).alias("start"), F.when(F.col("hit"), start + F.col("len")).alias("end"), F.when(F.col("hit"), F.col("items")).alias("items"), F.when(F.col("hit"), F.col("unnamed")).alias("unnamed"))

    # Occurrences overlap: in order of start, each adds the words beyond the furthest end before it.
    document = W.partitionBy("doc_id", "version")
    before = F.max("end").over(document.orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    out = found.groupBy("doc_id", "version").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(F.col("hit"), F.col("new")).otherwise(0)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.coalesce(F.max("unnamed"), F.lit(0)).alias("unnamed"),
    )
    return out.select("doc_id", "version", "n_words", "n_hit", (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), "items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

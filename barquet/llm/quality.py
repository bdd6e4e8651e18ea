"""Quality classifier by pairwise ranking in the manner of Bradley and Terry.

Each pair of a good and a bad labelled document is a preference. The chance that the good one is
preferred is the logistic function of a linear score's difference, so the weights come from logistic
loss on feature differences. The cut between good and bad is a quantile of the scores: the
one that rejects as large a share of labelled documents as the labels do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm.common import Scratch, slices

#: Kinds of characters that are counted, besides letters.
KINDS = ("#$%&*@^~<>{}=+_\\", "|", "!?", ".,;:", "0123456789")
UPPER, LETTER = len(KINDS) + 1, len(KINDS) + 2
N_FEATURES = 12


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point: its place in KINDS from 1, UPPER, LETTER, or 0. Made once per worker."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        kinds[c] = UPPER if category == "Lu" else LETTER if category[0] == "L" else 0
    for i, chars in enumerate(KINDS, 1):
        kinds[[ord(c) for c in chars]] = i
    return kinds


def features(text: str | None) -> np.ndarray:
    """What a score is made of: properties of the whole text, none of its source, language or id. Null counts as empty."""
    text = text or ""
    counts = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=LETTER + 1)
    size = max(1, len(text))
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(words))
    letters = max(0.001, (counts[UPPER] + counts[LETTER]) / size)
    shares = counts[1:UPPER] / size
    return np.array(
        [np.log1p(len(words)), *shares, counts[UPPER] / size / letters, letters, len(set(words)) / n * n**0.1, len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / n), len(lines) / n]
    )


@dataclass
class Ranker:
    """A linear score of standardised features, bent at both ends; ``cut`` is the score that divides good from bad."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """From 0 to 1, 0.5 at the cut."""
        x = np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)
        total = (_expanded(x, self.mean, self.scale) * self.weights).sum(1) - self.cut
        return 1 / (1 + np.exp(np.clip(-self.slope * total, -700, 700)))


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.tanh((x - mean) / scale)
    return np.concatenate([z, z * z], 1)


def _sums(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows' x of what ``f`` gives for a matrix of them: ``size`` numbers, one row a task on the way."""

    def part(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch["x"]
                total += f(x.flatten().to_numpy().reshape(batch.num_rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["total"])

    found = df.select("x").mapInArrow(part, "total array<double>").select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("total"))
    out = np.zeros(size)
    for pos, total in found.collect():  # ``size`` rows
        out[pos] = total
    return out


def _ranked(scores: DataFrame, places: list[int], bins: int = 4096) -> list[float]:
    """The scores at ``places`` in rising order, from 0, over all rows: bins are counted, and that of the place is cut on."""
    out = []
    for place in places:
        low, high, rows = *scores.agg(F.min("score"), F.max("score")).first(), scores
        while low < high:
            at = F.least(F.floor((F.col("score") - low) / max((high - low) / bins, 5e-324)), F.lit(bins - 1))
            counted = sorted(rows.groupBy(at.alias("bin")).agg(F.count("*"), F.min("score"), F.max("score")).collect())  # ``bins`` rows at most
            for _, n, low, high in counted:
                if place < n:
                    break
                place -= n
            rows = rows.where(F.col("score").between(low, high))
        out.append(float(low))
    return out


def _preferences(learned: DataFrame, good: int, bad: int, pairs: int, block: int, seed: int) -> DataFrame:
    """x: differences of a good and a bad row's x, with each row of learned (hash, label, x) in one at least.

    Rows are dealt to blocks by their hash. Those of the smaller class are repeated in as many blocks as give each some of them; within a
    block each row of the larger class meets rows of the smaller one, as often as makes ``pairs`` in all, by a seed of the block's number.
    """
    rare, least, most = int(good < bad), min(good, bad), max(good, bad)
    blocks = -(-(good + bad) // block)
    copies, times = min(blocks, -(-64 * blocks // least)), max(1, pairs // most)
    first = F.pmod("hash", F.lit(blocks))
    repeated = F.when(F.col("label") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = learned.select("label", "x", first.alias("first"), F.explode(repeated).alias("copy")).select(F.pmod(F.col("first") + F.col("copy"), F.lit(blocks)).alias("block"), "label", "x")

    def drawn(key, table):
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        x, label = x[order := np.lexsort(x.T)], table["label"].to_numpy()[order]
        few, many = x[label == rare], x[label != rare]
        if not len(few) or not len(many):
            return pa.table({"x": pa.array([], pa.list_(pa.float64()))})
        rng = np.random.default_rng([seed, key[0].as_py()])
        n = max(len(many) * times, len(few))
        d = few[np.resize(rng.permutation(len(few)), n)] - many[np.resize(rng.permutation(len(many)), n)]
        return pa.table({"x": pa.array(list(d if rare else -d), pa.list_(pa.float64()))})

    return dealt.groupBy("block").applyInArrow(drawn, "x array<double>")


def fit(docs: DataFrame, labels: DataFrame, pairs: int = 60_000, seed: int = 7, block: int = 8192) -> Ranker:
    """Learns from labels (doc_id, label 0 or 1) of ``docs`` (doc_id, text): from all of them.

    Texts, features and preferences stay on the executors; sums of a fixed size come back. Each labelled row takes part in the scale, in a
    preference at least, of which there are about ``pairs`` if rows are fewer, and in the cut. Rows with a
    null label, id or text take no part. Without both labels there is no preference: every score is 0.5.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).dropDuplicates(["doc_id"])

    def measure(batches):
        for batch in slices(batches):
            x = pa.array([features(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], x], names=["doc_id", "x"])

    keep = Scratch()
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    measured = texts.mapInArrow(measure, T.StructType([texts.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))  # before the join, so that it moves no texts
    learned = keep(measured.join(known, "doc_id").select(F.xxhash64("doc_id", "x").alias("hash"), "label", "x"))
    counts = dict(learned.groupBy("label").count().collect())
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        keep.release()
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES), 0.0, 1.0)
    # Sums are rounded, so that the order in which tasks add doesn't show.
    moments = _sums(learned.where("label = 1"), lambda x: np.concatenate([x.sum(0), (x * x).sum(0)]), 2 * N_FEATURES) / good
    mean = _rounded(moments[:N_FEATURES])
    scale = _rounded(np.maximum(np.sqrt(np.maximum(moments[N_FEATURES:] - moments[:N_FEATURES] ** 2, 0)), 1e-3) * 2)

    def expand(batches):
        for batch in batches:
            z = _expanded(batch["x"].flatten().to_numpy().reshape(batch.num_rows, N_FEATURES), mean, scale)
            yield pa.RecordBatch.from_arrays([batch["hash"], batch["label"], pa.array(list(z), pa.list_(pa.float64()))], names=["hash", "label", "x"])

    learned = keep(learned.mapInArrow(expand, "hash long, label int, x array<double>"))
    preferences = keep(_preferences(learned, good, bad, pairs, block, seed))
    n, size = preferences.count(), 2 * N_FEATURES
    w = np.zeros(size)
    for _ in range(25):  # Newton steps on mean logistic loss with a small ridge

        def slope(d, w=w):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            return np.concatenate([((d * (p * (1 - p))[:, None]).T @ d).ravel(), d.T @ p])

        sums = _sums(preferences, slope, size * size + size) / n
        h = sums[: size * size].reshape(size, size) + 1e-3 * np.eye(size)
        step = np.linalg.solve(h, sums[size * size :] - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    w = _rounded(w)

    def score(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array((x * w).sum(1))], names=["score"])

    scores = keep(learned.mapInArrow(score, "score double"))
    cut = sum(_ranked(scores, [bad - 1, min(bad, good + bad - 1)])) / 2  # the quantile at the share of bad labels
    keep.release()
    return Ranker(mean, scale, w, cut, 1.0)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.array([float(f"{v:.9g}") for v in x])


def score_documents(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``docs`` (doc_id, text; other columns are left out) with score and predicted (score >= 0.5): a row per row.

    Null and empty texts are scored by the features of an empty text; texts of any length are read whole;
    equal texts have equal scores.
    """

    def score(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ranker.scores(batch["text"].to_pylist()))], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all their columns as they are."""

    def keep(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(ranker.scores(batch["text"].to_pylist()) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)

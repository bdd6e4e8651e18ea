"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to exploded n-grams, summed per document.

The model is counted on the very documents that it scores, so each document is scored by the
counts of all the others: its own are taken off. Every n-gram of every document is counted; the
tables grow with the corpus, are partitioned by the n-gram's hash, and never meet in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.blocks import BLOCK_BYTES, REQUEST, Block, answers, in_blocks, request, resolve, sent, tidied
from barquet.llm.common import rolling


def _split(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _ngrams(b: Block, order: int) -> list[tuple[np.ndarray, ...]]:
    """For each n from 1 to ``order``: starts of n-grams, sorted distinct keys, each start's key, and how often the block has each key."""
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero(b.whole(n))
        keys, inverse, count = np.unique(rolling(b.hashes, n)[at], return_inverse=True, return_counts=True)
        out.append((at, keys, inverse, count))
    return out


def _own(doc: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """How often the document at each place has the key at that place."""
    _, inverse, count = np.unique(doc.astype(np.int64) * max(keys, 1) + key, return_inverse=True, return_counts=True)
    return count[inverse]


def _add(keys: np.ndarray, counts: np.ndarray, kind: int) -> np.ndarray:
    _, inverse = np.unique(keys, return_inverse=True)
    return np.bincount(inverse, counts).astype(np.uint32)[inverse]


def stupid_backoff(docs: DataFrame, order: int = 2, alpha: float = 0.4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores every whole text by an n-gram model of all other texts.

    docs: doc_id and text; other columns are left out. Words are what ASCII white space divides,
    with A-Z in lower case. The score of a word after the ``order - 1`` words before it is count(n-gram) /
    count(its first n-1 words) if other documents have the n-gram, else ``alpha`` times the score after one
    word less; a word alone scores count / words, and one that no other document has alpha / words,
    all over the other documents. The first words of a document have fewer before them.

    Returns a row per row of docs: doc_id, n_words, n_seen (words whose longest n-gram others have) and
    score_micro, the sum over words of the natural logarithm in millionths, each rounded, so that sums
    don't depend on their order. N-grams are told apart by 64-bit hashes. A text without words, or null, scores 0; so does every text if no other
    has words. Rows that share a doc_id are documents of their own. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt, n = in_blocks(docs, block_bytes)
    groups = lambda df: df.groupBy("block")

    def ask(block: int, rows: pa.Table):
        for kind, (_, keys, _, count) in enumerate(_ngrams(Block(rows, _split), order), 1):
            yield request(block, kind, keys, count.astype(np.uint32), n)

    counts = resolve(groups(dealt).applyInArrow(sent(ask), REQUEST), n, "u4", _add)
    # Words of all documents: the count tables of n = 1 summed over blocks, one number.
    total = docs.select(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).alias("n")).agg(F.sum("n")).first()[0] or 0

    def score(key: tuple[pa.Scalar, ...], rows: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(rows, _split)
        size = len(b.hashes)
        others = total - b.lengths[b.doc]
        found = _ngrams(b, order)
        # rest[n - 1][i]: how often other documents have the n-gram that starts at i.
        rest = []
        for kind, (at, keys, which, _) in enumerate(found, 1):
            every = answers(got, kind, np.uint32, len(keys)).astype(np.int64)
            left = np.zeros(size, np.int64)
            left[at] = every[which] - _own(b.doc[at], which, len(keys))
            rest.append(left)
        value = np.where(rest[0] > 0, rest[0], alpha) / np.maximum(others, 1)
        seen = rest[0] > 0
        place = np.arange(size) - b.starts[b.doc]
        for m in range(2, order + 1):
            last = np.flatnonzero(place >= m - 1)
            first = last - (m - 1)
            has = rest[m - 1][first] > 0
            value[last] = np.where(has, rest[m - 1][first] / np.maximum(rest[m - 2][first], 1), alpha * value[last])
            seen[last] = has
        micro = np.where(others > 0, np.rint(1e6 * np.log(value)), 0).astype(np.int64)
        per = lambda v: np.bincount(b.doc, v, len(b.lengths)).astype(np.int64)
        return pa.table({"doc_id": b.rows["doc_id"], "n_words": b.lengths, "n_seen": per(seen & (others > 0)), "score_micro": per(micro)})

    return groups(dealt).cogroup(groups(counts.repartition(n, "block"))).applyInArrow(tidied(score), "doc_id long, n_words long, n_seen long, score_micro long")

"""Exact substring dedup: fixed-block anchors find where texts repeat, hits extend to maximal exact repeats.

1. Every document is cut into non-overlapping reference blocks of ``window // 2`` words, the
   anchors; anchors are indexed by hash, and probed with every rolling window of that length.
   Any repeat of ``window`` words holds a whole anchor of the other occurrence, whatever the
   alignment, so each of its occurrences gets a hit.
2. A hit is extended as far as ``window`` words around it go: each window that holds a hit is
   compared, by a 96-bit hash, with all such windows of the corpus, and the first occurrence is
   found. Overlapping repeated windows merge into the maximal exact repeat; its words go.

Both lookups run as in ``blocks``: one shuffle of the documents, then packed keys only. A passage
that a third of all documents hold costs one key a block; no pairs of documents are ever formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm.blocks import REQUEST, Block, answers, in_blocks, request, resolve, sent, tidied
from barquet.llm.common import BASE_B, mixed, rolling

#: Text of a block, of which a worker holds one with several arrays as long as its words, and blocks whose keys a bucket gets on average.
BLOCK_BYTES, BUCKET_BLOCKS = 4 << 20, 2


def _split(text: str) -> list[bytes]:
    return text.encode().split()  # bytes.split() knows just the six ASCII white-space characters


def _anchor_keys(b: Block, k: int, bits: int) -> tuple[np.ndarray, ...]:
    """Keys are hashes cut to ``bits``: they only choose what is compared in full. Of a block's rolling windows of ``k`` words: their starts, sorted distinct keys with the (at most 2) anchors of each, and each window's key and whether it is an anchor."""
    at = np.flatnonzero(b.whole(k))
    keys, inverse = np.unique(rolling(b.hashes, k)[at] >> np.uint64(64 - bits) << np.uint64(64 - bits), return_inverse=True)
    inverse = inverse.astype(np.int32)
    anchor = (at - b.starts[b.doc[at]]) % k == 0
    count = np.minimum(np.bincount(inverse, anchor, len(keys)), 2).astype(np.uint8)
    return at, keys, count, inverse, anchor


def _windows(b: Block, window: int, got: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Windows that hold a hit: starts, sorted distinct keys (two columns), the first start of each, and each window's key."""
    k = window // 2
    at, _, _, inverse, anchor = found
    hits = np.zeros(len(b.hashes) + 1, np.int64)
    hits[at + 1] = got[inverse].astype(np.int64) > anchor
    hits = np.cumsum(hits)
    starts = np.flatnonzero(b.whole(window))
    starts = starts[hits[starts + window - k + 1] > hits[starts]]
    first, second = rolling(b.hashes, window)[starts], (rolling(mixed(b.hashes), window, BASE_B)[starts] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((starts, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new) - 1
    return starts, first[order][new], second[order][new], starts[order][new], key


def _merge_anchors(keys: np.ndarray, counts: np.ndarray, kind: int) -> np.ndarray:
    _, inverse = np.unique(keys, return_inverse=True)
    return np.minimum(np.bincount(inverse, counts), 2).astype(np.uint8)[inverse]


#: What a window's request carries besides its key: the rest of the hash, and the document of its first occurrence in the block, by doc_id and tie.
_WINDOW = np.dtype([("rest", "<u4"), ("doc", "<i8"), ("tie", "<u2")])


def _merge_windows(keys: np.ndarray, extra: np.ndarray, kind: int) -> np.ndarray:
    order = np.lexsort((extra["tie"], extra["doc"], extra["rest"], keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(extra["rest"][order].astype(np.int64)) != 0)
    first = np.zeros(len(order), np.uint8)
    first[order] = new
    return first


_KEPT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]


def drop_repeats(docs: DataFrame, window: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes each word that a window of ``window`` words covers whose words also start earlier in the corpus.

    docs: doc_id, text and others, which are carried along. Earlier is a smaller doc_id, or an earlier
    start in the same document. Words are runs of characters but ASCII white space. Returns the rows
    of docs and n_words, n_removed, kept_text (the other words joined by one space), in place of
    columns of these names.

    A null or empty text has no words, and its kept_text is empty. Texts of any length are taken
    whole. doc_id should be unique; rows that share one count as one after another in the order of
    a hash of their texts, and null as the smallest. An empty table gives an empty one.
    """
    if window < 4:
        raise ValueError("a window has 4 words at least")
    k = window // 2
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "kept_text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("others"))
    dealt, n = in_blocks(docs, block_bytes)
    buckets = -(-n // BUCKET_BLOCKS)
    slim, schema = dealt.select("block", "doc_id", "tie", "text"), T.StructType([*docs.schema, *_KEPT])
    bits = min(64, 38 + (n * block_bytes >> 10).bit_length() - 14)  # chance hits stay rare at any size
    groups, docs_columns = lambda df: df.groupBy("block"), docs.columns

    def ask_anchors(block: int, rows: pa.Table):
        _, keys, count, _, _ = _anchor_keys(Block(rows, _split), k, bits)
        yield request(block, 1, keys, count, buckets)

    anchors = resolve(groups(slim).applyInArrow(sent(ask_anchors), REQUEST), buckets, "u1", _merge_anchors)

    def ask_windows(key: tuple[pa.Scalar, ...], rows: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(rows, _split)
        found = _anchor_keys(b, k, bits)
        _, first, second, at, _ = _windows(b, window, answers(got, 1, np.uint8, len(found[1])), found)
        extra = np.empty(len(first), _WINDOW)
        extra["rest"], extra["doc"], extra["tie"] = second, b.ids[b.doc[at]], b.ties[b.doc[at]]
        return pa.Table.from_batches([request(key[0].as_py(), 2, first, extra, buckets)])

    asked = groups(slim).cogroup(groups(anchors.repartition(n, "block"))).applyInArrow(tidied(ask_windows), REQUEST)
    firsts = resolve(asked, buckets, _WINDOW, _merge_windows)

    def keep(key: tuple[pa.Scalar, ...], rows: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(rows, _split)
        found = _anchor_keys(b, k, bits)
        starts, first, _, at, which = _windows(b, window, answers(got, 1, np.uint8, len(found[1])), found)
        is_first = answers(got, 2, np.uint8, len(first)) > 0
        again = starts[~(is_first[which] & (at[which] == starts))]
        cover = np.zeros(len(b.hashes) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        kept = []
        for row, (i, j) in enumerate(zip(b.starts, b.ends, strict=True)):
            words, out = _split(b.rows["text"][row].as_py() or ""), gone[i:j]
            kept.append(b" ".join([w for w, g in zip(words, out.tolist(), strict=True) if not g] if out.any() else words).decode())
        removed = np.bincount(b.doc, gone, len(b.lengths)).astype(np.int64)
        own = {"n_words": pa.array(b.lengths), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.string())}
        return pa.table({c: b.rows[c] for c in docs_columns} | own)

    both = anchors.unionByName(firsts).repartition(n, "block")
    return groups(dealt).cogroup(groups(both)).applyInArrow(tidied(keep), schema).select("doc_id", "text", "others.*", *[f.name for f in _KEPT]).drop("_")

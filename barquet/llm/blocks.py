"""Documents in blocks of bounded size, and lookups of all blocks' keys in one hash-partitioned table.

An exact corpus-wide lookup of every n-gram of every document would shuffle a row per word.
Here a block of documents asks for each of its distinct keys once: the keys are sorted, packed
and sent to the bucket of their hash; the bucket merges what all blocks sent and answers in the
same order. Sorting makes requests independent of the order in which rows arrive, so that the
block finds its keys again when it gets the answers, even after a lost executor.
A key costs a few bytes in the shuffle, and a hot key one entry a block instead of one a row.
With more blocks than a block has keys, a request holds one key, and the exchange is one of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import WordHashes, pack, tidy, unpack

REQUEST = "bucket int, block int, kind int, n long, keys binary, extra binary"
ANSWER = "block int, bucket int, kind int, answer binary"
BLOCK_BYTES = 8 << 20
#: Words whose hashes a block remembers at a time.
CACHED = 1 << 15


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text and others) dealt into blocks of about ``block_bytes`` of text, and their number.

    A doc_id with many texts is dealt into many blocks by ``tie``, 16 bits of a hash of the text; texts that share both share a block.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    docs = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 48).cast("int"))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)).cast("int")).repartition(n, "block"), n


class Block:
    """The documents of a block in order of doc_id, tie and text, and the hashes of all their words in one array; the words themselves aren't held."""

    def __init__(self, rows: pa.Table, split: Callable[[str], list[bytes]]):
        ids = rows["doc_id"].to_pylist()
        texts = rows["text"].to_pylist()
        ties = rows["tie"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, ties[i], texts[i] or ""))
        self.rows = rows.take(order) if order else rows
        self.ids = np.array([-(1 << 63) if ids[i] is None else ids[i] for i in order], np.int64)
        self.ties = np.array([ties[i] for i in order], np.uint16)
        cache, hashes = WordHashes(), []
        for i in order:
            hashes.append(cache.of(split(texts[i] or "")))
            texts[i] = None
            if len(cache) > CACHED:
                cache.clear()
        del texts, cache
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.doc = np.repeat(np.arange(len(hashes), dtype=np.int32), self.lengths)
        self.starts = self.ends - self.lengths

    def whole(self, k: int) -> np.ndarray:
        """Whether ``k`` words from each start lie in one document, for the starts that ``rolling`` gives."""
        at = np.arange(max(0, len(self.hashes) - k + 1), dtype=np.int32)
        return at + k <= self.ends[self.doc[at]]


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key; it rises with the key, so sorted keys stay together."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def request(block: int, kind: int, keys: np.ndarray, extra: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of REQUEST for sorted ``keys``; ``extra`` has one fixed-size value per key."""
    full, at = np.unique(buckets_of(keys, n), return_index=True)
    parts = [slice(i, j) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)] if len(keys) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array([block] * len(parts), pa.int32()),
            pa.array([kind] * len(parts), pa.int32()),
            pa.array([p.stop - p.start for p in parts], pa.int64()),
            pa.array([pack(keys[p]) for p in parts], pa.binary()),
            pa.array([pack(extra[p]) for p in parts], pa.binary()),
        ],
        names=["bucket", "block", "kind", "n", "keys", "extra"],
    )


def resolve(requests: DataFrame, n: int, extra: str, merge: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """Answers every request: ``merge(keys, extras, kind)`` sees all that was sent to a bucket and returns a value per entry."""

    def answer(rows: pa.Table) -> pa.Table:
        blocks, kinds, sizes = (rows[c].to_numpy() for c in ("block", "kind", "n"))
        out = []
        for kind in np.unique(kinds):
            own = np.flatnonzero(kinds == kind)
            keys = np.concatenate([unpack(rows["keys"][int(i)].as_py(), np.uint64) for i in own])
            more = np.concatenate([unpack(rows["extra"][int(i)].as_py(), extra) for i in own])
            got = merge(keys, more, int(kind))
            for i, part in zip(own, np.split(got, np.cumsum(sizes[own])[:-1]), strict=True):
                out.append((int(blocks[i]), rows["bucket"][0].as_py(), int(kind), part.tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "kind", "answer"])

    return requests.repartition(n, "bucket").groupBy("bucket").applyInArrow(tidied(answer), ANSWER)


def answers(rows: pa.Table, kind: int, dtype, n: int) -> np.ndarray:
    """A block's answers of one kind, in the order of the keys it sent; raises if any is missing."""
    got = sorted((r["bucket"], r["answer"]) for r in rows.to_pylist() if r["kind"] == kind)
    values = np.concatenate([np.zeros(0, dtype), *(np.frombuffer(a, dtype) for _, a in got)])
    if len(values) != n:
        raise RuntimeError(f"a block asked for {n} keys and got {len(values)} answers")
    return values


def sent(f: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """``f`` as a function for applyInArrow."""

    def apply(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(f(key[0].as_py(), rows)))

    return tidied(apply)


def tidied(f: Callable) -> Callable:
    """``f`` for applyInArrow, of one to three arguments; what it no longer uses goes back to the system."""

    def done(out):
        tidy()
        return out

    return {1: lambda a: done(f(a)), 2: lambda a, b: done(f(a, b)), 3: lambda a, b, c: done(f(a, b, c))}[f.__code__.co_argcount]

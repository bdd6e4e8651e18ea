"""Byte-level BPE through a distinct-word table, and decoding through an id-to-piece join.

A byte-level tokenizer never merges across the words of its splitting pattern, so a word has the
same ids wherever it stands. Tasks cut their documents into chunks of bounded size and split each text
once. Of a chunk two things go on: its documents as numbers of words, most used words first, and its
distinct words, each to the bucket of its hash. A bucket is a part of the table of distinct words: there
every word of the corpus is encoded once. The ids go back to the chunks, and are joined to each
document by word position. Texts themselves aren't shuffled. Decoding joins ids to
the vocabulary's pieces, a table whose size the tokenizer fixes, and puts the pieces in order.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barquet.llm.blocks import BLOCK_BYTES, tidied
from barquet.llm.common import slices

CHUNK_BYTES = 2 << 20
#: Rows that a chunk sends: its documents (kind 0), and its distinct words of a bucket (kind 1).
_SENT = "target int, kind int, chunk long, bucket int, docs array<bigint>, sizes array<int>, data binary, more binary"
_ENCODED = "target int, chunk long, bucket int, data binary, more binary"

#: Fixed value: the public pattern by which byte-level tokenizers of this kind split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _splitter(spec: str):
    """A compiled pattern that finds the words of a text: special tokens whole, all else by PATTERN."""
    special = sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=len, reverse=True)
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    word = regex.compile(PATTERN)

    def words(text: str) -> list[str]:
        if cut is None or not cut.search(text):
            return word.findall(text)
        return [w for i, part in enumerate(cut.split(text)) for w in ([part] if i % 2 else word.findall(part))]

    return words


def _tokenizer(spec: str) -> Tokenizer:
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def _cached_tokenizer(spec: str) -> Tokenizer:
    """One per worker and specification."""
    return _tokenizer(spec)


def read_tokenizer(path: str) -> str:
    """The tokenizer file at ``path`` on the driver, as text, to be sent with the tasks; a few MB whatever the data."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("only byte-level tokenizers that neither normalise nor add a space are read")
    return json.dumps(spec)


@cache
def _zstd(_process: int) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each per worker: to make them costs more than to pack a document."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(values: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    return _zstd(os.getpid())[0].compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_zstd(os.getpid())[1].decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _home(chunk: int, buckets: int) -> int:
    """Where the documents of a chunk meet the ids of their words."""
    return xxhash.xxh64_intdigest(chunk.to_bytes(8, "little")) % buckets


class _Chunk:
    """Documents of a task, as numbers of words in order of first use."""

    def __init__(self):
        self.docs, self.codes, self.bytes, self.number = [], [], 0, {}

    def add(self, doc_id: int | None, text: str, words: list[str]) -> None:
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number)
        self.docs.append(doc_id)
        self.codes.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
        self.bytes += len(text)

    def rows(self, chunk: int, buckets: int) -> pa.RecordBatch:
        """A row of kind 0, and one of kind 1 per bucket; words are in order of use, most used first."""
        codes = np.concatenate([np.zeros(0, np.uint32), *self.codes])
        words = list(self.number)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        encoded = [words[i].encode() for i in order]
        bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in encoded), np.uint32, len(encoded))
        home = _home(chunk, buckets)
        out = [(home, 0, chunk, None, self.docs, [len(c) for c in self.codes], _packed(rank[codes]), _packed(bucket))]
        at = np.argsort(bucket, kind="stable")
        for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1) if len(at) else ():
            own = [encoded[i] for i in part]
            b = int(bucket[part[0]])
            out.append((b, 1, chunk, b, None, None, zstandard.compress(b"".join(own), 3), _packed(np.array([len(w) for w in own]))))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["target", "kind", "chunk", "bucket", "docs", "sizes", "data", "more"])


def encode(docs: DataFrame, path: str, part_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES, texts: bool = False) -> DataFrame:
    """Token ids of every whole text: a row (doc_id, ids array<int>) per row of docs, with ``texts`` also text, what ``decode`` makes of the ids.

    docs: doc_id and text; other columns are left out. A null or empty text has no ids. Special
    tokens are not added; where their strings stand in a text they are encoded as themselves.
    Repeated rows are encoded each. An empty table gives an empty one. path: a byte-level
    tokenizer file on the driver. part_bytes: text for each part of the table and of the result.
    ``texts`` saves a second worker a task, which lives on with its memory when the task is over.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_tokenizer(path))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))

    def split(batches):
        words, task, chunk, made = _splitter(spec.value), TaskContext.get().partitionId(), _Chunk(), 0
        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                chunk.add(doc_id, text or "", words(text or ""))
                if chunk.bytes >= chunk_bytes:
                    yield chunk.rows(task + (made << 32), n)
                    chunk, made = _Chunk(), made + 1
        if chunk.docs:
            yield chunk.rows(task + (made << 32), n)

    def encode_words(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        asked = []
        for row in rows.filter(pc.equal(rows["kind"], 1)).select(["chunk", "bucket", "data", "more"]).to_pylist():
            blob, ends = zstandard.decompress(row["data"]), np.cumsum(_unpacked(row["more"])).tolist()
            asked.append((row["chunk"], row["bucket"], [blob[i:j] for i, j in zip([0, *ends], ends, strict=False)]))
        table = dict.fromkeys(w for _, _, words in asked for w in words)
        distinct, tokenizer = list(table), _cached_tokenizer(spec.value)
        for i in range(0, len(distinct), 1000):
            part = distinct[i : i + 1000]
            for w, e in zip(part, tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                table[w] = e.ids
        out = []
        for chunk, bucket, words in asked:
            ids = [table[w] for w in words]
            out.append((_home(chunk, n), chunk, bucket, _packed(np.array([i for x in ids for i in x], np.uint32)), _packed(np.array([len(x) for x in ids]))))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["target", "chunk", "bucket", "data", "more"])

    def join_ids(key: tuple[pa.Scalar, ...], rows: pa.Table, known: pa.Table) -> pa.Table:
        _cached_tokenizer.cache_clear()  # all words are encoded by now, and most workers that did it come here
        found: dict[int, list] = {}
        for row in known.to_pylist():
            found.setdefault(row["chunk"], []).append((row["bucket"], row["data"], row["more"]))
        docs_out, ids, ends = [], [], [0]
        for row in rows.filter(pc.equal(rows["kind"], 0)).to_pylist():
            parts = sorted(found.pop(row["chunk"], []))
            at = np.argsort(_unpacked(row["more"]), kind="stable")  # ranks in the order of buckets
            table = np.concatenate([np.zeros(0, np.uint32), *[_unpacked(d) for _, d, _ in parts]]).astype(np.int32)
            sizes_there = np.concatenate([np.zeros(0, np.uint32), *[_unpacked(m) for _, _, m in parts]]).astype(np.int64)
            if len(sizes_there) != len(at):
                raise RuntimeError(f"a chunk asked for {len(at)} words and got {len(sizes_there)}")
            size_of, start_of = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            size_of[at], start_of[at] = sizes_there, np.cumsum(sizes_there) - sizes_there
            codes = _unpacked(row["data"])
            size, start = size_of[codes], start_of[codes]
            before = np.cumsum(size)
            ids.append(table[np.repeat(start - before + size, size) + np.arange(int(size.sum()))])
            words_end = np.cumsum(row["sizes"])
            tokens_end = np.concatenate([[0], before])[words_end]
            ends.extend((ends[-1] + tokens_end).tolist())
            docs_out.extend(row["docs"])
        values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        out = {"doc_id": pa.array(docs_out, pa.int64()), "ids": lists}
        if texts:
            pieces = _cached_pieces(spec.value)
            out["text"] = pa.chunked_array([_texts(lists.slice(i, 256), pieces) for i in range(0, len(lists), 256)], pa.string())
        return pa.table(out)

    # In a fixed order, so that a task that runs again after a lost executor makes the same chunks.
    sent = docs.sortWithinPartitions("doc_id", "text").mapInArrow(split, _SENT).repartition(n, "target")
    encoded = sent.groupBy("target").applyInArrow(tidied(encode_words), _ENCODED).repartition(n, "target")
    return sent.groupBy("target").cogroup(encoded.groupBy("target")).applyInArrow(tidied(join_ids), "doc_id long, ids array<int>" + ", text string" * texts)


def _pieces(spec: str) -> list[bytes | None]:
    """The bytes of each id. Byte-level vocabularies write a byte as a printable character: itself if it is one, else the next free from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    t = _tokenizer(spec)
    vocab = t.get_vocab(with_added_tokens=True)
    out: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
    return out


@cache
def _cached_pieces(spec: str) -> pa.Array:
    """One per worker and specification, a few MB."""
    return pa.array(_pieces(spec), pa.binary())


def _texts(lists: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """What lists of ids stand for."""
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), flat, None)
    got = pc.fill_null(pieces.take(known), b"")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), got), b"")
    return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with ids array<int>) and text, what its ids stand for, special tokens included.

    Ids meet the vocabulary table by a join on its id inside each batch. Ids outside the vocabulary
    or null stand for nothing; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text.
    """
    spec = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    names = [c for c in encoded.columns if c != "text"]

    def join_pieces(batches):
        pieces = _cached_pieces(spec.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), _texts(batch["ids"], pieces)], names=[*names, "text"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "text")
    return encoded.select(names).mapInArrow(join_pieces, f"{schema}, text string")

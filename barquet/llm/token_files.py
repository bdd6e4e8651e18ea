"""Token ids as files of patched frame-of-reference blocks, written and read by Spark.

A file holds the ids of consecutive documents as one stream, cut into blocks. Of a block the minimum
is taken off; the rest is packed at the width that a given share of its ids needs, and the
few that need more stand in a list of exceptions. An index of block starts lets a reader fetch
any range of ids. Each task writes files of its own; the commit lists those of the attempts that
succeeded in a manifest, with the number of ids before each, so that a lost executor leaves nothing in the result.

Layout, little-endian: MAGIC; blocks (_BLOCK, packed words, places and values of exceptions);
documents (ids as 64-bit integers, flags of null ids, lengths as 32-bit integers); index (64-bit offsets of blocks, and
of their end); _FOOTER.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from barquet.llm.bpe import _packed, _unpacked
from barquet.llm.common import slices, tidy

MAGIC, MANIFEST = b"PFOR0001", "manifest.json"
_BLOCK = "<IIII"  # ids, minimum, width, exceptions
_FOOTER = "<QQQQQII8s"  # documents, ids, blocks, offset of documents, offset of index, ids a block, checksum of documents and index, MAGIC
BLOCK_IDS, FILE_IDS, READ_IDS = 8192, 1 << 24, 1 << 20


def pack_block(ids: np.ndarray, share: float = 0.9) -> bytes:
    """Unsigned 32-bit ids as a block; ``share`` of them are packed, the others may be exceptions."""
    n = len(ids)
    low = ids.min()
    over = ids - low
    width = int(np.partition(over, k := max(0, int(np.ceil(share * n)) - 1))[k]).bit_length()
    places = np.flatnonzero(over >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    patched = over.copy()
    patched[places] = 0
    lanes = np.zeros((32, -(-n // 32)), np.uint32)  # value i is in lane i // lanes' length: 32 values of a column share a run of words
    lanes.ravel()[:n] = patched
    words = np.zeros((width, lanes.shape[1]), np.uint32)
    for i in range(32 if width else 0):
        word, bit = divmod(i * width, 32)
        words[word] |= lanes[i] << np.uint32(bit)
        if bit + width > 32:
            words[word + 1] |= lanes[i] >> np.uint32(32 - bit)
    return struct.pack(_BLOCK, n, int(low), width, len(places)) + words.astype("<u4").tobytes() + places.astype("<u4").tobytes() + over[places].astype("<u4").tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    """The ids of a block."""
    n, low, width, exceptions = struct.unpack_from(_BLOCK, data)
    columns, at = -(-n // 32), struct.calcsize(_BLOCK)
    words = np.frombuffer(data, "<u4", width * columns, at).reshape(width, columns)
    at += words.nbytes
    lanes = np.zeros((32, columns), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, bit = divmod(i * width, 32)
        lanes[i] = words[word] >> np.uint32(bit)
        if bit + width > 32:
            lanes[i] |= words[word + 1] << np.uint32(32 - bit)
        lanes[i] &= mask
    over = lanes.ravel()[:n]
    over[np.frombuffer(data, "<u4", exceptions, at)] = np.frombuffer(data, "<u4", exceptions, at + 4 * exceptions)
    return over + np.uint32(low)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


class FileWriter:
    """Writes one file; holds a block of ids, and a number and a length per document."""

    def __init__(self, out, block_ids: int, share: float):
        self.out, self.block_ids, self.share = out, block_ids, share
        self.rest, self.rest_ids, self.ids, self.offsets = [], 0, 0, []
        self.docs, self.nulls, self.lengths = [], [], []
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.out.tell())
        self.out.write(pack_block(ids, self.share))

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        for held, new in ((self.docs, doc_ids), (self.nulls, nulls), (self.lengths, lengths.astype("<u4")), (self.rest, ids)):
            held.append(new)
        self.rest_ids += len(ids)
        self.ids += len(ids)
        if self.rest_ids >= self.block_ids:
            held = np.concatenate(self.rest)
            whole = len(held) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(held[i : i + self.block_ids])
            self.rest, self.rest_ids = [held[whole:].copy()], len(held) - whole

    def close(self) -> int:
        """The number of documents."""
        if self.rest_ids:
            self._block(np.concatenate(self.rest))
        end = self.out.tell()
        docs, nulls, lengths = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.docs, "<i8"), (self.nulls, bool), (self.lengths, "<u4")))
        table = docs.astype("<i8").tobytes() + np.packbits(nulls).tobytes() + lengths.tobytes()
        index = np.array([*self.offsets, end], "<u8").tobytes()
        self.out.write(table + index + struct.pack(_FOOTER, len(docs), self.ids, len(self.offsets), end, end + len(table), self.block_ids, zlib.crc32(index, zlib.crc32(table)), MAGIC))
        self.out.close()
        return len(docs)


class FileReader:
    """Reads one file: its documents, and any range of its ids by the index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, self.ids, blocks, docs_at, index_at, self.block_ids, crc, magic = struct.unpack(_FOOTER, source.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
        table, index = source.read_at(index_at - docs_at, docs_at), source.read_at(8 * (blocks + 1), index_at)
        if magic != MAGIC or zlib.crc32(index, zlib.crc32(table)) != crc:
            raise ValueError("not a file of token ids, or a damaged one")
        self.index = np.frombuffer(index, "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(table, "<i8", n)
        self.nulls = np.unpackbits(np.frombuffer(table, np.uint8, -(-n // 8), 8 * n), count=n).astype(bool)
        self.lengths = np.frombuffer(table, "<u4", n, 8 * n + -(-n // 8)).astype(np.int64)

    def range(self, first: int, end: int) -> np.ndarray:
        """The ids first to end - 1; reads only the blocks that hold them."""
        if first >= end:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, -(-end // self.block_ids)
        base = int(self.index[a])
        data = memoryview(self.source.read_at(int(self.index[b]) - base, base))
        found = [unpack_block(data[i - base : j - base]) for i, j in zip(self.index[a:b].tolist(), self.index[a + 1 : b + 1].tolist(), strict=True)]
        return np.concatenate(found)[first - a * self.block_ids : end - a * self.block_ids]

    def batches(self, start: int, most: int = READ_IDS, raw: bool = False) -> Iterator[pa.RecordBatch]:
        """doc_id, start, n_tokens, ids of all documents, about ``most`` ids at a time; ``start`` ids come before the file. raw: ids as their bytes."""
        ends = np.cumsum(self.lengths)
        i = done = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, done + most, "right")))
            ids = self.range(done, int(ends[j - 1]))
            offsets = np.concatenate([[0], ends[i:j] - done])
            if raw:
                lists = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])
            else:
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(self.doc_ids[i:j], pa.int64(), mask=self.nulls[i:j]), pa.array(start + done + offsets[:-1]), pa.array(self.lengths[i:j]), lists], names=["doc_id", "start", "n_tokens", "ids"])
            i, done = j, int(ends[j - 1])


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class _File(InputPartition):
    path: str
    start: int


def _raw(options) -> bool:
    return str(options.get("raw", False)).lower() == "true"


def _lists(ids: pa.Array) -> pa.Array:
    """Lists of ids, whether they come packed or not."""
    if not pa.types.is_binary(ids.type):
        return ids
    found = [_unpacked(x) if x is not None else np.zeros(0, np.uint32) for x in ids.to_pylist()]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint32), *found]).view(np.int32)))


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.block_ids, self.file_ids, self.share = options["path"], int(options.get("block_ids", BLOCK_IDS)), int(options.get("file_ids", FILE_IDS)), float(options.get("share", 0.9))

    def write(self, iterator):
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        part, files, writer, name = TaskContext.get().partitionId(), [], None, ""

        def close():
            files.append({"part": part, "at": len(files), "name": name, "ids": writer.ids, "docs": writer.close()})

        for batch in slices(iterator):
            lists = _lists(batch["ids"])
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            docs = batch["doc_id"].cast(pa.int64())
            if writer is None:
                name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.pfor"  # an attempt's own
                writer = FileWriter(store.open_output_stream(f"{folder}/{name}"), self.block_ids, self.share)
            writer.add(docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False), lengths, ids)
            if writer.ids >= self.file_ids:
                close()
                writer = None
        if writer is not None:
            close()
        tidy()
        return _Written(files)

    def commit(self, messages):
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files, start = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["part"], f["at"])), 0
        for f in files:
            f["start"], start = start, start + f["ids"]
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"ids": start, "docs": sum(f["docs"] for f in files), "files": files}).encode())

    def abort(self, messages):
        store, folder = _store(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{f['name']}")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most, self.raw = options["path"], int(options.get("read_ids", READ_IDS)), _raw(options)

    def partitions(self):
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{MANIFEST}") as f:
            found = json.loads(f.read())
        return [_File(f["name"], f["start"]) for f in found["files"]] or [_File("", 0)]

    def read(self, partition):
        if partition.path:
            store, folder = _store(self.path)
            with store.open_input_file(f"{folder}/{partition.path}") as f:
                yield from FileReader(f).batches(partition.start, self.most, self.raw)


class TokenFiles(DataSource):
    """Data source ``token_files``. Written: doc_id and ids (array<int>, or packed by ``encode_ordered``), in the order of partitions and of their rows; read: start and n_tokens too."""

    @classmethod
    def name(cls):
        return "token_files"

    def schema(self):
        return f"doc_id long, start long, n_tokens long, ids {'binary' if _raw(self.options) else 'array<int>'}"

    def writer(self, schema, overwrite):
        return _Writer(self.options)

    def reader(self, schema):
        return _Reader(self.options)


def write_tokens(encoded: DataFrame, path: str, **options) -> None:
    """Writes doc_id and ids (array<int>, or packed by ``encode_ordered``) to a new folder at ``path``, in the order of partitions and rows. Null ids are none, a null doc_id stays null.

    options: block_ids, file_ids (a file takes no further document from so many ids on) and share (of ids that are packed).
    The folder has to be one that driver and executors share.
    """
    encoded.sparkSession.dataSource.register(TokenFiles)
    encoded.select("doc_id", "ids").write.format("token_files").mode("append").options(path=path, **options).save()


def read_tokens(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids of a folder that ``write_tokens`` has filled; a task per file.

    options: raw gives ids as a binary of little-endian unsigned 32-bit integers, read_ids how many a batch has.
    """
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").options(path=path, **options).load()


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1024, dtype), 0

    def extend(self, values) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(n, self.data.dtype)])
        self.data[self.n : n], self.n = values, n


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(int(sizes.sum()))


#: Fixed value: the public pattern by which lower-case tokenizers of this kind split text. What it finds as letters is one word of the model, and so ends with one piece that carries the suffix.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose parts are sure: letters that normalising only makes lower, and at most one sign of SIGNS after them.
SIGNS = ".,!?;:"
_PLAIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{SIGNS}]?)")


class _Words(dict):
    """Numbers of words; new ones wait to be encoded. Up to ``most`` words are kept, and letters of half as many more; later ones only until ``forget``.

    Letters are encoded once however a word is capitalised and whatever sign follows it, many in one call.
    """

    END = "end"  # no bytes, as words are

    def __init__(self, spec: str, end: int | None, most: int):
        super().__init__({self.END: 0})
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.waiting = most, []
        self.ids, self.starts, self.sizes = _Column(np.uint32), _Column(np.int64), _Column(np.int64)
        self._add(np.array([] if end is None else [end]), np.array([0 if end is None else 1]))
        self.letters: dict[str, int] = {}
        self.recent, self.recent_letters = [], []
        self.letter_ids, self.letter_starts, self.letter_sizes = _Column(np.uint32), _Column(np.int64), _Column(np.int64)
        self.signs = [self._encode(x)[0] for x in SIGNS]
        known = json.loads(spec)
        suffix, splits = known["model"].get("end_of_word_suffix"), (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix and splits[0].get("pattern") == {"Regex": PATTERN}:
            self.ends[[i for x, i in known["model"]["vocab"].items() if x.endswith(suffix)]] = True

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.waiting.append(word)
        return n

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts.extend(self.ids.n + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.ids.extend(ids)

    def _known(self, letters: list[str]) -> np.ndarray:
        """Numbers of letters, the new ones among them encoded."""
        new = [x for x in dict.fromkeys(letters) if x not in self.letters]
        for i in range(0, len(new), 1000):
            [found] = self.tokenizer.encode_batch_fast([" ".join(new[i : i + 1000])], add_special_tokens=False)  # without offsets, which nobody asks for
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            self.letter_starts.extend(self.letter_ids.n + np.concatenate([[0], ends[:-1]]))
            self.letter_sizes.extend(np.diff(ends, prepend=0))
            self.letter_ids.extend(ids)
        self.recent_letters = new
        self.letters.update(zip(new, range(len(self.letters), len(self.letters) + len(new)), strict=True))
        return np.fromiter(map(self.letters.__getitem__, letters), np.int64, len(letters))

    def _encoded(self) -> None:
        words = [w.decode() for w in self.waiting]
        found = [_PLAIN.fullmatch(w) for w in words] if self.ends.any() else [None] * len(words)
        plain = np.array([m is not None for m in found], bool)
        odd = [w for w, m in zip(words, found, strict=True) if m is None]
        odd_ids = [e.ids for i in range(0, len(odd), 1000) for e in self.tokenizer.encode_batch_fast(odd[i : i + 1000], add_special_tokens=False)]
        number = self._known([m[1].lower() for m in found if m])
        sign = np.array([SIGNS.index(m[2]) if m[2] else -1 for m in found if m], np.int64)
        size = self.letter_sizes.data[number]
        sizes = np.empty(len(words), np.int64)
        sizes[plain], sizes[~plain] = size + (sign >= 0), np.fromiter(map(len, odd_ids), np.int64, len(odd_ids))
        starts = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.uint32)
        ids[_runs(starts[plain], size)] = self.letter_ids.data[_runs(self.letter_starts.data[number], size)]
        ids[(starts[plain] + size)[sign >= 0]] = np.array(self.signs, np.uint32)[sign[sign >= 0]]
        ids[_runs(starts[~plain], sizes[~plain])] = np.array([i for x in odd_ids for i in x], np.uint32)
        self._add(ids, sizes)
        self.recent, self.waiting = self.waiting, []

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words, and their number for each."""
        if self.waiting:
            self._encoded()
        size = self.sizes.data[codes]
        return self.ids.data[_runs(self.starts.data[codes], size)], size

    def forget(self) -> None:
        """Leaves the first ``most`` words, among them those that are used most."""
        if len(self) > self.most:
            for w in self.recent[self.most - len(self) :]:
                del self[w]
            self.ids.n, self.starts.n, self.sizes.n = int(self.starts.data[self.most]), self.most, self.most
        most = self.most * 3 // 2
        if len(self.letters) > most:
            for x in self.recent_letters[most - len(self.letters) :]:
                del self.letters[x]
            self.letter_ids.n, self.letter_starts.n, self.letter_sizes.n = int(self.letter_starts.data[most]), most, most


@cache
def _words(spec: str, end: int | None, most: int) -> _Words:
    """One per worker: it lives from task to task."""
    return _Words(spec, end, most)


def read_spaceless(path: str) -> str:
    """The tokenizer file at ``path`` on the driver, as text. It has to drop white space: what stands between spaces is then encoded by itself."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    t = Tokenizer.from_str(spec)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    for text in ("a b", "it 's", "1 2\n3", "É ́a\t\t(x) ...", "b\r\x0b\x0cc "):
        if ids(text) != [i for w in text.encode().split() for i in ids(w.decode())]:
            raise ValueError("only tokenizers that drop white space and don't look beyond it are read")
    return spec


def encode_ordered(docs: DataFrame, path: str, end: int | None = None, part_bytes: int = 32 << 20, most_words: int = 1 << 19) -> DataFrame:
    """doc_id and ids of every whole text, packed in a binary (``unpacked`` makes them array<int>), in ascending order of doc_id over partitions and rows, nulls first.

    docs: doc_id and text; other columns are left out. A null text is empty; ``end`` is appended to every document's ids. Special
    tokens are not added; their strings in a text are encoded as the tokenizer does. Repeated rows are encoded each.
    path: a tokenizer file on the driver that drops white space. A worker encodes each distinct word once (as long as it
    knows fewer than ``most_words``) and sends packed ids, not texts. Parts are cut at quantiles of doc_id; an id that
    spans several is dealt over all of them by text, and equal rows in turn, so no id has to fit one task.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spaceless(path))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, unnamed, total = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.sum(F.octet_length("text"))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // part_bytes), 1)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if rows > unnamed and n > 1 else []
    bounds, first = np.array(cuts or [], np.int64), -(-unnamed * n // max(rows, 1))  # parts of rows without an id come first

    def encoded(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, seen = _words(spec.value, end, most_words), {}
        for batch in slices(batches, 512):
            # Each word of a slice is looked up once; equal ones share its number.
            lists = pc.ascii_split_whitespace(batch["text"])
            found = lists.flatten().dictionary_encode()
            distinct = found.dictionary.cast(pa.binary()).to_pylist()
            number = np.fromiter(map(words.__getitem__, distinct), np.int64, len(distinct))
            counts = lists.value_lengths().to_numpy()
            codes = np.insert(number[found.indices.to_numpy()], np.cumsum(counts), words[words.END])
            upto = np.concatenate([[0], np.cumsum(counts + 1)])
            ids, size = words.of(codes)
            ends = np.concatenate([[0], np.cumsum(size)])[upto].tolist()
            words.forget()
            docs_in = batch["doc_id"].fill_null(0).to_numpy()
            null = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            left, right = (np.searchsorted(bounds, docs_in, side) + first for side in ("left", "right"))
            left[null], right[null] = 0, max(first - 1, 0)
            part = left.copy()
            for i in np.flatnonzero(left < right).tolist():
                key = (None if null[i] else int(docs_in[i]), zlib.crc32(batch["text"][i].as_py().encode()))
                seen[key] = turn = seen.get(key, -1) + 1
                part[i] = left[i] + (key[1] + turn) % (right[i] - left[i] + 1)
            data = pa.array([_packed(ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch["doc_id"], data], names=["part", "doc_id", "ids"])

    out = docs.mapInArrow(encoded, "part int, doc_id long, ids binary")
    return out.repartitionById(n + first, F.col("part")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids").drop("part")


def unpacked(encoded: DataFrame) -> DataFrame:
    """doc_id and ids array<int> of rows from ``encode_ordered``, in their order."""

    def lists(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _lists(batch["ids"])], names=["doc_id", "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(lists, "doc_id long, ids array<int>")

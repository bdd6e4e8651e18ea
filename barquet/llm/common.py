"""Helpers shared by the text operators: tables, lineage, word hashes and packed integers."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Odd multipliers of the rolling polynomials and of the finalizer; any odd values do.
BASE_A, BASE_B, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
MASK = (1 << 64) - 1
#: Files of a written table of keys, a core: each file starts processes that set its rights, where there is no native library for that.
FILES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which the cluster shares; only where that is unset, as in tests, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barquet-"))
    return sc.getCheckpointDir()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` is ``value`` within it, and what it was afterwards."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared folder. Its shuffle files go once it is written, not when the driver's garbage is collected."""
    shared_folder(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()  # a query takes the setting of when it is made


def few(df: DataFrame) -> DataFrame:
    """``df``, of rows without texts, in as few partitions as keep all cores busy: those of a shuffle are worked off one after another, none is made larger."""
    return df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What runs within it sends Python workers so many rows of texts at a time, or what the session allows if that is fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write one."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Makes tables durable and, when no unwritten table needs them any more, deletes what they wrote."""

    def __init__(self) -> None:
        self.kept: list[DataFrame] = []

    def __call__(self, df: DataFrame, texts: bool = False) -> DataFrame:
        """``df``, written; in few files unless it is made of whole texts or has them."""
        self.kept.append(durable(df if texts else few(df)))
        return self.kept[-1]

    def release(self, *frames: DataFrame) -> None:
        """Deletes the files of ``frames``, or of all tables made so far."""
        for df in frames or tuple(self.kept):
            self.kept = [k for k in self.kept if k is not df]
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                delete(df.sparkSession, file.get())


@cache
def _libc():
    return ctypes.CDLL(None)


def tidy() -> None:
    """Gives memory that isn't in use back to the system: Python workers live on from task to task, and their free memory with them."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def tidily(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the work on one has freed goes back to the system before the next."""
    for batch in batches:
        yield batch
        tidy()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows: Python holds the texts of a part at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        tidy()


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys; of sorted batches, those of each key. Holds a run and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        at = [0, *cuts.tolist(), batch.num_rows]
        if held and any(held[-1][k][-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(at[:-2], at[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(i, j - i)])
            held = []
        held.append(batch.slice(at[-2], at[-1] - at[-2]))
    if held:
        yield pa.Table.from_batches(held)


class WordHashes(dict):
    """64-bit hash of each word seen, computed once per word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Words of more bytes are hashed one by one; bytes that are hashed at once.
LONG_WORD, PIECE = 64, 1 << 16
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: A number for each byte, 0 for white space, and the powers by which it counts at its place in a word.
_NUMBERS = np.where(_SPACE, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE_B)))
_POWERS = np.cumprod(np.full(LONG_WORD, BASE_A, np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, which ASCII white space divides, without making the words."""
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(~_SPACE[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    cuts = [0, *np.searchsorted(starts, np.arange(PIECE, len(data), PIECE)).tolist(), len(starts)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            own, low, high = starts[i:j], starts[i], ends[j - 1]
            place = np.minimum(np.arange(low, high) - np.repeat(own, np.diff(own, append=high)), LONG_WORD - 1)
            out[i:j] = mixed(np.add.reduceat(_NUMBERS[data[low:high]] * _POWERS[place], own - low))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for few of them faster than ``np.unique``."""
    values = np.sort(values)
    return values[np.diff(values, prepend=~values[:1]) != 0]


def rolling(h: np.ndarray, k: int, base: int = BASE_A) -> np.ndarray:
    """Hash of ``k`` consecutive values from each start; ``len(h) - k + 1`` of them, at least 0."""
    if len(h) < k:
        return np.zeros(0, np.uint64)

    def poly(m: int) -> np.ndarray:
        if m == 1:
            return h
        half = poly(m // 2)
        n = m // 2
        both = half[: len(half) - n] * np.uint64(pow(base, n, MASK + 1)) + half[n:]
        if m % 2:
            both = both[:-1] * np.uint64(base & MASK) + h[m - 1 :]
        return both

    return mixed(poly(k))


def pack(values: np.ndarray) -> bytes:
    """Values as byte planes, of their differences if they are integers; sorted or alike values then compress well."""
    v = np.ascontiguousarray(values)
    if v.dtype.names:
        return b"".join(pack(v[c]) for c in v.dtype.names)
    u = v.view(f"u{v.dtype.itemsize}")
    return np.diff(u, prepend=u[:1] * 0).view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    if dtype.names:
        n, at = len(data) // dtype.itemsize, 0
        out = np.empty(n, dtype)
        for c in dtype.names:
            out[c] = unpack(data[at : (at := at + n * dtype[c].itemsize)], dtype[c])
        return out
    d = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T)
    return np.cumsum(d.view(f"u{dtype.itemsize}").ravel(), dtype=f"u{dtype.itemsize}").view(dtype)

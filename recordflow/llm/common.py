"""Helpers that several operators of this subpackage use.

Bytes and words are handled a chunk of whole documents at a time, as numpy
arrays over Arrow's buffers: no Python object is made per place of a word or byte.
A word's hash is of its bytes, eight at a time. The hash of a window is
joined from those of its halves, and scrambled at each step, so that no two windows
can cancel out in a sum, whatever their words are.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import hadoop_path, written

BATCH_BYTES = 8 << 20  # of an Arrow batch on its way to Python; rows of whole documents are large
CHUNK_BYTES = 1 << 20  # text handled at once; a longer document is a chunk of its own
LONG_WORD = 256  # bytes
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
U64 = np.uint64


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Plans run here delete their shuffle files when they end; only their results go on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors. Shuffle files
    that only the written plan needed go with its end.
    """
    with freeing(df.sparkSession):
        return written(df, name)


def light_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session has a smaller bound already.

    The bound stays set, as the plans that need it are run later, by the caller.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := int(spark.conf.get(name).rstrip("b"))) < 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trim() -> None:
    """Give memory that a worker has freed back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``materialise`` that no later plan reads."""
    for df in tables:
        path, store = hadoop_path(df.sparkSession, df._recordflow_path)
        store.delete(path, True)


def partitions(spark: SparkSession) -> int:
    """How many partitions an exchange of packed rows gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of what stands at left followed by what stands at right; both are scrambled already."""
    return mix(left * U64(SALTS[0]) + right)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k values that start at 0, 1 and so on."""
    n, done, out, size, part = len(h) - k + 1, 0, None, 1, mix(h ^ U64(SALTS[1]))
    if n <= 0:
        return np.zeros(0, U64)
    while True:  # a window is made up of windows of 1, 2, 4 and so on, by the binary digits of k
        if k & size:
            here = part[done : done + n]
            out = here if out is None else join_hashes(out, here)
            done += size
        if 2 * size > k:
            return out
        part = join_hashes(part[:-size], part[size:])
        size *= 2


@functools.cache
def is_space() -> np.ndarray:
    """Which bytes part words: 0x09-0x0D and 0x20."""
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


@functools.cache
def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


class Chunk:
    """Some whole documents: ids, their bytes end to end, and the bounds of each."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, rows: pa.RecordBatch):
        self.ids, self.data, self.bounds, self.rows = ids, data, bounds, rows

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def chunks(batches: Iterable[pa.RecordBatch], id_name: str = "doc_id", text_name: str = "text", most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut Arrow batches into chunks of about ``most`` bytes of text; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(text_name).cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        ids = batch.column(id_name).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(ids):
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), len(ids))
            yield Chunk(ids[at:end], data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], batch.slice(at, end - at))
            at = end
    trim()


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the ``size`` bytes (1 at least) from each start on.

    Eight bytes at a time are joined on; two different words of up to eight bytes of one length never
    have the same hash. Words longer than LONG_WORD are hashed one by one.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    part = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    value = lambda at, n: part[at] & (~U64(0) >> (U64(64) - U64(8) * np.minimum(n, 8).astype(U64)))
    out = mix(mix(size.astype(U64) + U64(salt)) ^ value(start, size))
    rows, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rows):
        out[rows] = join_hashes(out[rows], value(start[rows] + done, size[rows] - done))
        done += 8
        rows = rows[size[rows] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), seed=salt)
    return out


class Words:
    """The words of a chunk: byte start and end of each, hashes, and each document's first word."""

    def __init__(self, chunk: Chunk, lower: bool = False, parting: np.ndarray | None = None):
        data = chunk.data
        n = len(data)
        word = ~(is_space() if parting is None else parting)[data]
        first = np.zeros(n + 1, bool)
        first[chunk.bounds] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | first[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        self.docs = np.searchsorted(self.start, chunk.bounds)  # of document i: words docs[i]:docs[i + 1]
        self.data = lower_table()[data] if lower else data
        self.is_letter = word

    @functools.cached_property
    def hash(self) -> np.ndarray:
        """A hash of each word."""
        return span_hashes(self.data, self.start, self.end - self.start, SALTS[0])

    @functools.cached_property
    def check(self) -> np.ndarray:
        """Another hash of each word, independent of the first."""
        return span_hashes(self.data, self.start, self.end - self.start, SALTS[1])

    def letters(self) -> np.ndarray:
        """The words' bytes, end to end."""
        return self.data[self.is_letter]

    def __len__(self) -> int:
        return len(self.start)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))

    def windows(self, k: int) -> np.ndarray:
        """Words that start a window of k words inside one document."""
        last = np.repeat(self.docs[1:], np.diff(self.docs))
        at = np.arange(len(self))
        return at[at + k <= last]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one value."""
    return np.array(np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,)) if len(data) > 7 else (), U64)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (8 at least) from each place in a on are those from b on."""
    out = np.ones(len(a), bool)
    rows, at = np.arange(len(a)), 0
    part = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)) if len(a) else None
    while len(rows):
        step = np.minimum(at, size[rows] - 8)
        same = part[a[rows] + step] == part[b[rows] + step]
        out[rows[~same]] = False
        at += 8
        rows = rows[same & (size[rows] > at)]
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, with the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def by_document(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by document and then value; documents are numbers of a chunk's rows."""
    if len(doc) and doc.max() >= 1 << 16:
        return np.lexsort((values, doc))
    order = np.argsort(values)
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The exchange partition of a hash, by its upper 32 bits."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def binary_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def exchange(rows: DataFrame, parts: int) -> DataFrame:
    """Deal packed rows by their ``part`` column, each value of it to one of ``parts`` partitions."""
    return rows.repartition(parts, F.col("part"))


def documents_view(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Only id and text, whatever else the table holds."""
    light_batches(docs.sparkSession)
    return docs.select(F.col(id_name).cast("long").alias("doc_id"), F.col(text_name).cast("string").alias("text"))

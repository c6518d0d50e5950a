"""What the text operators share: byte views of Arrow batches, vectorised tokens and hashes.

Texts are handled as the UTF-8 bytes of an Arrow string column, several documents at a time,
so that splitting, lower-casing and hashing are numpy operations without a Python object per
word. A null text is an empty text everywhere.

Hashes are 64-bit rolling hashes over randomly mapped bytes. Where equal hashes stand for equal
strings, records are dealt to buckets by a second mix of the hash, and the chance that any two of
n different strings meet is about n * n / 2**65.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralux import session

#: Bytes of text that are looked at together, and bytes of text a bucket of a shuffle stands for.
CHUNK_BYTES = 2_000_000
BUCKET_BYTES = 8_000_000
#: Rows of an Arrow batch: texts can be long, so batches are kept short.
BATCH_ROWS = 1_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What separates alphanumeric words: all ASCII but digits and letters.
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[0:0x30] = IS_BREAK[0x3A:0x41] = IS_BREAK[0x5B:0x61] = IS_BREAK[0x7B:0x80] = True

_RNG = np.random.Generator(np.random.PCG64(20_240_917))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 4096), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power_table(_BASE, len(data)), out=self._sums[1:])
        self._undo = _power_table(_INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._undo[starts])


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ``breaks``, and each row's first word (n + 1 values)."""
    inside = ~breaks[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def chunked_texts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts; what was freed goes back when the partition ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = byte_view(batch.column(batch.schema.get_field_index(text)))
        for a, b in chunks(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
    batch = data = offsets = None
    free_memory()


def free_memory() -> None:
    """Gives back what a worker has freed, before it waits for its next partition."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library keeps freed memory and can trim it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, unless the session asks for fewer still."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame, label: str) -> DataFrame:
    """``session.cut``; the shuffle files behind the table are given up as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return session.cut(df, label, plain=False)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bucket_count(n_bytes: int, per: int = BUCKET_BYTES) -> int:
    """Buckets of a shuffle, in proportion to the text it stands for."""
    return max(1, -(-n_bytes // per))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket by bits that are independent of the order of ``hashes``."""
    return (mix(hashes, 1) % np.uint64(n)).astype(np.int64)


def dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each bucket's keys, in their order."""
    bucket = bucket_of(keys, n)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), order[bounds[b] : bounds[b + 1]]


def to_varint(values: np.ndarray) -> bytes:
    """Seven bits a byte; the last byte of a value has its high bit unset."""
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return b""
    width = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        width += values >= np.uint64(1 << (7 * k))
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    for k in range(int(width.max())):
        mine = width > k
        byte = (values[mine] >> np.uint64(7 * k)).astype(np.uint64) & np.uint64(127)
        out[at[mine] + k] = byte.astype(np.uint8) | np.where(width[mine] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_varint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).astype(np.int64)


def group_ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def take_arrays(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]

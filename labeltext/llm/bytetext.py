"""Vectorised work on the UTF-8 bytes of an Arrow text column.

An Arrow string column is one byte buffer plus offsets. The functions here work
on that buffer with numpy, for all texts of a slice at once, so that no Python
object is made per word. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 18

BATCH_ROWS = 1000
RELEASE_BYTES = 1 << 24

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over a uint64 array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 2)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send texts to Python at most ``BATCH_ROWS`` at a time; the
    default of 10,000 rows would put that many long texts into memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; every ``RELEASE_BYTES`` and at the end, freed memory goes back
    to the system. Workers live on between the stages of a job, beside a JVM that
    may have grown."""
    seen = 0
    for batch in batches:
        seen += batch.nbytes
        yield batch
        del batch
        if seen >= RELEASE_BYTES:
            seen = 0
            _release()
    _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every maximal run without ``separators`` (a
    table of 256; space and U+0009 to U+000D), in order; runs never cross texts."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    full = ~separators[data]
    begins = np.zeros(n + 1, dtype=bool)  # where a text begins
    begins[offsets] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | begins[1:n]
    end = full.copy()
    end[:-1] &= ~full[1:] | begins[1:n]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes, for :func:`span_hash`."""
    up, _ = _power_table(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    _, down = _power_table(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of every text: (hash, text number), sorted by
    text and hash. Words are compared with A-Z lower-cased. A text with fewer
    than ``width`` words has its whole word sequence as its one shingle, a text
    without words none."""
    low = lower_ascii(data)
    s, e, doc = words(low, offsets)
    if not len(s):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    word = span_hash(prefix_hash(low), s, e)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    left = first[doc] + count[doc] - np.arange(len(doc))  # words from here to the end of the text
    at = np.flatnonzero((left >= width) | ((count[doc] < width) & (np.arange(len(doc)) == first[doc])))
    size = np.minimum(count[doc[at]], width)
    h = mix64(size.astype(U64))
    for k in range(width):
        on = size > k
        h[on] = mix64(h[on] * U64(0xD6E8FEB86659FD93) + word[at[on] + k])
    owner = doc[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]

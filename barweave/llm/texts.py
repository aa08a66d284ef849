"""Words and hashes of whole texts, computed for a batch of documents at once with numpy.

The helpers run inside ``mapInArrow`` tasks. Every separator is an ASCII byte, so words are found in the UTF-8
bytes themselves. A hash is a polynomial in an odd base modulo 2**64 over random byte values, taken from running sums,
then mixed; equal byte strings have equal hashes in every process, and two different strings collide with
probability about 2**-64.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+``.
SPACES = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z counts as a-z.
SYMBOLS = _table(bytes(b for b in range(128) if not chr(b).isalnum()))

_VALUES = np.random.RandomState(20).randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]


class _Powers:
    """Growing tables of a base and its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> _Powers:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, have, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(pow(_BASE, -1, 1 << 64), have, 1 << 64))])
        return self


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for ascending, non-overlapping or sliding spans; position-independent."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + BLOCK)))
        hi = int(ends[j - 1])
        powers = _POWERS.upto(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[lo:hi] * powers.up[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * powers.down[a] + (b - a).astype(np.uint64)
        i = j
    return mixed(out)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values; entry i belongs to ``values[i:i+size]``."""
    starts = np.arange(max(0, len(values) - size + 1))
    return span_hashes(values, starts, starts + size)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Words:
    """The words of some documents.

    ``hashes`` has one entry a word, ``starts`` and ``ends`` are its bytes in ``data``, and document d owns the words
    ``first[d]:first[d + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool) -> None:
        self.data = data
        inside = ~separators[data]
        begin, end = inside.copy(), inside
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        if len(data):
            glued = inside[:-1].copy()
            glued[cut - 1] = False
            begin[1:] &= ~glued
            glued = inside[1:].copy()
            glued[cut - 1] = False
            end[:-1] &= ~glued
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        values = (_LOWER if lower else _VALUES)
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):  # block by block: the byte values take eight times the bytes
            lo = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.starts, lo + BLOCK)))
            part = values[data[lo : int(self.ends[j - 1])]]
            out[i:j] = span_hashes(part, self.starts[i:j] - lo, self.ends[i:j] - lo)
            i = j
        self.hashes = out

    def owners(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy() -> None:
    """Give memory that a worker no longer uses back to the machine: workers live on from one operator to the next."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens:
        tokens.forget_idle()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text, so that working memory follows the longest text, not the batch."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    tidy()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session follow the texts' size, not only the number of rows: a task then holds some MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def words(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    return Words(*utf8(column), separators, lower)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row d holds ``values[first[d]:first[d + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))

"""Byte-level text kernels shared by the training-data operators.

Everything here works on whole Arrow string columns at once with numpy: no per-word Python loop.
Words are maximal runs of bytes outside space and 0x09-0x0D, which on UTF-8 equals the regular
expression ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; bounds the numpy temporaries of a Python worker (about 60 bytes a byte).
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0xD6E8FEB86659FD93  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240229).integers(0, 1 << 64, size=256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    kept = _powers.get(base)
    if kept is None or len(kept) <= n:
        size = 1 << max(12, int(n).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        kept = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if column.type == pa.large_string() else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):  # arrays of a megabyte and more go back to the system as soon as they are freed
    _LIBC.mallopt(-3, 1 << 20)


def give_back() -> None:
    """Return what the process has freed to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run):
    """A function of batches that gives memory back at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def chunks(batches, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `most` bytes of `column` (one row at least)."""
    try:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, offsets = string_buffers(batch.column(batch.schema.get_field_index(column)))
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
                end = min(max(end, at + 1), batch.num_rows)
                yield batch.slice(at, end - at)
                at = end
    finally:
        give_back()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts:ends] for each span: a random polynomial, then mixed with the length."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * _power(_BASE, n)[:n], out=total[1:])
    own = (total[ends] - total[starts]) * _power(_INVERSE, n)[starts]
    return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), then begin[1], ...: for gathering ranges."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)


class Words:
    """Word spans and 64-bit word hashes of a string column.

    starts, ends: byte positions in `data`; first: for each row the index of its first word, with the
    total at the end (so row i has the words first[i]:first[i+1]).
    """

    def __init__(self, column: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE):
        self.data, self.offsets = string_buffers(column)
        self.raw = self.data
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~breaks[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begins, stops = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            stops[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hash of each word's bytes (its first `most` only, if given): a random polynomial,
        then mixed with the length."""
        return span_hashes(self.data, self.starts, self.ends if most is None else np.minimum(self.ends, self.starts + most))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


NGRAM_STEP = np.uint64(0x9FB21C651E98DF25)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive items that start at each position; len(hashes) - n + 1 values."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out = out * NGRAM_STEP + hashes[j : j + size]
    return mix(out)


def ngram_rows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of the n-grams that lie wholly in one row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return np.arange(len(rows)) - begin[rows] + first[:-1][rows], rows


def crc_mod(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of each id written in decimal, modulo `modulus`; null ids give 0."""
    import zlib

    return np.array([0 if x is None else zlib.crc32(str(x).encode()) % modulus for x in ids.to_pylist()], dtype=np.int64)

"""Vectorised text primitives on UTF-8 buffers.

The byte-level kernels below work on a whole chunk of documents at once, straight on Arrow's string buffers: no Python
loop runs per word or per character. White space is the six bytes 20 and 09-0D, lower-casing is A-Z only, both as the
contracts of the operators ask.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are worked through in chunks of about so many bytes, which bounds the memory of the temporaries.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def _salt(n: int) -> np.uint64:
    return U64(n * int(_GOLD) & (1 << 64) - 1)


_BYTE = mix(np.arange(1, 257, dtype=U64) * _GOLD)
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n. Those for a chunk are kept between calls, longer ones, for a text beyond it, are not."""
    global _pow, _inv
    if len(_pow) >= n:
        return _pow, _inv
    size = max(n, 2 * CHUNK_BYTES + 1)
    with np.errstate(over="ignore"):
        step = np.full(size, _BASE, dtype=U64)
        step[0] = 1
        power = np.cumprod(step, dtype=U64)
        step[1:] = pow(_BASE, -1, 1 << 64)
        inverse = np.cumprod(step, dtype=U64)
    if n <= 2 * CHUNK_BYTES + 1:
        _pow, _inv = power, inverse
    return power, inverse


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for every span, by one prefix sum of a polynomial hash."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * _GOLD)


def tidy(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system at its end; a worker outlives many stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cased copy: A-Z and the Latin-1 capitals, whose UTF-8 is C3 80 to C3 9E."""
    out = LOWER[data]
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: bytes = b"", after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes, each between two markers, put together; and their offsets (n + 1)."""
    size = ends - starts + len(before) + len(after)
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offsets[-1], dtype=np.uint8)
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    source = np.repeat(starts - len(before), size) + within
    text = (within >= len(before)) & (within < np.repeat(size - len(after), size))
    out[text] = data[source[text]]
    for i, b in enumerate(before):
        out[offsets[:-1] + i] = b
    for i, b in enumerate(after):
        out[offsets[1:] - len(after) + i] = b
    return out, offsets


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `size` bytes; a longer text is a run of its own."""
    data, offsets = string_buffers(column)
    first, n, size = 0, len(offsets) - 1, size or CHUNK_BYTES
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the place of each row's first word (n + 1). space: which bytes part words."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words inside a row, and the place of its first word. bounds: first word of each row (n + 1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    out = mix(words[:m] + _salt(n))
    for i in range(1, n):
        out = mix(out * U64(3) + words[i : m + i])
    whole = np.ones(m, dtype=bool)
    for i in range(1, n):
        at = bounds[1:-1] - i
        at = at[(at >= 0) & (at < m)]
        whole[at] = False
    at = np.flatnonzero(whole)
    # a row with fewer than n words can hide behind a later row's boundary
    row_end = bounds[1:][np.searchsorted(bounds[1:], at, "right")]
    at = at[at + n <= row_end]
    return out[at], at


class Windows:
    """Rolling hashes of the runs of words inside rows, of any length, from one prefix sum of a polynomial over the words' hashes.

    Rolling on by a word takes one term off and adds one: here both ends come from the prefix sums, for all windows of a length at once.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray) -> None:
        self.power, self.inverse = _powers(len(words) + 1)
        self.total = np.zeros(len(words) + 1, dtype=U64)
        np.cumsum(words * self.power[: len(words)], out=self.total[1:])
        self.room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))  # words left in the row, from each one on
        self.rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of n words inside a row, and the place of its first word."""
        at = np.flatnonzero(self.room >= n)
        return mix((self.total[at + n] - self.total[at]) * self.inverse[at] + _salt(n)), at


def rows_of(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The row that holds each place."""
    return np.searchsorted(bounds, places, "right") - 1


def repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks over the entries: the key occurs again in the same row, and the entry isn't its first there."""
    again, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        keys = mix(keys ^ mix((rows + 1).astype(U64) * _GOLD))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
    return again, later


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Mask over `size` places of those inside [start, start + length) of any start."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + length, size), 1)
    return np.cumsum(edge[:-1]) > 0


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word shingle; a row with 1 to n - 1 words gives its whole sequence as one."""
    keys, at = ngram_hashes(words, bounds, n)
    rows = rows_of(at, bounds)
    count = np.diff(bounds)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            first = bounds[:-1][short]
            out = mix(words[first] + _salt(k))
            for i in range(1, k):
                out = mix(out * U64(3) + words[first + i])
            keys, rows = np.concatenate([keys, out]), np.concatenate([rows, short])
    return rows, keys

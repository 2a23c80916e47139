"""Vectorised hashes of the words of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

BASE = 0xD1342543DE82EF95
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 18  # bytes that are hashed by one running sum
_LONG = 64  # longer words are hashed alone; periodic ones could collide as polynomials
_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, up to _SPAN, and a random value for each byte."""
    if not _TABLES:
        inverse = pow(BASE, -1, 1 << 64)
        for name, b in (("pow", BASE), ("inv", inverse)):
            out = np.ones(_SPAN + 1, np.uint64)
            k = 1
            while k < len(out):  # doubling: out[k:2k] = out[:k] * b^k
                out[k : 2 * k] = out[: min(k, len(out) - k)] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            _TABLES[name] = out
        _TABLES["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    return _TABLES["pow"], _TABLES["inv"], _TABLES["byte"]


def byte_values() -> np.ndarray:
    """A random value for each byte."""
    return _powers()[2]


def slices(column, most: int = 1 << 19) -> Iterator:
    """Parts of a string column of about ``most`` bytes, a row at least."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row edges of a large_string column; a null row is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return buf, edges - edges[0]


def word_hashes(buf: np.ndarray, edges: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, row edges) of maximal runs of bytes outside ``space`` (256 flags).

    Row r has the words from row_edges[r] to row_edges[r + 1]; a row's edge also ends a word.
    """
    n = len(buf)
    if not n:
        zero = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), zero, zero, np.zeros(len(edges), np.int64)
    gap = space[buf]
    begin = ~gap
    begin[1:] &= gap[:-1]
    inner = edges[(edges > 0) & (edges < n)]
    begin[inner] = ~gap[inner]
    starts = np.flatnonzero(begin)
    stop = ~gap
    stop[:-1] &= gap[1:]
    stop[inner - 1] = ~gap[inner - 1]
    ends = np.flatnonzero(stop) + 1
    h = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # words of a bounded span at a time, a word at least
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN, "right")))
        h[at:to] = _hashes(buf[starts[at] : ends[to - 1]], starts[at:to] - starts[at], ends[at:to] - starts[at])
        at = to
    return h, starts, ends, np.searchsorted(starts, edges, "left")


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words from starts to ends: polynomials of short ones, taken from running sums; long ones by xxh3."""
    out = np.empty(len(starts), np.uint64)
    n = ends - starts
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(memoryview(buf[starts[i] : ends[i]]))
    short = n <= _LONG
    if short.any():
        power, inverse, byte = _powers()
        total = np.zeros(min(len(buf), _SPAN) + 1, np.uint64)
        np.cumsum(byte[buf[:_SPAN]] * power[: len(total) - 1], out=total[1:])
        lo, hi = starts[short], ends[short]
        out[short] = mix((total[hi] - total[lo]) * inverse[lo] + n[short].astype(np.uint64) * _ODD)
    return out


def spaces(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out

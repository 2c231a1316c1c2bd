"""Vectorised words of Arrow text columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` within one text.
All of these are single bytes in UTF-8, so the texts of a batch are scanned as
one byte array, a megabyte at a time, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 2 << 20  # texts worked on together
_CUT = 1 << 20  # bytes hashed together
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2^64

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes outside terms: all of ASCII but digits and letters.
NO_TERM = np.arange(256) < 128
for _lo, _hi in ("09", "AZ", "az"):
    NO_TERM[ord(_lo) : ord(_hi) + 1] = False

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every bit of a 64-bit value."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) | np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, _CUT + 4096)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", back)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches, column: str = "text", size: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of the batches with about ``size`` bytes of text (a longer
    text alone), as (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffer(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word, in order; ``outside`` marks the bytes that
    are in none."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~outside[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of every word."""
    return np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of every word: a polynomial in the word's bytes, taken from
    running sums; the scan is cut between words."""
    values, out, i = _byte_values(seed), np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _CUT, "right")))
        s, e = starts[i:j] - lo, ends[i:j] - lo
        size = int(e[-1])
        up, down = _power(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[lo : lo + size]] * up[:size], out=sums[1:])
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def runs(hashed: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` consecutive words that start at each word, and whether
    they lie in one text."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + hashed[k : k + n]
    return mix(out), doc[:n] == doc[size - 1 :]


def same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes found at its place in ``other`` (which must
    reach as far), compared a megabyte at a time."""
    size = ends - starts
    out, upto, i = np.ones(len(starts), bool), np.cumsum(size), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _CUT, "right")))
        n = size[i:j]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        differ = data[at + np.repeat(starts[i:j], n)] != other[at + np.repeat(begins[i:j], n)]
        if differ.any():
            out[i + np.searchsorted(first, np.flatnonzero(differ), "right") - 1] = False
        i = j
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct word, and the distinct word of every word. Words
    are grouped by hash; should two share one, by their bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, kind = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, model = ends - starts, first[kind]
    if (size == size[model]).all() and same(data, starts, ends, data, starts[model]).all():
        return first, kind
    raw, known = data.tobytes(), {}
    kind = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.unique(kind, return_index=True)[1], kind

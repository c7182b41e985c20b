"""Vectorised word kernels over Arrow string buffers.

All work is on UTF-8 bytes: the word classes of the operators are ASCII classes plus "every
byte of a non-ASCII character", so a byte table decides exactly. Hashes are 64-bit and stable
across processes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.arange(256)
#: bytes of words that end at ASCII white space, and of words of 0-9 a-z and non-ASCII characters
NOT_SPACE = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))
ALNUM = ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
LOWER = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B).astype(np.uint8)

_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_M = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _powers or _powers[base][0].size < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null reads as the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of about `most` bytes, one row at least."""
    data, off = text_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a row's end ends a word."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    s, e = off[:-1][off[:-1] < data.size], off[1:][off[1:] > 0] - 1
    first[s], last[e] = inside[s], inside[e]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(_P, data.size + 1)
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (rows are not looked at)."""
    if hashes.size < k:
        return np.zeros(0, np.uint64)
    up, down = powers(_Q, hashes.size + 1)
    total = np.zeros(hashes.size + 1, np.uint64)
    np.cumsum(hashes * up[: hashes.size], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: hashes.size - k + 1] + np.uint64(k))


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """For words with sorted row numbers: n + 1 positions between which each row's words stand."""
    return np.searchsorted(rows, np.arange(n + 1))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all elements of the spans that begin at starts, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each string among the distinct ones, where each distinct one stands first). Equal hashes are not trusted."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    same = (size == size[first][which]).all()
    if same:
        same = (data[ragged(starts, size)] == data[ragged(starts[first][which], size)]).all()
    if not same:
        raw, seen = data.tobytes(), {}
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return which, first

"""Vectorised scanning of Arrow text columns: words, their hashes and their shingles, without a Python object per word.

Texts are scanned as UTF-8 bytes. Every byte class used here is closed under UTF-8 (separators and letters below 0x80 are
single bytes), so byte positions fall on character boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once; a longer text is scanned alone.
SLICE = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)

#: 1 in a word of any bytes but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: 1 in a word of ASCII letters and digits and of all characters beyond ASCII.
WORDY = np.zeros(256, bool)
WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        made = []
        for base in (_R, inverse):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        if n > 4 * SLICE:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without structure (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MULT[0]
    x ^= x >> np.uint64(27)
    x *= _MULT[1]
    x ^= x >> np.uint64(31)
    return x


def slices(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inw = inside[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inw[:-1]
    starts = np.flatnonzero(inw & (~before | fresh[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inw[1:]
    ends = np.flatnonzero(inw & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, upper-case ASCII taken as lower-case."""
    up, down = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def shingles(wh: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, and for each text the index of its first one.

    A text of fewer words has one, of all its words; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), np.uint64)
    start = np.repeat(first[:-1] - at[:-1], count) + np.arange(len(out))
    size = np.repeat(np.minimum(n, width), count)
    padded = np.concatenate([wh, np.zeros(width, np.uint64)])
    for j in range(width):
        part = padded[start + j] * _MULT[j % 5] + np.uint64(j + 1)
        out += np.where(size > j, mix(part), np.uint64(0))
    return mix(out + size.astype(np.uint64)), at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and the new first indices."""
    parts = [np.unique(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each text's values (0 for none), modulo 2**64 for unsigned ones."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[at[1:]] - total[at[:-1]]


def shingle_sets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct 5-word shingles, first indices) over white-space words with A-Z lower-cased."""
    for a, b, data, bounds in slices(col):
        s, e, first = words(data, bounds, SPACED)
        u, at = distinct(*shingles(hashes(data, s, e), first))
        yield a, b, u, at

"""Vectorised word kernels over Arrow string columns: word bounds, 64-bit word hashes and rolling n-gram hashes.

Words are runs without ASCII white space. All functions work on whole texts, in blocks of documents of about
BLOCK_BYTES (one longer document is a block of its own), so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of letters and digits; all bytes of multi-byte characters count as letters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_IBASE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a 64-bit value over all its bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        a = np.full(max(n, 1), base, np.uint64)
        a[0] = 1
        have = np.cumprod(a, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have


class Words(NamedTuple):
    """Words of documents first..last-1 of a batch. buf: their bytes; start, end: byte bounds in buf; doc: number of
    the document in the block; n: words by document."""

    first: int
    last: int
    buf: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n: np.ndarray

    def hashes(self, buf: np.ndarray | None = None, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word (of its first `prefix` bytes at most), of buf's bytes if given."""
        buf = self.buf if buf is None else buf
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK_BYTES, "right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            p = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[buf[lo:hi]] * _power(_BASE, hi - lo)[: hi - lo], out=p[1:])
            s, e = self.start[i:j] - lo, end[i:j] - lo
            out[i:j] = (p[e] - p[s]) * _power(_IBASE, hi - lo + 1)[s] + (e - s).astype(np.uint64) * _U(0x8CB92BA72F3D8DD7)
            i = j
        return mixed(out)

    def word_starts(self) -> np.ndarray:
        """Number of the first word of each document, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.n)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def blocks(column: pa.Array, letters: bool = False, of: np.ndarray | None = None) -> Iterator[Words]:
    """Words of a string column by block. letters: words are runs of letters and digits instead; of: runs of the bytes
    that this table marks."""
    data, bounds = buffers(column)
    keep = of if of is not None else ALNUM if letters else ~SPACE
    i, total = 0, len(bounds) - 1
    while i < total:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK_BYTES, "right")) - 1)
        buf, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        inside = keep[buf]
        first, last = inside.copy(), inside.copy()
        if len(buf):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins = at[:-1][at[:-1] < len(buf)]
            first[begins] = inside[begins]
            ends = at[1:][at[1:] > 0] - 1
            last[ends] = inside[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(at, start, "right") - 1
        yield Words(i, j, buf, at, start, end, doc, np.bincount(doc, minlength=j - i))
        i = j


def ngrams(h: np.ndarray, doc: np.ndarray, k: int, mult: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all k consecutive words of one document, and the numbers of their first words."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
    m, out = _U(mult), h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= m
        out += h[j : len(h) - k + 1 + j]
    return mixed(out[at]), at


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned to Spark's signed long, bit for bit."""
    return h.view(np.int64)

"""Vectorised text statistics over Arrow string columns (numpy, inside Spark tasks).

A batch of texts is one byte buffer plus offsets. Word and line boundaries, 64-bit
hashes and window hashes are computed for the whole buffer at once. Buffers are cut at
document boundaries into slices of about ``SLICE_BYTES``, so temporary arrays stay
bounded; a longer text is a slice of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_VALUE_NOCASE = BYTE_VALUE.copy()
BYTE_VALUE_NOCASE[ord("A"):ord("Z") + 1] = BYTE_VALUE[ord("a"):ord("z") + 1]
BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 2**64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` per slice of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross a document boundary."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[edges - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words (runs without ASCII white space)."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the \\n-split lines; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    # The break that ends a document's last byte opens an empty line of the same document, at
    # the next document's offset: documents are told apart by counting, not by position.
    per_doc = np.diff(np.searchsorted(breaks, offsets)) + 1
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    firsts = np.cumsum(per_doc) - per_doc
    starts = np.empty(len(doc), np.int64)
    ends = np.empty(len(doc), np.int64)
    is_first = np.zeros(len(doc), bool)
    is_first[firsts] = True
    starts[firsts] = offsets[:-1]
    starts[~is_first] = breaks + 1
    is_last = np.zeros(len(doc), bool)
    is_last[firsts + per_doc - 1] = True
    ends[is_last] = offsets[1:]
    ends[~is_last] = breaks
    return starts, ends, doc


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, nocase: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial prefix sums over random byte values."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum((BYTE_VALUE_NOCASE if nocase else BYTE_VALUE)[data] * powers(BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(word_hash: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first word, and hashes, of all windows of ``size`` words within a document."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[size - 1:])
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x5851F42D4C957F2D) + word_hash[i:i + n]
    return at, mix(h[at])


def repeated(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where ``(group, key)`` occurs at least twice."""
    both = mix(key + mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = hit
    return out


def not_first(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where ``(group, key)`` has occurred at an earlier position."""
    both = mix(key + mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    s = both[order]
    out = np.zeros(len(s), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def per_doc(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n_docs).astype(np.int64)

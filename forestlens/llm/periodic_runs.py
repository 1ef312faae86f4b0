"""Periodic runs of words in each text, found with string synchronising sets.

A run is a stretch of words with smallest period q, at least ``max(min_words, MIN_POWER * q)`` long, that
no neighbouring word extends. At each dyadic scale t = 4, 8, 16, ... the windows of t words get hash
identifiers, and position i is selected if the least identifier of positions i to i + t is that of i or of
i + t. That depends on the 2t words from i only, so equal contexts are selected alike. Inside a run of
period t <= q < 2t a selected position lies in any t neighbours, and its next equal context is exactly q
words on: equal-context neighbours propose every period, and comparing words extends each proposal to its
whole run. Windows of period up to t / 4 get no identifier, which keeps the selected set sparse where a text
is highly periodic; the runs that cover them were found at smaller scales, the smallest periods (1 to 3) by
comparing neighbours directly. The work is the same for any text: no cap on length, runs or periods.

Words are compared by 64-bit hashes. Defined results: a null or empty text has no words and no runs; rows are
judged one by one, so repeated ids change nothing; an empty table gives no rows; other columns are kept and
never read. Texts are taken in slices of documents; one long text takes about 90 bytes a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forestlens.llm import textops as T
from forestlens.llm.common import cell

MIN_POWER = 4
SMALL = 4                    # periods below are found directly; the first scale
LONG_WORD = 1 << 16
NO_ID = np.uint64(2**64 - 1)
_RUN = "struct<start:long,length:long,period:long>"


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, over about a slice of bytes at a time; words over ``LONG_WORD`` bytes one by one."""
    out = np.empty(len(starts), np.uint64)
    stops = np.append(np.flatnonzero(ends - starts > LONG_WORD), len(starts))
    lo = at = 0
    while lo < len(starts):
        if lo == stops[at]:
            out[lo] = xxhash.xxh3_64_intdigest(data[starts[lo]:ends[lo]].tobytes())
            lo, at = lo + 1, at + 1
            continue
        base = starts[lo]
        hi = min(max(lo + 1, int(np.searchsorted(ends, base + T.SLICE_BYTES, "right"))), int(stops[at]))
        out[lo:hi] = T.span_hashes(data[base:ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


def sliding_min(x: np.ndarray, scale: int) -> np.ndarray:
    """Minimum of ``x[i] .. x[i + scale]``, for a power of two ``scale``; the last ``scale`` entries are not whole."""
    m, size = x.copy(), 1
    while size < scale:
        m[:-size] = np.minimum(m[:-size], m[size:])
        size *= 2
    m[:-scale] = np.minimum(m[:-scale], x[scale:])
    return m


def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def extended(h: np.ndarray, lo: int, hi: int, start: int, stop: int, period: int) -> tuple[int, int]:
    """The maximal stretch around positions ``start .. stop - 1`` of ``[lo, hi)`` where ``h[x] == h[x + period]``."""
    step = 16
    while start > lo:
        a = max(lo, start - step)
        differ = np.flatnonzero(h[a:start] != h[a + period:start + period])
        if len(differ):
            start = a + int(differ[-1]) + 1
            break
        start, step = a, 2 * step
    step, last = 16, hi - period
    while stop < last:
        b = min(last, stop + step)
        differ = np.flatnonzero(h[stop:b] != h[stop + period:b + period])
        if len(differ):
            stop += int(differ[0])
            break
        stop, step = b, 2 * step
    return start, stop


def proposed(h: np.ndarray, window: np.ndarray, at: np.ndarray, doc: np.ndarray, rest: np.ndarray, scale: int,
             covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(positions, periods, context hashes of all positions)``: each position and its next equal context
    ``scale <= period < 2 * scale`` words on. ``window`` hashes the ``scale`` words from each entry, ``rest``
    counts the words left in its document, ``covered`` marks windows of small period."""
    context = window.copy()
    context[:-scale] = T.mix(window[:-scale] * np.uint64(T.BASE) + window[scale:])
    ids = T.mix(window + np.uint64(scale))
    ids[covered] = NO_ID
    least = sliding_min(ids, scale)
    selected = (least == ids)
    selected[:-scale] |= least[:-scale] == ids[scale:]
    selected &= (least != NO_ID) & (rest >= 2 * scale)
    s = np.flatnonzero(selected)
    key = T.mix(context[s] + T.mix(doc[s].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    a, b = s[order[:-1]], s[order[1:]]
    gap = b - a
    good = (key[order[:-1]] == key[order[1:]]) & (gap >= scale) & (gap < 2 * scale) & (doc[a] == doc[b])
    return at[a[good]], gap[good], context


def runs(h: np.ndarray, bounds: np.ndarray, min_words: int = 6) -> np.ndarray:
    """All runs in documents of word hashes ``h[bounds[k]:bounds[k + 1]]``: rows (document, start in ``h``,
    length, period), by document, start and period."""
    n, sizes = len(h), np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rest = bounds[1:][doc] - np.arange(n) if n else np.zeros(0, np.int64)
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, SMALL):
        if n > q:
            start, stop = stretches((h[:-q] == h[q:]) & (rest[:-q] > q))
            keep = stop - start + q >= MIN_POWER * q
            found.append(np.stack([start[keep], (stop - start)[keep] + q, np.full(keep.sum(), q)], 1))
    window, at, scale = h, np.arange(n), 1
    while True:
        if scale >= SMALL:          # a run of period >= scale takes MIN_POWER * scale words
            keep = np.repeat(sizes >= MIN_POWER * scale, sizes)[at]
            window, at, doc, rest = window[keep], at[keep], doc[keep], rest[keep]
        if len(at) <= 2 * scale:
            break
        if scale < SMALL:
            window = window.copy()
            window[:-scale] = T.mix(window[:-scale] * np.uint64(T.BASE) + window[scale:])
            scale *= 2
            continue
        known = np.concatenate(found)
        known = known[(known[:, 2] <= scale // 4) & (known[:, 1] >= scale)]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, known[:, 0], 1)
        np.add.at(edge, known[:, 0] + known[:, 1] - scale + 1, -1)
        s, period, window = proposed(h, window, at, doc, rest, scale, np.cumsum(edge)[at] > 0)
        order = np.lexsort((s, period))
        s, period = s[order], period[order]
        # proposals of one period that overlap are one stretch: each has equal words on 2 * scale positions
        first = np.ones(len(s), bool)
        first[1:] = (period[1:] != period[:-1]) | (s[1:] > s[:-1] + 2 * scale)
        own = []
        for a, b, q in zip(s[first], s[np.append(first[1:], True)] if len(s) else s, period[first]):
            k = int(np.searchsorted(bounds, a, "right")) - 1
            start, stop = extended(h, int(bounds[k]), int(bounds[k + 1]), int(a), int(b) + 2 * scale, int(q))
            if stop - start + q >= MIN_POWER * q:
                own.append((start, stop - start + q, q))
        if own:
            found.append(np.array(own, np.int64))
        scale *= 2
    out = np.concatenate(found)
    out = out[out[:, 1] >= min_words]
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    # one stretch, several periods: the smallest is its period
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1])
    out = out[fresh]
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    return np.column_stack([np.searchsorted(bounds, out[:, 0], "right") - 1, out])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.Array:
    """The words of each document joined by one space."""
    size = ends - starts + 1
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size[last] -= 1
    to = np.concatenate(([0], np.cumsum(size)))
    out = np.full(to[-1], 32, np.uint8)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(to, to[lo] + T.SLICE_BYTES, "right")) - 1)
        width = ends[lo:hi] - starts[lo:hi]
        if hi == lo + 1:
            out[to[lo]:to[lo] + width[0]] = data[starts[lo]:ends[lo]]
        else:
            first = np.cumsum(width) - width
            within = np.arange(width.sum()) - np.repeat(first, width)
            out[np.repeat(to[lo:hi], width) + within] = data[np.repeat(starts[lo:hi], width) + within]
        lo = hi
    offsets = to[np.searchsorted(doc, np.arange(n_docs + 1))]
    return pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def find_runs(docs: DataFrame, text: str | Column = "text", min_words: int = 6) -> DataFrame:
    """``row`` (a struct of all columns), ``n_words``, ``runs`` (start, length, period in words, by start and
    period) and ``collapsed`` (the text without the words that repeat a run's first period) per row."""

    @F.arrow_udf(f"struct<n_words:long,runs:array<{_RUN}>,collapsed:string>")
    def scan(texts: pa.Array) -> pa.Array:
        parts = []
        for lo, hi, data, offsets in T.slices(texts):
            starts, ends, doc = T.words(data, offsets)
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            found = runs(word_hashes(data, starts, ends), bounds, min_words)
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, found[:, 1] + found[:, 3], 1)
            np.add.at(edge, found[:, 1] + found[:, 2], -1)
            stay = np.cumsum(edge)[:-1] == 0
            cells = [pa.array(x) for x in (found[:, 1] - bounds[found[:, 0]], found[:, 2], found[:, 3])]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(hi - lo + 1)), pa.int32()),
                                             pa.StructArray.from_arrays(cells, ["start", "length", "period"]))
            text = joined(data, starts[stay], ends[stay], doc[stay], hi - lo).cast(pa.string())
            parts.append(pa.StructArray.from_arrays([pa.array(np.diff(bounds), pa.int64()), lists, text], ["n_words", "runs", "collapsed"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([
            ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())]))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), cell(text).alias("own_text"))
    return rows.select("row", scan("own_text").alias("out")).select("row", "out.*")


def longest_power(runs: str | Column) -> Column:
    """The run of greatest exact length / period (ties: smallest start, then period); null without a run."""
    found = F.col(runs) if isinstance(runs, str) else runs
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(found, F.lit(None).cast(_RUN), better)

"""Removal of repeated byte strings across documents, found in suffix arrays.

Every string of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string with the least hash, so equal strings share
an anchor wherever they stand. Neighbouring strings with one anchor form a segment of at most ``SPAN + LENGTH - 1`` bytes.
Segments whose anchor occurs in one document only can't repeat and are left out; the others are dealt by anchor, and each task sorts the
suffixes of its different segments in two stages: it sorts the suffixes that are smaller than their successors directly, induces all others by
one scan over the buckets of first bytes, and compares neighbours in the array. Neighbours with a common prefix of ``LENGTH`` bytes are the
same string; its first document is the smallest among them, and every segment of a later document gives a span to remove.

Equal texts meet first, by a digest: one of the smallest document is worked on, later documents' copies lose every string at once. What is left is
written once, in buckets by digest. The bytes of a segment that a task has given before are not sent again. Anchors of more than ``HOT`` segments go
another way: their different segments, with their smallest document, are written, sorted alike, and joined back to all their segments as written
tables, so that Spark splits a hot key. A hot anchor with more than ``WIDE`` different segments is cut into its single strings, which are grouped by
content instead. Anchors of two or more texts are a bitmap of fixed size while there are at most ``BITMAP_ANCHORS``; beyond that every bucket of texts
gets a bitmap of its own, filled from a list of those that it has, so that no segment travels only to be left out. A false hit of a bitmap
costs a segment that finds nothing, or takes the way of the hot ones. Rows travel in compressed blocks (:func:`to_block`).

Defined results: a null or empty text has no bytes; a null id is the largest; rows that share an id are separate texts of one
document, so none removes from another; an empty table gives no rows; other columns are kept and never read. Long texts are cut into
overlapping pieces, so that no step before the last holds more than about a megabyte of a text."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forestlens.llm import textops as T
from forestlens.llm.common import Scratch, cell, id_key

LENGTH = 50
GRAM = 16                    # longer grams meet by chance less often, but make more segments
SPAN = LENGTH - GRAM + 1     # grams in a string, and the most strings in a segment
HOT = 1 << 15
WIDE = 1 << 14
SLOT_BITS = 27
BITMAP_BITS = 1 << SLOT_BITS
BITMAP_ANCHORS = 1 << 24
KEY_BITS = 40                # of an anchor, to count it by
PART_BYTES = 32 << 20        # bytes of text in a bucket, and for each range of anchors
HELD_BYTES = 32 << 20        # what a task holds before it deals out blocks
HELD_KEYS = 1 << 20
HELD_ROWS = 3 << 16
BLOCK_BYTES = 1 << 18        # of texts; the arrays over their bytes stay small
CHUNK_SYMBOLS = 1 << 20
CHUNK_ROWS = 1 << 18
ROWS_EACH = 250_000
SLOTS = 1 << 20
PACK = 7                     # symbols of nine bits in a word


# --- blocks ------------------------------------------------------------------------------

BLOCK = "at long, n long, size long, block binary"


def to_block(numbers: list[np.ndarray] | np.ndarray, data: bytes = b"") -> tuple[int, int, bytes]:
    """``(n, size, block)``: columns of ``n`` integers as planes of bytes, then ``data``, compressed from ``size`` bytes."""
    numbers = np.ascontiguousarray(numbers, np.int64)
    raw = numbers.view(np.uint8).reshape(*numbers.shape, 8).transpose(0, 2, 1).tobytes() + data
    return numbers.shape[1], len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def from_block(n: int, size: int, block, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns, and the bytes behind them."""
    raw = np.frombuffer(pa.decompress(block, decompressed_size=size, codec="zstd"), np.uint8)
    numbers = raw[:8 * n * columns].reshape(columns, 8, n).transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]
    return numbers, raw[8 * n * columns:]


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                      ["at", "n", "size", "block"])


def blocks(batches: Iterator[pa.RecordBatch], column: str = "block") -> Iterator[tuple]:
    """The rows of batches, ``column`` as a buffer, the columns before it as they are."""
    for batch in batches:
        names = batch.schema.names[:batch.schema.names.index(column)]
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            yield *row, batch.column(column)[i].as_buffer()


def block_groups(batches: Iterator[pa.RecordBatch], columns: int, rising: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(at, columns, bytes)`` of all blocks with one ``at``, which they are sorted by. A ``rising`` first column holds differences."""
    held, last = [], None

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        out = last, np.concatenate([x for x, _ in held], axis=1), np.concatenate([x for _, x in held])
        held.clear()
        return out

    for at, n, size, block in blocks(batches):
        if held and at != last:
            yield whole()
        last = at
        held.append(from_block(n, size, block, columns))
        if rising:
            np.cumsum(held[-1][0][0], out=held[-1][0][0])
    if held:
        yield whole()


def together(rows: DataFrame, partitions: int, *after: str) -> DataFrame:
    """All blocks with one ``at`` in one task, sorted by it."""
    return rows.repartition(partitions, "at").sortWithinPartitions("at", *after)


def order_by(at: np.ndarray, below: int) -> np.ndarray:
    """The stable order of integers from 0, less than ``below``; sixteen bits sort in linear time."""
    return np.argsort(at.astype(np.uint16) if below <= 1 << 16 else at, kind="stable")


def ranges(of: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """``order``, cut where ``of`` changes."""
    return np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []


# --- texts -------------------------------------------------------------------------------

def distinct_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks of the different texts (``doc, rk, base``, bytes; a long text in pieces) in buckets ``at``, and in a column ``copied`` blocks of the
    later documents' copies (``doc, rk, start, stop``). Texts are the same if their digests of 128 bits are. Texts of the smallest document that
    has them are all kept; those too short for a string are left out."""

    def dealt_out(held: list[np.ndarray], views: list) -> pa.RecordBatch:
        numbers = np.concatenate(held, axis=1)
        *_, h, g, size = numbers
        at = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((g, h, at))
        size[order[1:][(h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])]] = 0       # its bytes are given already
        return block_batch([(at[part[0]], *to_block(numbers[:, part], b"".join([views[i] for i in part[size[part] > 0].tolist()])))
                            for part in ranges(at, order)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, views, total = [], [], 0
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "rk"))
            for rows, data, offsets, base in pieces(batch.column("text")):
                use = np.flatnonzero(np.diff(offsets) >= LENGTH)
                own = [memoryview(data)[a:b] for a, b in zip(offsets[use].tolist(), offsets[use + 1].tolist())]
                digest = np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in own]), np.int64).reshape(-1, 2)
                held.append(np.stack([ids[rows[use]], keys[rows[use]], np.full(len(use), base), digest[:, 0], digest[:, 1], np.diff(offsets)[use]]))
                views += own
                total += len(data)
                if total >= HELD_BYTES and views:
                    yield dealt_out(held, views)
                    held, views, total = [], [], 0
        if views:
            yield dealt_out(held, views)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["at", "n", "size", "block", "copied"], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for at, numbers, data in block_groups(batches, 6):
            offsets = np.concatenate(([0], np.cumsum(numbers[5])))
            order = np.lexsort(tuple(numbers[i] for i in (2, 1, 0, 4, 3)))
            doc, rk, base, h, g, size = numbers[:, order]
            new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
            again = np.append(False, ~new[1:] & (doc[1:] == doc[:-1]) & (rk[1:] == rk[:-1]) & (base[1:] == base[:-1]))
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            own = np.maximum.reduceat(np.where(size > 0, order, -1), begin)[group]       # where the bytes are
            size = np.diff(offsets)[own]
            late = doc > doc[begin][group]
            rows = []
            if len(gone := np.flatnonzero(late & ~again)):
                n, raw, block = to_block([doc[gone], rk[gone], base[gone], base[gone] + size[gone]])
                rows.append((at, n, raw, None, block))
            stay = np.flatnonzero(~late & ~again)
            for part in ranges(np.cumsum(size[stay]) // BLOCK_BYTES, np.arange(len(stay))):
                part = stay[part]
                given = b"".join([memoryview(data)[a:b] for a, b in zip(offsets[own[part]].tolist(), offsets[own[part] + 1].tolist())])
                rows.append((at, *to_block([doc[part], rk[part], base[part], size[part]], given), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return together(texts.mapInArrow(deal, BLOCK), buckets).mapInArrow(settle, BLOCK + ", copied binary")


def copied_spans(texts: DataFrame) -> DataFrame:
    """``doc, rk, start, stop`` of the copies that :func:`distinct_texts` has found."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, size, block in blocks(batches, "copied"):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in from_block(n, size, block, 4)[0]], ["doc", "rk", "start", "stop"])

    return texts.filter("copied IS NOT NULL").select("n", "size", "copied").mapInArrow(spans, "doc long, rk long, start long, stop long")


def text_block(n: int, size: int, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(numbers, bytes, offsets)`` of a block of texts; the numbers are ``doc, rk, base``."""
    numbers, data = from_block(n, size, block, 4)
    return numbers[:3], data, np.concatenate(([0], np.cumsum(numbers[3])))


# --- segments ----------------------------------------------------------------------------

def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(rows, bytes, offsets, base)``: slices of texts; a long text in pieces that overlap by ``LENGTH - 1``."""
    for lo, hi, data, offsets in T.slices(column):
        if hi - lo > 1 or len(data) <= 2 * T.SLICE_BYTES:
            yield np.arange(lo, hi), data, offsets, 0
            continue
        for a in range(0, len(data), T.SLICE_BYTES):
            part = data[a:a + T.SLICE_BYTES + LENGTH - 1]
            yield np.array([lo]), part, np.array([0, len(part)]), a


def gram_values(data: np.ndarray) -> np.ndarray:
    """A polynomial over the ``GRAM`` bytes from each position, put together from those over powers of two."""
    part, size, factor = T.BYTE_VALUE[data], 1, T.BASE
    out, done, rest = None, 0, GRAM
    while rest:
        if rest & 1:
            if out is None:
                out, done = part, size
            else:       # the longer part stands first
                n = len(data) - done - size + 1
                out, done = part[:n] * np.uint64(pow(T.BASE, done, 2**64)) + out[size:size + n], done + size
        rest >>= 1
        if rest:
            part = part[:-size] * np.uint64(factor) + part[size:]
            size, factor = 2 * size, factor * factor % 2**64
    return out


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchors, starts, numbers of strings, documents)``; every string of ``LENGTH`` bytes lies in one segment."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    least = T.mix(gram_values(data))
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[SPAN - size:SPAN - size + n])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[:n] == doc[LENGTH - 1:]
    first = whole.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (doc[1:n] != doc[:n - 1])
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], n)
    ended = np.flatnonzero(whole & ~np.append(whole[1:], False))      # a document's last string
    at = np.searchsorted(ended, starts)
    size = np.minimum(stops, ended[at] + 1) - starts if len(starts) else starts
    parts = -(-size // SPAN)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + SPAN * within
    size = np.minimum(np.repeat(size, parts) - SPAN * within, SPAN)
    return least[starts], starts, size, doc[starts]


def key_edges(parts: int) -> np.ndarray:
    """The least key of each range of anchors, and the end of the last."""
    return -(-(np.arange(parts + 1) << KEY_BITS) // parts)


def anchor_blocks(texts: DataFrame, parts: int) -> DataFrame:
    """Blocks of keys, the buckets of texts that have them, their segments there and how many texts have those, by range of keys. A key is ``KEY_BITS``
    bits of an anchor, its slot first. Entries of one bucket are put together, so a key in every text has few."""

    def dealt_out(held: list[tuple]) -> pa.RecordBatch:
        key, row, bucket = (np.concatenate(x) for x in zip(*held))
        tagged = np.sort(key << 23 | np.arange(len(key)))       # sorts faster than an order
        key, order = tagged >> 23, tagged & (1 << 23) - 1
        row, bucket = row[order], bucket[order]
        other = np.append(True, key[1:] != key[:-1])
        begin = np.flatnonzero(other | np.append(True, bucket[1:] != bucket[:-1]))
        of_texts = np.add.reduceat((other | np.append(True, row[1:] != row[:-1])).astype(np.int64), begin)
        entries = np.stack([key[begin], bucket[begin], np.diff(np.append(begin, len(key))), of_texts])
        cut = np.searchsorted(entries[0], key_edges(parts))
        entries[0] = np.diff(entries[0], prepend=0)
        found = np.flatnonzero(cut[1:] > cut[:-1])
        entries[0, cut[found]] = key[begin[cut[found]]]         # each block starts anew
        return block_batch([(p, *to_block(entries[:, cut[p]:cut[p + 1]])) for p in found])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, total = [], 0, 0
        for bucket, n, size, block in blocks(batches):
            _, data, offsets = text_block(n, size, block)
            anchor, _, _, own = segments(data, offsets)
            if len(anchor):
                slot = anchor & np.uint64(BITMAP_BITS - 1)
                rest = anchor >> np.uint64(SLOT_BITS) & np.uint64((1 << KEY_BITS - SLOT_BITS) - 1)
                held.append(((slot << np.uint64(KEY_BITS - SLOT_BITS) | rest).view(np.int64), own + rows, np.full(len(anchor), bucket)))
            rows, total = rows + n, total + len(anchor)
            if total >= HELD_KEYS:
                yield dealt_out(held)
                held, rows, total = [], 0, 0
        if held:
            yield dealt_out(held)

    return texts.filter("block IS NOT NULL").select("at", "n", "size", "block").mapInArrow(count, BLOCK)


def words(slots: np.ndarray, first: int, last: int) -> np.ndarray:
    """Bits for slots, in words ``first`` to ``last``."""
    bits = np.zeros((last + 1 - first) * 64, bool)
    bits[slots - 64 * first] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def shared_anchors(texts: DataFrame, parts: int, buckets: int) -> DataFrame:
    """A row per range of keys, of those that two texts have: a bitmap of slots from the word ``first``, the same of anchors with more than ``HOT``
    segments (``busy``), how many ``anchors`` there are, ``rows`` of segments that have them and the ``most`` that have one. And rows of blocks: the slots for the
    bucket ``at``."""
    schema = BLOCK + ", first long, words binary, busy binary, anchors long, rows long, most long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    edges = key_edges(parts)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, numbers, _ in block_groups(batches, 4, rising=True):
            order = np.argsort(numbers[0]).astype(np.int32)
            key, (bucket, n, of_texts) = numbers[0][order], (x.astype(np.int32)[order] for x in numbers[1:])
            del numbers, order
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            number = np.add.reduceat(n, begin, dtype=np.int64)
            shared = np.add.reduceat(of_texts, begin, dtype=np.int64) > 1
            slots = (key[begin] >> KEY_BITS - SLOT_BITS).astype(np.int32)
            del key, n, of_texts
            first, last = (int(x >> KEY_BITS - SLOT_BITS >> 6) for x in (edges[p], edges[p + 1] - 1))
            maps = [words(slots[x], first, last).tobytes() for x in (shared, shared & (number > HOT))]
            rows = [(None, None, len(maps[0]), None, first, *(pa.compress(x, codec="zstd", asbytes=True) for x in maps), int(shared.sum()),
                     int(number[shared].sum()), int(number[shared].max(initial=0)))]
            mine = np.repeat(shared, size)
            slots, bucket = np.repeat(slots, size)[mine], bucket[mine]
            order = order_by(bucket, buckets)
            slots, bucket = slots[order], bucket[order]
            new = np.append(True, (slots[1:] != slots[:-1]) | (bucket[1:] != bucket[:-1]))[:len(slots)]
            slots, bucket = slots[new], bucket[new]
            rows += [(int(bucket[x[0]]), *to_block([np.diff(slots[x], prepend=np.int32(0))]), *[None] * 6) for x in ranges(bucket, np.arange(len(bucket)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    return together(anchor_blocks(texts, parts), parts).mapInArrow(settle, schema)


def whole_bitmap(anchors: DataFrame, column: str) -> np.ndarray:
    """A bit for the last bits of each anchor (an anchor is a minimum, so its leading bits crowd near zero); its size
    does not depend on the table."""
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    found = anchors.filter("first IS NOT NULL").select("first", "size", column).toArrow()
    for first, size, block in blocks(found.to_batches(), column):
        bitmap[first:first + size // 8] |= np.frombuffer(pa.decompress(block, decompressed_size=size, codec="zstd"), np.uint64)
    return bitmap


def add_slots(bitmap: np.ndarray, slots: np.ndarray) -> None:
    """Sets the bits of sorted slots."""
    begin = np.flatnonzero(np.append(True, slots[1:] >> 6 != slots[:-1] >> 6))
    bitmap[slots[begin] >> 6] |= np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), begin)


def marked(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    slot = anchors & np.uint64(BITMAP_BITS - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) == 1


class Given:
    """The segments whose bytes a task has given, as many as there are slots."""

    def __init__(self, least: bool):
        """``least``: bytes count as given only with a document no larger."""
        self.least = least
        self.seen = np.zeros((2, SLOTS), np.uint64)
        self.doc = np.full(SLOTS, 2**63 - 1)
        self.fresh = np.ones(SLOTS, bool)

    def give(self, anchor: np.ndarray, h: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether each segment's bytes are to be given, which from now on they are."""
        slot = ((anchor ^ h) & np.uint64(SLOTS - 1)).astype(np.int64)
        order = np.lexsort((of, h, anchor))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
        known = ~self.fresh[slot] & (self.seen[0][slot] == anchor) & (self.seen[1][slot] == h)
        if self.least:
            known &= self.doc[slot] <= of
        give = ~again & ~known
        g = np.flatnonzero(give)
        # one write a slot, so that its three parts are of one segment
        _, one = np.unique(slot[g], return_index=True)
        w = g[one]
        self.seen[0][slot[w]], self.seen[1][slot[w]], self.doc[slot[w]], self.fresh[slot[w]] = anchor[w], h[w], of[w], False
        return give


def cut_out(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    return data[np.arange(width.sum()) + np.repeat(start - (np.cumsum(width) - width), width)]


def segment_blocks(rows: DataFrame, busy, shared, parts: int) -> DataFrame:
    """Blocks of ``anchor, h, doc, rk, start, width`` and bytes per segment with a shared anchor that is not hot. ``rows`` are blocks of texts (``kind`` 1) and, if there
    is no bitmap ``shared``, before them those of the slots for their bucket (``kind`` 0). Bytes are left out where the task has given them before; where they are given, the
    segment's hash ``h`` is left out."""

    def dealt_out(held: list[tuple]) -> pa.RecordBatch:
        numbers, data = np.concatenate([x for x, _ in held], axis=1), np.concatenate([x for _, x in held])
        numbers[6] += np.repeat(np.cumsum([0] + [len(x) for _, x in held[:-1]]), [x.shape[1] for x, _ in held])
        at = (numbers[0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        numbers[0] = (numbers[0].view(np.uint64) >> np.uint64(64 - KEY_BITS)).view(np.int64)
        return block_batch([(at[part[0]], *to_block(numbers[:6, part], cut_out(data, numbers[6, part], numbers[5, part]).tobytes()))
                            for part in ranges(at, order_by(at, parts))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, hot, last = Given(least=False), busy.value, None
        bitmap = shared.value if shared is not None else None
        held, total, size = [], 0, 0
        for at, kind, n, raw, block in blocks(batches):
            if shared is None and at != last:
                bitmap, last = np.zeros(BITMAP_BITS // 64, np.uint64), at
            if kind == 0:
                add_slots(bitmap, np.cumsum(from_block(n, raw, block, 1)[0][0]))
                continue
            (doc, rk, base), data, offsets = text_block(n, raw, block)
            anchor, start, strings, own = segments(data, offsets)
            keep = marked(bitmap, anchor)
            keep[keep] = ~marked(hot, anchor[keep])
            anchor, start, strings, own = anchor[keep], start[keep], strings[keep], own[keep]
            if not len(anchor):
                continue
            width = strings + LENGTH - 1
            h = T.span_hashes(data, start, start + width)
            give = given.give(anchor, h, doc[own])
            held.append((np.stack([anchor.view(np.int64), np.where(give, 0, h.view(np.int64)), doc[own], rk[own], base[own] + start - offsets[own],
                                   np.where(give, width, 0), start]), data))
            total, size = total + len(anchor), size + len(data)
            if total >= HELD_ROWS or size >= HELD_BYTES:
                yield dealt_out(held)
                held, total, size = [], 0, 0
        if held:
            yield dealt_out(held)

    return rows.mapInArrow(emit, BLOCK)


def hot_rows(texts: DataFrame, busy) -> DataFrame:
    """``anchor, h, doc, rk, start, seg`` per segment with a hot anchor. The bytes ``seg`` are left out where the task has given the same segment with a
    document no larger."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Given(least=True)
        for n, raw, block in blocks(batches):
            (doc, rk, base), data, offsets = text_block(n, raw, block)
            anchor, start, strings, own = segments(data, offsets)
            keep = marked(busy.value, anchor)
            anchor, start, strings, own = anchor[keep], start[keep], strings[keep], own[keep]
            if not len(anchor):
                continue
            width = strings + LENGTH - 1
            h = T.span_hashes(data, start, start + width)
            give = given.give(anchor, h, doc[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64)), pa.array(doc[own]), pa.array(rk[own]), pa.array(base[own] + start - offsets[own]),
                 binaries(np.where(give, width, 0), cut_out(data, start[give], width[give])).cast(pa.binary())], ["anchor", "h", "doc", "rk", "start", "seg"])

    return texts.filter("block IS NOT NULL").select("n", "size", "block").mapInArrow(emit, "anchor long, h long, doc long, rk long, start long, seg binary")


def binaries(width: np.ndarray, data: np.ndarray) -> pa.Array:
    """Byte strings, null where the width is 0."""
    offsets = np.concatenate(([0], np.cumsum(width)))
    return pa.Array.from_buffers(pa.large_binary(), len(width), [pa.array(width > 0).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(data)])


# --- suffix arrays -----------------------------------------------------------------------

def packed(sym: np.ndarray) -> np.ndarray:
    """Seven symbols from each position in one integer, zeros past the end."""
    n = len(sym)
    x = np.zeros(n + PACK, np.int64)
    x[:n] = sym
    two = (x[:-1] << 9) | x[1:]
    four = (two[:-2] << 18) | two[2:]
    return (four[:n] << 27) | (two[4:n + 4] << 9) | x[6:n + 6]


def closed(word: np.ndarray) -> np.ndarray:
    """Whether a packed word holds a closing 0."""
    out = np.zeros(len(word), bool)
    for shift in range(0, 9 * PACK, 9):
        out |= (word >> shift & 511) == 0
    return out


def sorted_directly(word: np.ndarray, at: np.ndarray, symbols: int | None) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes, which end with their segment's closing 0, or of their first ``symbols``."""
    key = word[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(at) else np.zeros(0, np.int64)
    live, depth = np.flatnonzero(~closed(key)), PACK
    while len(live) and (symbols is None or depth < symbols):
        g = group[live]
        tie = np.zeros(len(live), bool)
        same = g[1:] == g[:-1]
        tie[1:] |= same
        tie[:-1] |= same
        live, g = live[tie], g[tie]
        key = word[at[live] + depth]
        order = np.lexsort((key, g))
        at[live] = at[live[order]]
        key, g = key[order], g[order]
        group[live] = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]))[:len(g)])
        live = live[~closed(key)]
        depth += PACK
    return at


def suffix_array(sym: np.ndarray, word: np.ndarray, wanted: np.ndarray | None = None, symbols: int | None = None) -> np.ndarray:
    """Positions of the ``wanted`` suffixes (all without) and of those that they are induced from, in the order of their first
    ``symbols`` at least (whole suffixes without), sorted in two stages. ``sym`` holds segments, each closed by a 0."""
    n = len(sym)
    step = np.diff(sym.astype(np.int16), append=np.int16(-1))
    move = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    rises = step[move] > 0               # smaller than its successor
    rises[sym == 0] = True
    use = np.ones(n, bool)
    if wanted is not None:               # a suffix is induced from its successor, up to the next one that is sorted directly
        w, tops = np.flatnonzero(wanted), np.flatnonzero(rises)
        edge = np.bincount(w, minlength=n + 1) - np.bincount(tops[np.searchsorted(tops, w)] + 1, minlength=n + 1)
        use = np.cumsum(edge)[:n] > 0
    falls = use & ~rises
    size = np.bincount(sym[use], minlength=257)
    start = np.concatenate(([0], np.cumsum(size)))
    direct = sorted_directly(word, np.flatnonzero(use & rises), symbols)
    late = np.bincount(sym[direct], minlength=257)
    sa = np.empty(start[-1], np.int64)
    bucket = np.repeat(start[1:] - late, late)
    sa[bucket + np.arange(len(direct)) - np.repeat(np.cumsum(late) - late, late)] = direct
    head = start[:-1].copy()             # where the next induced suffix of each bucket goes
    for c in np.flatnonzero(size):
        wave = sa[start[c]:head[c]]
        while len(wave):                 # induced within the bucket itself: runs of one byte
            before = wave[wave > 0] - 1
            wave = before[falls[before] & (sym[before] == c)]
            sa[head[c]:head[c] + len(wave)] = wave
            head[c] += len(wave)
        before = sa[start[c]:start[c + 1]]
        before = before[before > 0] - 1
        before = before[falls[before] & (sym[before] > c)]
        own = sym[before]
        order = np.argsort(own, kind="stable")
        number = np.bincount(own, minlength=257)
        sa[np.repeat(head - (np.cumsum(number) - number), number) + np.arange(len(before))] = before[order]
        head += number
    return sa


def common_prefix(sym: np.ndarray, word: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each neighbour pair of ``sa``, whether the first ``length`` symbols agree."""
    a, b = sa[:-1], sa[1:]
    same = np.ones(len(a), bool)
    for o in range(0, length - PACK + 1, PACK):
        at = np.flatnonzero(same)
        same[at] = word[a[at] + o] == word[b[at] + o]
    for o in range(length - length % PACK, length):
        at = np.flatnonzero(same)
        same[at] = sym[a[at] + o] == sym[b[at] + o]
    return same


def first_documents(data: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, first string, last string, smallest document)`` runs over the strings of different segments
    (concatenated bytes, their sizes, each with its smallest document)."""
    n = len(size)
    stop = np.cumsum(size + 1)
    seg = np.repeat(np.arange(n), size + 1)
    sym = np.zeros(stop[-1], np.uint16)
    inside = np.ones(len(sym), bool)
    inside[stop - 1] = False
    sym[inside] = data.astype(np.uint16) + 1
    word = packed(sym)
    useful = stop[seg] - 1 - np.arange(len(sym)) >= LENGTH
    sa = suffix_array(sym, word, useful, LENGTH)
    sa = sa[useful[sa]]
    new = np.append(True, ~common_prefix(sym, word, sa, LENGTH))
    least = np.minimum.reduceat(doc[seg[sa]], np.flatnonzero(new))
    first = np.empty(len(sym), np.int64)
    first[sa] = least[np.cumsum(new) - 1]
    at = np.flatnonzero(useful)
    edge = np.append(True, (seg[at[1:]] != seg[at[:-1]]) | (first[at[1:]] != first[at[:-1]]))
    lo = np.flatnonzero(edge)
    hi = np.append(lo[1:], len(at)) - 1
    of = seg[at[lo]]
    begin = (stop - size - 1)[of]
    return of, at[lo] - begin, at[hi] - begin, first[at[lo]]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by anchor in tables that end where an anchor does."""
    held, symbols, size, last = [], 0, 0, None
    for batch in batches:
        anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
        if not len(anchor):
            continue
        turn = np.flatnonzero(np.append(last is not None and anchor[0] != last, anchor[1:] != anchor[:-1]))
        last, lo = anchor[-1], 0
        while lo < len(anchor):
            if symbols >= CHUNK_SYMBOLS or size >= CHUNK_ROWS:
                hi = next((int(t) for t in turn[np.searchsorted(turn, lo):]), len(anchor))
            else:
                hi = min(len(anchor), lo + 2048)
            if hi > lo:
                part = batch.slice(lo, hi - lo)
                held.append(part)
                symbols, size = symbols + part.column("seg").nbytes, size + hi - lo
            if hi < len(anchor) and hi in turn and (symbols >= CHUNK_SYMBOLS or size >= CHUNK_ROWS):
                yield pa.Table.from_batches(held).combine_chunks()
                held, symbols, size = [], 0, 0
            lo = hi
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def solved(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """For all rows of some anchors: anchors, ``h`` and documents sorted by them, the order that sorts, where each different segment's rows begin
    and end in it, and runs ``(segment, first string, last string, smallest document)``. One row at least of a segment has its bytes;
    where ``h`` is left out it follows from them."""
    anchor, doc = (rows[c].to_numpy() for c in ("anchor", "doc"))
    given = np.flatnonzero(rows["seg"].is_valid().to_numpy())
    seg = rows["seg"].drop_null().combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(seg.buffers()[1], np.int64, len(seg) + 1, 8 * seg.offset)
    data = np.frombuffer(seg.buffers()[2], np.uint8)
    h = np.array(rows["h"].fill_null(0).to_numpy())
    h[given] = T.span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)
    has = np.full(len(h), -1)
    has[given] = np.arange(len(given))
    order = np.lexsort((doc, h, anchor))
    anchor, h, doc, has = anchor[order], h[order], doc[order], has[order]
    begin = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (h[1:] != h[:-1])))
    end = np.append(begin[1:], len(h))
    own = np.maximum.reduceat(has, begin)
    size = np.diff(offsets)[own]
    at = np.arange(size.sum()) + np.repeat(offsets[own] - (np.cumsum(size) - size), size)
    return anchor, h, doc, order, begin, end, *first_documents(data[at], size, doc[begin])


def dealt(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows by anchor; forty bits of it tell anchors apart well enough to keep groups small, and are less to move."""
    rows = rows.withColumn("anchor", F.shiftrightunsigned("anchor", 24))
    return rows.repartition(partitions, "anchor").sortWithinPartitions("anchor")


def segment_spans(rows: DataFrame, partitions: int) -> DataFrame:
    """``doc, rk, start, stop``: the spans of all segments that an earlier document has."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (*numbers, width), data in block_groups(batches, 6):
            whole = pa.table([*map(pa.array, numbers), binaries(width, data)], ["anchor", "h", "doc", "rk", "start", "seg"])
            for part in chunks(whole.take(np.argsort(numbers[0], kind="stable")).to_batches(max_chunksize=1 << 14)):
                _, _, doc, order, begin, end, of, lo, hi, first = solved(part)
                rk, start = (part[c].to_numpy()[order] for c in ("rk", "start"))
                number = (end - begin)[of]
                run = np.repeat(np.arange(len(of)), number)
                row = begin[of][run] + np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
                late = doc[row] > first[run]
                run, row = run[late], row[late]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], rk[row], start[row] + lo[run], start[row] + hi[run] + LENGTH)],
                                                 ["doc", "rk", "start", "stop"])

    return together(rows, partitions).mapInArrow(sort, "doc long, rk long, start long, stop long")


def segment_firsts(given: DataFrame, partitions: int) -> DataFrame:
    """``key, h, lo, hi, first``: of each different segment (told apart by the anchor's ``key`` and ``h``), runs of strings and the smallest
    document that has them."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            anchor, h, _, _, begin, _, of, lo, hi, first = solved(part)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[begin[of]], h[begin[of]], lo, hi, first)], ["key", "h", "lo", "hi", "first"])

    return dealt(given, partitions).mapInArrow(sort, "key long, h long, lo long, hi long, first long")


def string_firsts(given: DataFrame, scratch: Scratch) -> DataFrame:
    """The same as :func:`segment_firsts` for the segments of wide anchors, by grouping their single strings."""
    given = given.withColumn("anchor", F.shiftrightunsigned("anchor", 24))
    distinct = given.groupBy("anchor", "h").agg(F.min("doc").alias("doc"), F.first("seg").alias("seg"))
    strings = scratch.write(distinct.withColumn("lo", F.explode(F.sequence(F.lit(0), F.length("seg") - LENGTH))).select(
        "anchor", "h", "doc", F.col("lo").cast("long").alias("lo"), F.expr(f"substring(seg, lo + 1, {LENGTH})").alias("string")), "suffix-strings")
    firsts = scratch.write(strings.groupBy("string").agg(F.min("doc").alias("first")), "suffix-string-firsts")
    return strings.join(firsts, "string").select(F.col("anchor").alias("key"), "h", "lo", F.col("lo").alias("hi"), "first")


# --- documents ---------------------------------------------------------------------------

def hot_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, rk, start, stop`` of segments with hot anchors."""
    rows = scratch.write(rows, "suffix-hot")
    given = rows.filter("seg IS NOT NULL").select("anchor", "h", "doc", "seg")
    wide = scratch.write(given.groupBy("anchor", "h").agg(F.lit(1).alias("one")).groupBy("anchor").count().filter(
        F.col("count") > WIDE).select("anchor"), "suffix-wide")
    some = wide.limit(1).count() > 0
    firsts = segment_firsts(given.join(wide, "anchor", "left_anti") if some else given, max(8, -(-given.count() // ROWS_EACH)))
    if some:
        firsts = firsts.union(string_firsts(given.join(wide, "anchor", "left_semi"), scratch))
    firsts = scratch.write(firsts, "suffix-firsts")
    found = rows.select(F.shiftrightunsigned("anchor", 24).alias("key"), "h", "doc", "rk", "start").join(firsts, ["key", "h"]).filter("doc > first")
    return found.select("doc", "rk", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + LENGTH).alias("stop"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``doc, rk, spans``: byte ranges (start, stop) of each text that an earlier document has, not merged. ``texts`` is
    ``doc, rk, text``. The result is written; all other tables are removed."""
    spark = texts.sparkSession
    scratch = Scratch(spark)
    parts = max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    texts = scratch.write(distinct_texts(texts, parts), "suffix-texts")
    anchors = scratch.write(shared_anchors(texts, parts, parts), "suffix-anchors")
    size = anchors.agg(F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                       F.coalesce(F.max("most"), F.lit(0)).alias("most")).first()
    busy, shared = spark.sparkContext.broadcast(whole_bitmap(anchors, "busy")), None
    rows = texts.filter("block IS NOT NULL").select("at", F.lit(1).alias("kind"), "n", "size", "block")
    if size["anchors"] <= BITMAP_ANCHORS:
        shared = spark.sparkContext.broadcast(whole_bitmap(anchors, "words"))
    else:
        rows = together(anchors.filter("block IS NOT NULL").select("at", F.lit(0).alias("kind"), "n", "size", "block").union(rows), parts, "kind")
    partitions = max(8, -(-size["rows"] // ROWS_EACH))
    found = segment_spans(segment_blocks(rows, busy, shared, partitions), partitions).union(copied_spans(texts))
    if size["most"] > HOT:
        found = found.union(hot_spans(hot_rows(texts, busy), scratch))
    spans = scratch.write(found.groupBy("doc", "rk").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans")
    scratch.remove("suffix-texts", "suffix-anchors", "suffix-hot", "suffix-wide", "suffix-strings", "suffix-string-firsts", "suffix-firsts")
    return spans


def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the union of its byte ranges."""
    texts = texts.cast(pa.large_binary())
    bounds = spans.offsets.to_numpy()
    ranges = [x.to_numpy(zero_copy_only=False) for x in spans.values.flatten()]
    kept, size, gone, starts, stops, ends = [], [], [], [], [], [0]
    for i, value in enumerate(texts):
        text = value.as_py() or b""
        size.append(len(text))
        a, b = (x[bounds[i]:bounds[i + 1]] for x in ranges)
        if len(a):
            order = np.argsort(a)
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.append(True, a[1:] > b[:-1])
            a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            left = np.append(0, b).tolist()
            kept.append(b"".join(text[x:y] for x, y in zip(left, [*a.tolist(), len(text)])))
        else:
            kept.append(text)
        starts.append(a)
        stops.append(b)
        gone.append(int((b - a).sum()))
        ends.append(ends[-1] + len(a))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (starts, stops)], ["start", "stop"]))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), lists],
                                      ["kept", "n_bytes", "n_removed", "spans"])


def dedup_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns), ``kept`` (the remaining bytes, which may cut a character), ``n_bytes``, ``n_removed`` and
    ``spans`` (the maximal removed byte ranges) per row. A string of ``LENGTH`` bytes stays only in the smallest document that has it."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key(doc_id).alias("of"), cell(text).alias("own_text"))
    # texts that share an id are told apart by a hash
    scratch = Scratch(docs.sparkSession)
    again = scratch.write(own.groupBy("of").count().filter("count > 1").select("of"), "suffix-repeated-ids")
    key = F.lit(0).cast("long")
    if again.limit(1).count():
        own = own.join(again.withColumn("again", F.lit(True)), "of", "left")
        key = F.when(F.col("again"), F.xxhash64("own_text")).otherwise(key)
    own = own.select("row", "of", "own_text", key.alias("key"))
    spans = repeated_spans(own.select(F.col("of").alias("doc"), F.col("key").alias("rk"), F.col("own_text").alias("text")))
    joined = own.join(spans.hint("shuffle_hash"), (F.col("of") == F.col("doc")) & (F.col("key") == F.col("rk")), "left")
    empty = F.array().cast("array<struct<start:long,stop:long>>")
    cut = F.arrow_udf("struct<kept:binary,n_bytes:long,n_removed:long,spans:array<struct<start:long,stop:long>>>")(without)
    return joined.select("row", cut("own_text", F.coalesce("spans", empty)).alias("out")).select("row", "out.*")

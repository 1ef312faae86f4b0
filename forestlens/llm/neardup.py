"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (A-Z lower-cased; a shorter text is one shingle). A shingle's
weight in a document is tf x idf. The document frequency is counted over all documents; idf falls
from 1 to 1 - ``idf_span`` with the logarithm of the frequency, and is 1 for all shingles rarer
than total / ``FREQUENT`` occurrences. So an edited word (frequency 1) weighs no more than
the text around it, however large its group of copies is, and at most ``FREQUENT`` shingles have
another idf than 1, at any corpus size: that proves the bound of the one table that is broadcast.

Counting packs each task's distinct hashes by range, sorted and delta-coded, so a shuffle carries
a few bytes per shingle and one row per (slice, range).

Improved consistent weighted sampling draws, per sample, (r, c, beta) for each shingle by its
hash and keeps the shingle and level with the least hash value; equal samples have the
probability of the weighted Jaccard similarity. ``BANDS`` x ``ROWS`` samples make bands. A band's
bucket of up to ``SETTLED`` nodes and ``SETTLED_SHINGLES`` shingles is settled by one task, a set of nodes
once however many bands it shares: nodes that no link connects yet are compared. In a larger bucket,
``LEADERS`` members in turn are compared with those that no earlier one matched; then all its pairs between different
components of the links so far are compared, in blocks spread over tasks. So at any size no
connection inside a bucket is lost: similarities are exact weighted Jaccard. The leaders only save work: it is linear in
members where they connect a bucket, and grows with the square of a large bucket of texts that are not alike.
Texts of the same words are one node from the start: copies are never compared.

Classes are the connected components of the verified links.

Defined results: texts without words (null, empty, white space) are copies of each other and like
no other text; a null id is the largest id; rows that share an id get a class each by
their text; ties keep the smallest id; an empty table gives no rows. Other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forestlens.llm import textops
from forestlens.llm.common import cell, id_key, materialize

SHINGLE = 5
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
FREQUENT = 1 << 20             # shingles whose idf may differ from 1, at most
COUNT_BITS = 48                # hash bits that document frequencies are counted by
DRAWS = 16                     # bits: size of the table of random draws
LEADERS = 3                    # rounds of leaders in a larger bucket, to save comparisons
SETTLED = 32                   # nodes, and
SETTLED_SHINGLES = 1 << 18     # distinct shingles of a bucket that one task settles
BLOCK = 256                    # nodes, and
BLOCK_SHINGLES = 1 << 17       # distinct shingles of a block of a larger bucket, about


# --- shingles --------------------------------------------------------------------

def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) in order, with their counts."""
    starts, ends, doc = textops.words(data, offsets)
    words = textops.span_hashes(data, starts, ends, nocase=True)
    at, h = textops.window_hashes(words, doc, SHINGLE)
    of = doc[at]
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for i in range(SHINGLE - 1):
            has = counts[short] > i
            own[has] = textops.mix(own[has] + words[first[short[has]] + i] + np.uint64(i + 1))
        of, h = np.concatenate([of, short]), np.concatenate([h, own])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    if not len(h):
        return of, h, np.zeros(0, np.int64)
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(np.append(at, len(h)))


# --- document frequencies ----------------------------------------------------------

def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as variable-length deltas (as many bytes as the largest needs)."""
    delta = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(delta.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + delta.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def frequent_shingles(docs: DataFrame, text: str, ranges: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and document frequencies of the shingles above total / FREQUENT, and the
    number of documents with words. At most ``FREQUENT`` entries, by that threshold."""
    inside = COUNT_BITS - 32
    buffered = 4 << 20             # distinct shingles of a task that are packed at once

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        which = ((h >> np.uint64(inside)) * np.uint64(ranges)) >> np.uint64(32)
        edges = np.searchsorted(which, np.arange(ranges + 1, dtype=np.uint64))
        some = [r for r in range(ranges) if edges[r] < edges[r + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack_sorted(h[edges[r]:edges[r + 1]]) for r in some], pa.binary())],
                                         ["range", "packed"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in textops.slices(batch.column(0)):
                _, h, _ = shingles(data, offsets)
                held.append(h >> np.uint64(64 - COUNT_BITS))
                size += len(h)
                if size >= buffered:
                    yield from emit(held)
                    held, size = [], 0
        yield from emit(held)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(np.concatenate([unpack_sorted(p) for p in group["packed"]]))
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(at, len(h)))
        often = n >= 2
        return pd.DataFrame({"total": [int(len(h))], "hashes": [h[at][often].astype("<u8").tobytes()], "counts": [n[often].astype("<i8").tobytes()]})

    packed = docs.select(cell(text).alias("text")).mapInArrow(gather, "range int, packed binary")
    counted = materialize(packed.groupBy("range").applyInPandas(count, "total long, hashes binary, counts binary"), "neardup-frequencies")
    total = counted.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    least = max(2, -(-total // FREQUENT))

    def above(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            for hashes, counts in zip(g["hashes"], g["counts"]):
                h, n = np.frombuffer(hashes, "<i8"), np.frombuffer(counts, "<i8")
                yield pd.DataFrame({"h": h[n >= least], "n": n[n >= least]})

    rows = counted.select("hashes", "counts").mapInPandas(above, "h long, n long").toPandas()
    h, n = rows["h"].to_numpy(np.int64).astype(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order], least


class Weights:
    """tf x idf of shingles: idf 1, or by the table of frequent ones."""

    def __init__(self, hashes: np.ndarray, frequencies: np.ndarray, least: int, n_docs: int, span: float):
        self.hashes = hashes
        top = np.log(max(n_docs, least + 1) / least)
        self.idf = 1 - span * np.clip(np.log(np.maximum(frequencies, least) / least) / top, 0, 1)

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = tf.astype(np.float64)
        if len(self.hashes):
            short = h >> np.uint64(64 - COUNT_BITS)
            at = np.minimum(np.searchsorted(self.hashes, short), len(self.hashes) - 1)
            hit = self.hashes[at] == short
            w[hit] *= self.idf[at[hit]]
        return w


# --- improved consistent weighted sampling --------------------------------------------

@lru_cache(1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r, log c, beta by the hash's upper bits; the sortable hash value of weight 1; multipliers."""
    rng = np.random.default_rng(11)
    n = 1 << DRAWS
    r, c, beta = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
    value = c - r * (np.floor(beta) - beta) - r
    odd = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, c, beta, sortable(value), odd


def sortable(x: np.ndarray) -> np.ndarray:
    """32-bit floats as integers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    return bits.astype(np.uint64) << np.uint64(32)


def sample(h: np.ndarray, w: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """``(documents, SAMPLES)``: each sample's shingle and level as a 32-bit value. ``firsts``: where
    each document's shingles begin; every document has some. Equal hash values go to the smaller tag."""
    r, c, beta, unit, odd = draws()
    plain = w == 1
    other = np.flatnonzero(~plain)
    low = np.uint64(0xFFFFFFFF)
    tag = textops.mix(h) & low
    log_w = np.log(w[other])
    out = np.empty((len(firsts), SAMPLES), np.uint32)
    shift = np.uint64(64 - DRAWS)
    for k in range(SAMPLES):
        at = ((h ^ (h >> np.uint64(29))) * odd[k]) >> shift
        key = unit[at] | tag
        if len(other):
            a = at[other]
            t = np.floor(log_w / r[a] + beta[a])
            level = textops.mix(h[other] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & low
            key[other] = sortable(c[a] - r[a] * (t - beta[a]) - r[a]) | np.where(t == 0, tag[other], level)
        out[:, k] = np.minimum.reduceat(key, firsts) & low
    return out


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Of two sets of sorted distinct hashes."""
    at = np.searchsorted(h1, h2)
    hit = at < len(h1)
    hit[hit] = h1[at[hit]] == h2[hit]
    common = np.minimum(w1[at[hit]], w2[hit]).sum()
    return float(common / (w1.sum() + w2.sum() - common))


def sequence_hashes(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits that tell word sequences apart, per document."""
    starts, ends, doc = textops.words(data, offsets)
    word = textops.span_hashes(data, starts, ends, nocase=True)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    place = (np.arange(len(doc)) - first[doc]).astype(np.uint64)
    halves = []
    for salt in (0x5BD1E995, 0xC2B2AE3D27D4EB4F):
        prefix = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(textops.mix(word + textops.mix(place + np.uint64(salt))), out=prefix[1:])
        halves.append(textops.mix(prefix[first + counts] - prefix[first] + counts.astype(np.uint64)))
    return [pair.tobytes() for pair in np.stack(halves, 1).astype("<u8")]


# --- the operator -------------------------------------------------------------------

def signatures(docs: DataFrame, weights, doc_id: str, text: str) -> DataFrame:
    """``doc, words`` (hash of the word sequence), ``sig`` (samples, null without words) and ``size`` (distinct shingles) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for lo, hi, data, offsets in textops.slices(batch.column(1)):
                of, h, tf = shingles(data, offsets)
                have, firsts = np.unique(of, return_index=True)
                n = hi - lo
                sequence = sequence_hashes(data, offsets)
                sig = [None] * n
                if len(have):
                    for d, s in zip(have, sample(h, table(h, tf), firsts)):
                        sig[d] = s.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(sequence, pa.binary()), pa.array(sig, pa.binary()),
                                                  pa.array(np.bincount(of, minlength=n), pa.int64())], ["doc", "words", "sig", "size"])

    return docs.select(id_key(doc_id).alias("doc"), cell(text).alias("text")).mapInArrow(run, "doc long, words binary, sig binary, size long")


def weight_lists(texts: DataFrame, weights) -> DataFrame:
    """``node, hashes, weights`` (bytes) of a ``text`` column, one row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for lo, hi, data, offsets in textops.slices(batch.column(0)):
                of, h, tf = shingles(data, offsets)
                w = table(h, tf)
                edges = np.searchsorted(of, np.arange(hi - lo + 1))
                cut = list(zip(edges[:-1], edges[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(sequence_hashes(data, offsets), pa.binary()),
                    pa.array([(h[a:b] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for a, b in cut], pa.binary()),
                    pa.array([w[a:b].astype("<f4").tobytes() for a, b in cut], pa.binary())], ["words", "hashes", "weights"])

    return texts.mapInArrow(run, "words binary, hashes binary, weights binary").select(
        F.xxhash64("words").alias("node"), "hashes", "weights").dropDuplicates(["node"])


def _hashes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


@F.pandas_udf(T.DoubleType())
def similarity(h1: pd.Series, w1: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
    """Exact weighted Jaccard similarity of packed weight lists."""
    return pd.Series([weighted_jaccard(_hashes(a), np.frombuffer(b, "<f4").astype(float), _hashes(c), np.frombuffer(d, "<f4").astype(float))
                      for a, b, c, d in zip(h1, w1, h2, w2)], dtype="float64")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """``bucket, node, band, size``, a row per band (nodes without samples have none)."""
    width = 4 * ROWS
    return nodes.filter("sig is not null").select("node", "sig", "size", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select(
        "node", "band", F.xxhash64("band", F.substr("sig", F.col("band") * width + 1, F.lit(width))).alias("bucket"), "size")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold several, with ``small``: one task can settle the bucket."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).filter("n > 1").select(
        "bucket", ((F.col("n") <= SETTLED) & (F.col("total") <= SETTLED_SHINGLES)).alias("small"))
    return rows.join(counts, "bucket").select("bucket", "node", "band", "size", "small")


def connections(hashes: list[bytes], weights: list[bytes], threshold: float) -> Iterator[tuple[int, int]]:
    """Links that connect a small set's nodes: a pair is compared unless earlier links connect it."""
    h = [_hashes(x) for x in hashes]
    w = [np.frombuffer(x, "<f4").astype(float) for x in weights]
    total = [x.sum() for x in w]
    of = list(range(len(h)))
    for j in range(1, len(h)):
        for i in range(j):
            # a similarity can't exceed the ratio of the sums (with room for rounding)
            if of[i] != of[j] and min(total[i], total[j]) >= (threshold - 1e-6) * max(total[i], total[j]) and weighted_jaccard(h[i], w[i], h[j], w[j]) >= threshold:
                of = [of[i] if o == of[j] else o for o in of]
                yield i, j


def settled_links(sets: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` inside small sets of nodes (``nodes``: sorted array)."""
    rows = sets.distinct().select(F.xxhash64("nodes").alias("set"), F.explode("nodes").alias("node")).join(lists, "node")

    def settle(group: pa.Table) -> Iterator[tuple[int, int]]:
        return connections(group.column("hashes").to_pylist(), group.column("weights").to_pylist(), threshold)

    return links_by_set(rows.select("set", "node", "hashes", "weights"), settle)


def links_by_set(rows: DataFrame, settle) -> DataFrame:
    """Links ``a, b`` of the pairs of places that ``settle`` finds in the rows of each ``set``."""
    rows = rows.repartition("set").sortWithinPartitions("set", "node")

    def pairs(group: pa.Table) -> pa.RecordBatch:
        nodes = group.column("node").to_pylist()
        found = list(settle(group))
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            key = held.column("set").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield pairs(held.slice(lo, hi - lo))
            rest = held.slice(edges[-1])
        if rest is not None and len(rest):
            yield pairs(rest)

    return rows.mapInArrow(run, "a long, b long")


def cross_connections(hashes: list[bytes], weights: list[bytes], classes: list[int], blocks: list[int], threshold: float) -> Iterator[tuple[int, int]]:
    """Links between the classes of one or two blocks; with two, of pairs across them. Each node of the first is
    held against all others at once; a pair is verified unless its classes are connected by then."""
    h = [_hashes(x) for x in hashes]
    w = [np.frombuffer(x, "<f4").astype(float) for x in weights]
    total = np.array([x.sum() for x in w])
    blocks, of = np.array(blocks), np.unique(classes, return_inverse=True)[1]
    ids, counts = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)[1:]
    # a shingle of one node only is in no overlap
    node, level = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate(w)
    shared = counts[ids] > 1
    ids, node, level = ids[shared], node[shared], level[shared]
    edges = np.searchsorted(node, np.arange(len(h) + 1))
    dense = np.zeros(len(counts))
    whole = blocks.min() == blocks.max()
    for i in np.flatnonzero(blocks == blocks.min()):
        ratio = np.minimum(total[i], total) >= (threshold - 1e-6) * np.maximum(total[i], total)
        others = ratio & (of != of[i]) & ((np.arange(len(h)) > i) if whole else (blocks != blocks[i]))
        if not others.any():
            continue
        own = slice(edges[i], edges[i + 1])
        dense[ids[own]] = level[own]
        common = np.bincount(node, np.minimum(dense[ids], level), len(h))
        dense[ids[own]] = 0
        near = others & (common >= (threshold - 1e-6) * (total[i] + total - common))
        for j in np.flatnonzero(near):
            if of[i] != of[j] and weighted_jaccard(h[i], w[i], h[j], w[j]) >= threshold:
                of[of == of[j]] = of[i]
                yield int(i), int(j)


def rest_links(rows: DataFrame, found: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Links between classes (components of the links ``found``) that share a bucket of ``rows`` (``bucket, node, size``).

    All pairs of a bucket are compared but those inside a class: its nodes are dealt into blocks, those of the class
    with most nodes apart from the rest, and a task gets two blocks, or one of the rest."""
    of = components(found)
    rows = materialize(rows.join(of, "node", "left").select("bucket", "node", "size", F.coalesce("class", "node").alias("class")), "neardup-large")
    per_class = rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    per_bucket = per_class.groupBy("bucket").agg(F.max(F.struct("n", "class", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("n > main.n")

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")

    main = F.col("main")
    per_bucket = per_bucket.select("bucket", main["class"].alias("main"), blocks(F.col("n") - main["n"], F.col("size") - main["size"]).alias("k_rest"),
                                   blocks(main["n"], main["size"]).alias("k_main"))
    place = F.xxhash64("node", F.lit(1))
    dealt = rows.join(per_bucket, "bucket").withColumn("block", F.when(F.col("class") == F.col("main"), F.col("k_rest") + F.pmod(place, "k_main")).otherwise(
        F.pmod(place, "k_rest")).cast("int"))
    partners = F.when(F.col("block") >= F.col("k_rest"), F.sequence(F.lit(0), F.col("k_rest") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("k_rest") + F.col("k_main") - 1))
    sets = dealt.select("bucket", "node", "class", "block", F.explode(partners).alias("other")).select(
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("set"), "node", "class", "block")

    def settle(group: pa.Table) -> Iterator[tuple[int, int]]:
        return cross_connections(*(group.column(c).to_pylist() for c in ("hashes", "weights", "class", "block")), threshold)

    return links_by_set(sets.join(lists, "node").select("set", "node", "class", "block", "hashes", "weights"), settle)


def links(nodes: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Verified links ``a, b`` of nodes. ``nodes``: ``node, rep, sig``; ``texts``: ``doc, text`` with each node's
    text at its ``rep`` (other rows of that id do no harm)."""
    shared = materialize(shared_buckets(bucket_rows(nodes)), "neardup-buckets")
    needed = nodes.join(shared.select("node").distinct(), "node").select(F.col("rep").alias("doc"))
    lists = materialize(weight_lists(texts.join(needed, "doc", "left_semi").select("text"), weights), "neardup-lists")
    sets = shared.filter("small").groupBy("bucket").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes")
    large = shared.filter("not small").select("bucket", "node", "band", "size")
    found, left = [materialize(settled_links(sets, lists, threshold), "neardup-settled")], large
    for _ in range(LEADERS):
        if left.isEmpty():
            break
        # a leader per bucket, by a hash of its own in each band, so that buckets differ in leaders
        leaders = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "band").alias("r"), "node")).alias("l")).select("bucket", F.col("l.node").alias("leader"))
        members = left.join(leaders, "bucket").filter("node <> leader")
        pairs = members.select("leader", "node").distinct()
        led = lists.select(F.col("node").alias("leader"), F.col("hashes").alias("h1"), F.col("weights").alias("w1"))
        compared = pairs.join(lists, "node").join(led, "leader").select("leader", "node", similarity("h1", "w1", "hashes", "weights").alias("s"))
        good = materialize(compared.filter(F.col("s") >= threshold).select(F.col("leader").alias("a"), F.col("node").alias("b")), "neardup-links")
        found.append(good)
        failed = members.join(good, (F.col("leader") == F.col("a")) & (F.col("node") == F.col("b")), "left_anti")
        left = materialize(failed.select("bucket", "node", "band", "size"), "neardup-open")
    if not large.isEmpty():
        found.append(materialize(rest_links(large, reduce(DataFrame.union, found), lists, threshold), "neardup-rest"))
    return reduce(DataFrame.union, found)


def components(edges: DataFrame) -> DataFrame:
    """``node, class`` (the component's smallest node) of every node with an edge: labels go to
    neighbours, then to the label's own label, until nothing changes."""
    both = materialize(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "neardup-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("class")).withColumnRenamed("a", "node"), "neardup-classes")
    settled = False
    while not settled:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node").select("node", "class", F.least("class", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("class").alias("far"))
        step = materialize(step.join(jump, "new").select("node", "class", F.least("new", "far").alias("new")), "neardup-step")
        settled = step.filter("new <> class").isEmpty()
        labels = step.select("node", F.col("new").alias("class"))
    return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, idf_span: float = 0.25, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, words, class, class_words`` per row of ``docs``: class is the smallest id of the row's
    near-duplicate group; ``words`` tells texts apart, ``class_words`` is
    that of the text that stands for the class."""
    spark = docs.sparkSession
    ranges = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashes, frequencies, least = frequent_shingles(docs, text, ranges)
    weights = spark.sparkContext.broadcast(Weights(hashes, frequencies, least, docs.count(), idf_span))
    rows = materialize(signatures(docs, weights, doc_id, text), "neardup-signatures")
    nodes = materialize(rows.groupBy("words").agg(F.min("doc").alias("rep"), F.first("sig").alias("sig"), F.first("size").alias("size")).select(
        F.xxhash64("words").alias("node"), "words", "rep", "sig", "size"), "neardup-nodes")
    found = links(nodes, docs.select(id_key(doc_id).alias("doc"), cell(text).alias("text")), weights, threshold)
    grouped = nodes.join(components(found), "node", "left").select("words", "rep", F.coalesce("class", "node").alias("group"))
    grouped = materialize(grouped, "neardup-groups")
    smallest = grouped.groupBy("group").agg(F.min(F.struct("rep", "words")).alias("l"))
    of = grouped.join(smallest, "group").select(F.col("words").alias("of"), F.col("l.rep").alias("class"), F.col("l.words").alias("class_words"))
    return rows.join(of, F.col("words") == F.col("of")).select("doc", "words", "class", "class_words")


@F.arrow_udf(T.BinaryType())
def word_sequence(texts: pa.Array) -> pa.Array:
    return pa.array([h for _, _, data, offsets in textops.slices(texts) for h in sequence_hashes(data, offsets)], pa.binary())


def distinct_documents(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class.

    An id with one row is judged by id alone. Only where several rows share an id are
    their words told apart, and of rows alike in id and words one stays."""
    classes = materialize(near_duplicates(docs, threshold, doc_id=doc_id, text=text, **options), "neardup-result")
    first = (F.col("doc") == F.col("class")) & (F.col("words") == F.col("class_words"))
    ids = materialize(classes.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("stays")), "neardup-ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key(doc_id).alias("of"), cell(text).alias("own_text"))
    single = ids.filter("n = 1 and stays").select("doc").hint("shuffle_hash")
    kept = rows.join(single, F.col("of") == F.col("doc"), "left_semi").select("row")
    shared = ids.filter("n > 1").select("doc")
    if not shared.isEmpty():
        told = rows.join(shared, F.col("of") == F.col("doc"), "left_semi").select("row", "of", word_sequence("own_text").alias("own"))
        once = told.groupBy("of", "own").agg(F.first("row").alias("row"))
        stand = classes.filter(first).select("doc", "words").distinct()
        kept = kept.union(once.join(stand, (F.col("of") == F.col("doc")) & (F.col("own") == F.col("words")), "left_semi").select("row"))
    return kept.select("row.*")

"""Packing documents into sequences by cutting-stock column generation.

Documents become token ids, cut into pieces of at most ``size`` tokens. Lengths are counted in
classes of ``grain`` tokens (256 at the defaults, at any corpus size). On that histogram a
linear program picks how often to use each pattern of lengths that fits a sequence; patterns
enter by knapsack dynamic programming over the program's prices. Rounded-down pattern
counts leave at most a pattern's worth of pieces per class, which are placed best-fit. Pieces
are ranked within their class and the rank says which pattern copy and slot is theirs.

Ranks are counted in salted parts of a class, so a length that a third of all documents share
is spread. What the driver holds (histogram, patterns, slot table) is bounded by the
number of classes, not by documents.

Defined results: a null or empty text has only the end id; rows that share an id are separate
documents; an empty table gives no rows. Other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forestlens.llm import textops
from forestlens.llm.common import cell, materialize
from forestlens.llm.tokens import encoder

GROUP_BYTES = 2 << 20          # text handed to the tokenizer at once
SALT_ROWS = 20_000             # aimed-at rows per salted part of a class, if all had one length


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """``id, start, length, doc_tokens, ids`` (little-endian unsigned 32-bit bytes) per piece."""
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for lo, _, data, offsets in textops.slices(batch.column(1), GROUP_BYTES):
                at, starts, lengths, tokens, ids = [], [], [], [], []
                for i, own in enumerate(encode(data, offsets)):
                    own = np.append(own, end)
                    for s in range(0, len(own), size):
                        piece = own[s:s + size]
                        at.append(lo + i)
                        starts.append(s)
                        lengths.append(len(piece))
                        tokens.append(len(own))
                        ids.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "length", "doc_tokens", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType)] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")] + [T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(doc_id).alias("id"), cell(text).alias("text")).mapInArrow(cut, schema)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items within ``capacity``: dynamic programming over capacities."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    useful = useful[np.argsort(sizes[useful])]
    vs, ss = values[useful], sizes[useful]
    fit = np.searchsorted(ss, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fit[c]:
            gain = best[c - ss[:k]] + vs[:k]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], last[c] = gain[i], useful[i]
    counts = np.zeros(len(values))
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                      tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Pattern counts (columns: patterns, rows: sizes) and how often to use each, at least total use.

    It ends when no pattern is worth more than 1 + ``tolerance`` at the program's prices: then the use is
    within that share of the least. Exchanges are bounded by 20 a size; any basis is a whole
    answer, only less tight."""
    m = len(sizes)
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / (capacity // sizes))
    use = inverse @ demand
    for _ in range(20 * m):
        worth, enter = knapsack(inverse.sum(0), sizes, capacity)
        if worth <= 1 + tolerance:
            break
        step = inverse @ enter
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        use = np.maximum(use - theta * step, 0)
        use[out] = theta
        patterns[:, out] = enter
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return patterns.astype(int), use


def best_fit(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Remaining pieces, longest first, each into the fullest sequence that still has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[dict[int, int]] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            free = next((r for r in range(size, capacity + 1) if room[r]), None)
            if free is None:
                bins.append({})
                which, free = len(bins) - 1, capacity
            else:
                which = room[free].pop()
            bins[which][size] = bins[which].get(size, 0) + 1
            room[free - size].append(which)
    return bins


@dataclass
class Slots:
    """For each run of ranks of a class: sequences from ``base``, ``per`` slots of the class in each."""

    cls: np.ndarray
    first: np.ndarray
    per: np.ndarray
    base: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], capacity: int) -> Slots:
    """Slots for every piece of a histogram of length classes."""
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes], float)
    rows, sequences, given = [], 0, {int(s): 0 for s in sizes}

    def use(counts: dict[int, int], times: int) -> None:
        nonlocal sequences
        for s, per in counts.items():
            rows.append((s, given[s], per, sequences))
            given[s] += per * times
        sequences += times

    if len(sizes):
        patterns, x = column_generation(sizes, demand, capacity)
        for j in range(patterns.shape[1]):
            if (times := int(x[j] + 1e-7)) > 0:
                use({int(sizes[i]): int(patterns[i, j]) for i in np.flatnonzero(patterns[:, j])}, times)
        # a slot that rounding errors leave over stays empty
        for counts in best_fit({s: max(0, histogram[s] - given[s]) for s in given}, capacity):
            use(counts, 1)
    rows.sort()
    cls, first, per, base = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 4))
    return Slots(cls, first, per, base, sequences)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, grain: int = 16,
         payload: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset`` and the payload per piece.

    ``payload``: named expressions over ``ids`` (a piece's token bytes); the ids themselves by default."""
    payload = payload or {"ids": F.col("ids")}
    # pieces are numbered as they are written; only numbers and lengths are ranked, the ids cross one shuffle
    pieces = materialize(token_pieces(docs, tokenizer_path, size, end_id, doc_id, text).select(
        "id", "start", "length", "doc_tokens", *[c.alias(n) for n, c in payload.items()], F.monotonically_increasing_id().alias("piece"),
        F.ceil(F.col("length") / grain).cast("int").alias("class")), "pack-pieces")
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}   # at most size / grain rows
    salts = max(64, sum(histogram.values()) // SALT_ROWS)
    slots = plan(histogram, size // grain)

    salted = pieces.select("piece", "length", "class", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int").alias("salt"))
    counts = salted.groupBy("class", "salt").count()
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ranks_before"))
    order = Window.partitionBy("class", "salt").orderBy("piece")
    ranked = salted.withColumn("own_rank", F.row_number().over(order)).join(starts, ["class", "salt"]).withColumn(
        "rank", F.col("ranks_before") + F.col("own_rank") - 1)

    wide = max(histogram.values(), default=0) + 1
    keys = slots.cls * wide + slots.first

    @F.pandas_udf("struct<sequence_id:long,slot:long>")
    def place(cls: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k, r = cls.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, k * wide + r, "right") - 1
        own = r - slots.first[at]
        return pd.DataFrame({"sequence_id": slots.base[at] + own // slots.per[at], "slot": own % slots.per[at]})

    placed = ranked.withColumn("at", place("class", "rank")).select("*", "at.*")
    run = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "slot").rowsBetween(Window.unboundedPreceding, -1)
    places = materialize(placed.select("piece", "sequence_id", F.coalesce(F.sum("length").over(run), F.lit(0)).alias("offset")), "pack-places")
    return pieces.join(places.hint("shuffle_hash"), "piece").select(
        F.col("id").alias("doc_id"), "start", "length", "doc_tokens", *payload, "sequence_id", "offset")

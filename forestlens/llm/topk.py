"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers. Rows are cut into blocks; a block's index holds, for each
dimension, one bitmap per bit of the (offset) value, so adding a dimension to the scores of all rows
is bitmap arithmetic: a ripple of full adders over 64 rows per word. The lowest ``drop_bits`` slices are left
out of the sum, which bounds each score from below and above. A block's top rows are then selected from
the most significant slice of the sum downward; rows whose upper bound reaches the k-th lower bound
(the boundary) are resolved with exact inner products.

Blocks of queries meet blocks of rows; each pair yields at most k rows per query, and
the k best of all blocks are kept per query. Nothing but a block is held by a task.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors count as padded with zeros; a row is never its own candidate (rows that share an id
are that row); ties go to the smaller id, null ids take no part; fewer than k candidates: all; an empty
table gives no rows. Other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forestlens.llm.common import materialize

ROW_BLOCK = 16_384
QUERY_BLOCK = 512
TOGETHER = 16                  # queries added at once
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Row flags as a bitmap of 64-bit words."""
    padded = np.zeros((len(flags) + 63) // 64 * 64, bool)
    padded[:len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def unpack_bits(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


class BitSlicedIndex:
    """Slices of one block of integer vectors (rows x dimensions)."""

    def __init__(self, vectors: np.ndarray, drop_bits: int):
        self.vectors = vectors
        self.low = int(vectors.min(initial=0))
        span = int(vectors.max(initial=0)) - self.low
        self.drop = drop_bits
        self.top = (1 << max(span.bit_length(), 1)) - 1       # complement of v is top - v
        shifted = (vectors - self.low) >> drop_bits
        bits = range(max(self.top.bit_length() - drop_bits, 0))
        self.slices = [[pack_bits((shifted[:, d] >> b) & 1 > 0) for b in bits] for d in range(vectors.shape[1])]
        self.words = (len(vectors) + 63) // 64

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * z) per query, z the value or, for negative q, its complement, both
        without the dropped bits; carry-save: same-weight slices are added three to two."""
        magnitude = np.abs(queries)
        negative = np.where(queries < 0, ONES, np.uint64(0))[:, :, None]
        levels: dict[int, list[np.ndarray]] = {}

        def add(weight: int, bitmap: np.ndarray) -> None:
            column = levels.setdefault(weight, [])
            column.append(bitmap)
            while len(column) >= 3:
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                carry = a & b
                carry |= x & c
                x ^= c
                column.append(x)
                add(weight + 1, carry)
                column = levels[weight]

        for d, own in enumerate(self.slices):
            for j in range(int(magnitude[:, d].max(initial=0)).bit_length()):
                chosen = np.where((magnitude[:, d] >> j) & 1 > 0, ONES, np.uint64(0))[:, None]
                for b, bitmap in enumerate(own):
                    add(j + b, (bitmap[None, :] ^ negative[:, d]) & chosen)
        out, zero = [], np.zeros((len(queries), self.words), np.uint64)
        weight = 0
        while weight <= max(levels, default=-1):
            column = levels.get(weight, [])
            if len(column) == 2:
                a, b = column
                levels[weight] = [a ^ b]
                add(weight + 1, a & b)
            out.append(levels[weight][0] if levels.get(weight) else zero)
            weight += 1
        return out

    def at_least_kth(self, slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
        """The k-th largest sum among allowed rows, found slice by slice from the most significant."""
        n = len(allowed)
        candidates, bits = allowed.copy(), np.zeros(n, np.int64)
        need = np.full(n, k)
        for weight in reversed(range(len(slices))):
            with_bit = candidates & slices[weight]
            count = np.bitwise_count(with_bit).sum(1)
            take = count >= need
            bits = np.where(take, bits | (1 << weight), bits)
            need = np.where(take, need, need - count)
            candidates = np.where(take[:, None], with_bit, candidates & ~slices[weight])
        return bits

    def not_below(self, slices: list[np.ndarray], floor: np.ndarray) -> np.ndarray:
        """Rows whose sum is at least ``floor`` (per query)."""
        above = np.zeros((len(floor), self.words), np.uint64)
        equal = np.full((len(floor), self.words), ONES)
        for weight in reversed(range(len(slices))):
            bit = np.where((floor >> weight) & 1 > 0, ONES, np.uint64(0))[:, None]
            above |= equal & slices[weight] & ~bit
            equal &= ~(slices[weight] ^ bit)
        return above | equal

    def best(self, queries: np.ndarray, own_rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query, rows, exact scores)``, at most k rows each; ``own_rows``: rows a query may not take."""
        allowed = ~np.stack([pack_bits(o) for o in own_rows]) & pack_bits(np.ones(len(self.vectors), bool))[None, :]
        slices = self.sums(queries)
        kth = self.at_least_kth(slices, allowed, k)
        # exact sum = 2**drop * sliced sum + rest, 0 <= rest <= slack
        slack = ((1 << self.drop) - 1) * np.abs(queries).sum(1)
        reach = np.maximum(0, kth - (slack >> self.drop) - 1)
        boundary = self.not_below(slices, reach) & allowed
        for i, flags in enumerate(unpack_bits(boundary, len(self.vectors))):
            rows = np.flatnonzero(flags)
            scores = self.vectors[rows] @ queries[i]
            order = np.lexsort((ids[rows], -scores))[:k]
            yield i, rows[order], scores[order]


def quantised(vector: str | Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null if the vector or a component is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, drop_bits: int = 2,
          row_block: int = ROW_BLOCK, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each query, exactly."""
    ints = materialize(rows.select(F.col(vec_id).cast("long").alias("id"), quantised(vector, scale).alias("v"),
                                   F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null"), "topk-vectors")
    n, nq = ints.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-nq // QUERY_BLOCK))
    # Blocks by hash: even, and the same for a row whatever task holds it.
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    data = ints.select(block.alias("block"), every(query_blocks).alias("query_block"), "id", "v")
    asked = ints.filter("q").groupBy("id").agg(F.min("v").alias("v")).select(
        every(blocks).alias("block"), query_block.alias("query_block"), "id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(max(map(len, left["v"])), max(map(len, right["v"])))
            ids, query_ids = left["id"].to_numpy(), right["id"].to_numpy()
            index = BitSlicedIndex(matrix(left["v"], width), drop_bits)
            vectors = matrix(right["v"], width)
            for lo in range(0, len(query_ids), TOGETHER):
                part = query_ids[lo:lo + TOGETHER]
                for i, at, scores in index.best(vectors[lo:lo + TOGETHER], ids[None, :] == part[:, None], ids, k):
                    out.append(pd.DataFrame({"query_id": part[i], "vec_id": ids[at], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ["block", "query_block"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

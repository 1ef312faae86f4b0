"""Records with multiplicity: collapsing, dealing and splitting repeated rows.

Repeated rows are collapsed to ``(record, weight)`` by a partial + final aggregate, so a record that makes up
most of the input crosses the shuffle as one row per task. What follows works on records:

* :func:`deal` puts them into a given number of partitions by value, sorted inside. No partition
  can hold many copies of a record, as there is one row per record.
* :func:`split` shares the copies of all records out by weights, without moving a row. The copies of
  a record lie evenly spaced on a ring of ``RING`` positions, from an offset that its digest gives; a split takes the positions
  between two thresholds. The thresholds come from two histograms (``COARSE`` buckets, then only the boundary buckets),
  so each split has its exact number of rows, and each record's copies are shared within one row.

Both depend on the records alone: not on files, their order, the number of cores or shuffle partitions."""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "record_weight"
RING_BITS, COARSE_BITS = 31, 16
RING, COARSE = 1 << RING_BITS, 1 << COARSE_BITS
WIDTH_BITS = RING_BITS - COARSE_BITS


def _name(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def fields(df: DataFrame, weight: str = WEIGHT) -> list[str]:
    return [c for c in df.columns if c != weight]


def collapse(df: DataFrame, weight: str = WEIGHT) -> DataFrame:
    """Identical rows as one record with their number; records that have a weight are merged by it."""
    cols = [_name(c) for c in fields(df, weight)]
    n = F.sum(_name(weight)) if weight in df.columns else F.count(F.lit(1))
    return df.groupBy(*cols).agg(n.cast("long").alias(weight))


def expand(df: DataFrame, weight: str = WEIGHT) -> DataFrame:
    """One row per copy, without the weight."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), _name(weight))).alias("_copy")
    return df.filter(_name(weight) > 0).select(*[_name(c) for c in fields(df, weight)], copies).drop("_copy")


def digest(df: DataFrame, seed: int = 0, weight: str = WEIGHT) -> Column:
    """A 64-bit digest of a record. NULLs count (the hash function itself skips them)."""
    cols = fields(df, weight)
    nulls = F.concat(F.lit(""), *[F.when(_name(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(F.lit(seed).cast("long"), nulls, *[_name(c) for c in cols])


def deal(records: DataFrame, partitions: int, weight: str = WEIGHT) -> DataFrame:
    """Records dealt to ``partitions`` partitions by value and sorted inside."""
    cols = [_name(c) for c in fields(records, weight)]
    return records.repartition(partitions, *cols).sortWithinPartitions(*cols)


# --- splitting -----------------------------------------------------------------

_OFFSET, _COPIES = "_ring_offset", "_ring_copies"


def _on_ring(records: DataFrame, seed: int, weight: str) -> DataFrame:
    return records.withColumns({_OFFSET: F.pmod(digest(records, seed, weight), F.lit(RING).cast("long")), _COPIES: _name(weight)})


def _below(t: str) -> str:
    """How many copies of a record lie below ring position ``t``: copy k is at (offset + k * RING) div copies."""
    return f"greatest(0L, least({_COPIES}, ({t} * {_COPIES} - {_OFFSET} + {RING - 1}L) div {RING}L))"


def _position(k: str) -> str:
    return f"(({_OFFSET} + {k} * {RING}L) div {_COPIES})"


def thresholds(records: DataFrame, weights: Sequence[float], seed: int = 42, weight: str = WEIGHT) -> list[int]:
    """Ring positions ``0 = t0 <= t1 <= ... = RING`` such that the copies below ``tj`` are the rounded share of the first j
    weights. At most ``COARSE`` counts, then ``RING / COARSE`` for each inner threshold, come to the driver."""
    if not weights or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative, and not all zero")
    ring = _on_ring(records, seed, weight).filter(f"{_COPIES} > 0")
    # up to COARSE copies: each copy's bucket; more: every bucket's number of copies
    coarse = ring.withColumn("_k", F.expr(f"explode(sequence(0L, least({_COPIES}, {COARSE}L) - 1L))")).select(
        F.expr(f"CASE WHEN {_COPIES} <= {COARSE}L THEN shiftright({_position('_k')}, {WIDTH_BITS}) ELSE _k END").alias("bucket"),
        F.expr(f"CASE WHEN {_COPIES} <= {COARSE}L THEN 1L ELSE {_below(f'((_k + 1L) * {1 << WIDTH_BITS}L)')} - {_below(f'(_k * {1 << WIDTH_BITS}L)')} END").alias("n"))
    counts = sorted((r["bucket"], r["n"]) for r in coarse.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    total, share, goals = sum(n for _, n in counts), 0.0, []
    for w in weights[:-1]:
        share += w
        goals.append(min(total, int(total * (share / sum(weights)) + 0.5)))
    inside, before, at = {}, 0, 0       # boundary bucket -> copies before it
    where = []
    for goal in goals:
        while at < len(counts) and before + counts[at][1] < goal:
            before += counts[at][1]
            at += 1
        where.append(counts[at][0] if goal > before else None)
        if goal > before:
            inside[counts[at][0]] = before
    fine: dict[int, list[tuple[int, int]]] = {}
    if inside:
        edges = F.explode(F.array(*[F.lit(b).cast("long") for b in inside])).alias("_b")
        some = ring.select(_OFFSET, _COPIES, edges).withColumns({
            "_lo": F.expr(_below(f"(_b * {1 << WIDTH_BITS}L)")), "_hi": F.expr(_below(f"((_b + 1L) * {1 << WIDTH_BITS}L)"))})
        some = some.filter("_hi > _lo").select("_b", _OFFSET, _COPIES, F.expr("explode(sequence(_lo, _hi - 1L)) AS _k"))
        for r in some.groupBy("_b", F.expr(_position("_k")).alias("p")).count().collect():
            fine.setdefault(r["_b"], []).append((r["p"], r["count"]))
    out = [0]
    for goal, b in zip(goals, where):
        if b is None:
            out.append(out[-1])
            continue
        n, t = inside[b], b << WIDTH_BITS
        for p, m in sorted(fine[b]):
            if n + m > goal and goal - n <= n + m - goal:      # several copies on one position: the nearer end
                break
            n, t = n + m, p + 1
            if n >= goal:
                break
        out.append(max(t, out[-1]))
    return [*out, RING]


def split(records: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42, weight: str = WEIGHT) -> list[DataFrame]:
    """Records shared out by weights, each split with its own copies as the weight; partitions and order stay.
    Persist ``records``: the thresholds read them twice, each split once."""
    edges = thresholds(records, weights, seed, weight)
    ring = _on_ring(records, seed, weight)
    cols = [_name(c) for c in fields(records, weight)]
    return [ring.select(*cols, F.expr(f"{_below(f'{hi}L')} - {_below(f'{lo}L')}").alias(weight)).filter(_name(weight) > 0)
            for lo, hi in zip(edges, edges[1:])]


def persisted_records(df: DataFrame, partitions: int | None = None, weight: str = WEIGHT,
                      rows_each: int = 500_000, least: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """Collapsed and dealt records, persisted, and all frames to release. Without ``partitions`` their number follows
    the number of records, never cores or settings."""
    counted = collapse(df, weight).persist(StorageLevel.MEMORY_AND_DISK)
    if partitions is None:
        partitions = max(least, -(-counted.count() // rows_each))
    dealt = deal(counted, partitions, weight).persist(StorageLevel.MEMORY_AND_DISK)
    return dealt, [dealt, counted]

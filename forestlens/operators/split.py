"""Union, weighted random split and caching."""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def union_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Positional UNION ALL of the label column of both sets, pruned first so
    only one column is scanned."""
    return train.select(label).union(test.select(label))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """U1 on whole rows: positional, duplicates kept."""
    return a.union(b)


def random_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """Weighted random split. Membership depends on the input partitioning;
    persist the input (``persisted_split``) so every split sees the same rows."""
    return df.randomSplit(list(weights), seed)


def persisted_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42,
                    level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> tuple[DataFrame, list[DataFrame]]:
    """U2+U3: persist the input, then split it. Returns (persisted input, splits);
    release both with :func:`release` when done. A lost executor recomputes its
    blocks from the (deterministic) scan, so the splits stay disjoint."""
    base = df.persist(level)
    return base, [s for s in base.randomSplit(list(weights), seed)]


def fixed_partitions(df: DataFrame, partitions: int | None) -> DataFrame:
    """Rows dealt to a given number of partitions by their values and sorted inside, so that
    what follows partitions (a forest's bagging) doesn't depend on files or cores.
    ``None`` leaves the frame as it is."""
    if partitions is None:
        return df
    return df.repartition(partitions, *df.columns).sortWithinPartitions(*df.columns)


def partitions_for(df: DataFrame, rows_each: int = 500_000, least: int = 8) -> int:
    """A partition count that follows the number of rows, so it grows with the table and is
    the same on any cluster."""
    return max(least, -(-df.count() // rows_each))


def release(*dfs: DataFrame) -> None:
    """Unpersist exactly the frames that were persisted."""
    for d in dfs:
        d.unpersist()

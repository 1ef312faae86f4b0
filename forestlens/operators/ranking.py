"""Frequency ranks without a driver-side vocabulary (F1, F5 at any number of values).

Values are counted, sorted by count and value through a range partition, and written with their place in their partition; the sizes
of the partitions before (one row each) make it a place in the whole. Columns are then indexed by a join with that table.
Equal to a string index by descending frequency; ties fall by UTF-8 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forestlens.session import scratch_path

_PLACE_BITS = 33      # monotonically_increasing_id: partition number above, place in the partition below


def ranked(df: DataFrame, *order: Column, out: str = "index") -> DataFrame:
    """``df`` with each row's 0-based place in the total order; the sorted rows are written once to the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    rows = rows.withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.join(before, "_part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place).alias(out))


def frequency_index(df: DataFrame, col: str, weight: str | None = None, also: DataFrame | None = None) -> DataFrame:
    """``(value, n, index)`` of a column as text, most frequent first; NULLs get no index. With ``also``, over the union of
    both sets (F5); ``weight`` gives the rows that each record of ``df`` stands for."""
    one = F.lit(1).cast("long")
    cells = df.select(F.col(col).cast("string").alias("value"), (F.col(weight).cast("long") if weight else one).alias("n"))
    if also is not None:
        cells = cells.union(also.select(F.col(col).cast("string"), one))
    counts = cells.filter("value IS NOT NULL").groupBy("value").agg(F.sum("n").alias("n"))
    return ranked(counts, F.desc("n"), F.asc("value"))


def index_by_join(df: DataFrame, col: str, vocabulary: DataFrame, out: str | None = None, handle_invalid: str = "error") -> DataFrame:
    """``df`` with the index of ``col`` as a double. A value without an index (or NULL) fails the job, is left out
    (``skip``) or gets the number of values (``keep``). A hot value's rows are split by Spark (both sides are plain exchanges)."""
    if handle_invalid not in ("error", "keep", "skip"):
        raise ValueError("handle_invalid must be error, keep or skip")
    out = out or f"{col}_index"
    names = [F.col(f"`{c}`") for c in df.columns]
    table = vocabulary.select(F.col("value").alias("_value"), F.col("index").cast("double").alias(out))
    joined = df.join(table, F.col(f"`{col}`").cast("string") == F.col("_value"), "inner" if handle_invalid == "skip" else "left")
    index = F.col(out)
    if handle_invalid == "error":
        seen = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("NULL"))
        index = F.coalesce(index, F.raise_error(F.concat(F.lit(f"no index for {col}="), seen)).cast("double"))
    elif handle_invalid == "keep":
        index = F.coalesce(index, F.lit(float(vocabulary.count())))      # of a written table
    return joined.select(*names, index.alias(out))

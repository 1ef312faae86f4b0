"""Records staged once as Parquet bucketed by their digest (S1, C2, R1, U2 without a shuffle above the scan).

Raw rows are collapsed to ``(record, weight)`` and written with one file per bucket of the record digest. Later steps
read the table: distinct rows and splits are projections, class counts a small aggregate, and a comparison of two staged sets with the
same number of buckets joins bucket by bucket. Rows that make up most of the input are one row of one bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forestlens.operators import records as rc
from forestlens.session import scratch_path

DIGEST = "record_digest"


def stage_bucketed(df: DataFrame, buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` collapsed and written as the table ``name`` (an external table under ``path``, the shared folder by default), read back.
    Any earlier table of that name is replaced."""
    spark = df.sparkSession
    name = name or f"staged_{uuid.uuid4().hex[:12]}"
    recs = rc.collapse(df)
    recs = recs.select("*", rc.digest(recs).alias(DIGEST)).repartition(buckets, DIGEST)
    (recs.write.mode("overwrite").bucketBy(buckets, DIGEST).sortBy(DIGEST).option("path", path or scratch_path(spark, name))
     .format("parquet").saveAsTable(name))
    return spark.table(name)


def fields(staged: DataFrame) -> list[str]:
    return [c for c in staged.columns if c not in (DIGEST, rc.WEIGHT)]


def distinct_rows(staged: DataFrame) -> DataFrame:
    """The distinct rows; staging has made them so."""
    return staged.select(*[F.col(f"`{c}`") for c in fields(staged)])


def staged_class_distribution(staged: DataFrame, label: str) -> DataFrame:
    """Rows and distinct rows per class; only per-task sums of classes are shuffled."""
    return staged.groupBy(label).agg(F.sum(rc.WEIGHT).alias("count"), F.count(F.lit(1)).alias("dedup_count"))


def staged_split(staged: DataFrame, weights=(0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """U2 on staged records; buckets stay as they are."""
    return rc.split(staged.drop(DIGEST), weights, seed)


def records_in(a: DataFrame, b: DataFrame, how: str = "left_semi") -> DataFrame:
    """Records of staged ``a`` that staged ``b`` has (``left_anti``: has not), compared on all columns: a join of buckets
    if both have the same number of them."""
    x, y = a.alias("x"), b.select(DIGEST, *[F.col(f"`{c}`") for c in fields(b)]).alias("y").hint("merge")
    # equality of whole records, put so that the digest stays the only join key (buckets match on it alone)
    record = lambda side: F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in fields(a)])
    return x.join(y, (F.col(f"x.{DIGEST}") == F.col(f"y.{DIGEST}")) & F.array_contains(F.array(record("x")), record("y")), how)

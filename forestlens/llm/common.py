"""Helpers shared by the operators: written intermediate tables, column checks, text cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forestlens.session import remove_scratch, scratch_path

ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^ \t-\r]+"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back:
    lineage is cut, the planner knows the size, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one operator call. A write's shuffle files go as soon as it is done, and
    :meth:`remove` deletes the tables that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written under the shared folder and read back."""
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            path = scratch_path(self.spark, name)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove_scratch(self.spark, self.paths.pop(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell(text: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_key(doc_id: str) -> Column:
    """An integer id as a grouping key; a null id becomes the largest long."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))

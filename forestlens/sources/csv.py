"""Sources: typed CSV scan (S1) and saved confusion-matrix reader."""

from __future__ import annotations

from collections.abc import Callable
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forestlens.schema import connection_schema

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def read_typed_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                   mode: str = "PERMISSIVE", header: bool = False, sep: str = ",") -> DataFrame:
    """Headerless CSV with a declared schema (no inference pass).

    ``PERMISSIVE`` turns a bad cell into NULL, ``FAILFAST`` raises on it."""
    mode = mode.upper()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("mode", mode).csv(path if isinstance(path, str) else list(path)))


def read_connections(spark: SparkSession, path: str | Sequence[str], mode: str = "PERMISSIVE") -> DataFrame:
    """S1 for the 42-field connection records."""
    return read_typed_csv(spark, path, connection_schema(), mode)


def read_connections_strict(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S1 with its contract: no field is NULL. A bad cell or a short line fails the job and
    names the columns; a line with surplus fields fails as malformed."""
    schema = connection_schema()
    corrupt = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).csv(
        path if isinstance(path, str) else list(path))
    checked = require_not_null(rows, [f.name for f in schema.fields])
    surplus = F.raise_error(F.concat(F.lit("malformed record: "), F.col(corrupt)))
    return checked.filter(F.when(F.col(corrupt).isNotNull(), surplus).otherwise(F.lit(True))).drop(corrupt)


STATUS, REASON, FILE, LINE = "status", "reject_reason", "source_file", "raw_line"


def tag_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                illegal: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """S1 + C3 without a lost line: every line of the files with ``status`` (kept, rejected), ``reject_reason``,
    ``source_file`` and, where it can't be parsed, ``raw_line``. Reasons are ``malformed`` (a bad value, missing or
    surplus fields), ``null: <fields>``, and the names of the ``illegal`` rules whose condition holds. The observation
    counts lines, kept lines and rejects by kind in the pass that reads the frame."""
    rules = illegal or {}
    full = T.StructType([*schema.fields, T.StructField(LINE, T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE).csv(
        path if isinstance(path, str) else list(path))
    absent = F.concat_ws(",", *[F.when(F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in schema.fields])
    reason = F.when(F.col(LINE).isNotNull(), F.lit("malformed")).when(absent != "", F.concat(F.lit("null: "), absent))
    for name, rule in rules.items():
        reason = reason.when(F.coalesce(rule, F.lit(False)), F.lit(name))
    rows = rows.withColumns({REASON: reason, FILE: F.col("_metadata.file_path")})
    rows = rows.withColumn(STATUS, F.when(F.col(REASON).isNull(), F.lit("kept")).otherwise(F.lit("rejected")))
    seen = Observation()

    def number(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)

    kinds = {"malformed": F.col(REASON) == "malformed", "null": F.col(REASON).startswith("null: ")} | {n: F.col(REASON) == n for n in rules}
    counted = rows.observe(seen, F.count(F.lit(1)).alias("lines"), number(F.col(REASON).isNull(), "kept"),
                           *[number(c, n) for n, c in kinds.items()])
    return counted, seen


def stage_records(spark: SparkSession, path: str | Sequence[str], out: str, schema: T.StructType | None = None,
                  illegal: dict[str, Column] | None = None, clean: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """One pass over the files: kept and rejected lines as Parquet under ``out`` (``status=kept``, ``status=rejected``), and
    their numbers. ``clean`` changes columns of the rows on the way (e.g. the label's suffix)."""
    rows, seen = tag_records(spark, path, schema or connection_schema(), illegal)
    (clean(rows) if clean else rows).write.mode("overwrite").partitionBy(STATUS).parquet(out)
    return dict(seen.get)


def staged_records(spark: SparkSession, out: str, schema: T.StructType | None = None) -> DataFrame:
    """The kept lines of :func:`stage_records`, in the record schema."""
    schema = schema or connection_schema()
    return _staged(spark, out, schema, "kept").select(*[f.name for f in schema.fields])


def staged_rejects(spark: SparkSession, out: str, schema: T.StructType | None = None) -> DataFrame:
    """The rejected lines with their file, reason and text."""
    return _staged(spark, out, schema or connection_schema(), "rejected").drop(STATUS)


def _staged(spark: SparkSession, out: str, schema: T.StructType, status: str) -> DataFrame:
    extra = [T.StructField(c, T.StringType()) for c in (LINE, REASON, FILE, STATUS)]
    return spark.read.schema(T.StructType([*schema.fields, *extra])).parquet(out).filter(F.col(STATUS) == status)


def require_not_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Enforce the declared non-null contract lazily: the job fails on the first
    NULL in ``cols`` (default all columns) and names the columns. No extra pass over the data."""
    cols = list(cols) if cols else df.columns
    if not cols:
        return df
    names = F.concat_ws(",", *[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in cols])
    return df.filter(F.when(names != "", F.raise_error(F.concat(F.lit("NULL in a non-null column: "), names))).otherwise(F.lit(True)))


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved confusion matrix into long form
    ``(actual_idx, actual, predicted_idx, predicted, n)``.

    Takes both layouts: corner ``A\\P`` with class-name rows, and the older
    blank corner with row numbers. Cells are read as text and cast (they are
    written as doubles, e.g. ``204.0``)."""
    raw = spark.read.option("header", True).option("escape", "\u0000").csv(path)
    cols = raw.columns
    corner, classes = cols[0], cols[1:]
    names = F.array(*[F.lit(c) for c in classes])
    first = F.col(f"`{corner}`")
    numbered = corner in ("", "_c0")
    # Row label: either a class name, or the row number into the header classes.
    actual_idx = (first.cast("int") if numbered else (F.array_position(names, first) - 1).cast("int"))
    cells = F.array(*[
        F.struct(F.lit(j).alias("predicted_idx"), F.lit(c).alias("predicted"),
                 F.col(f"`{c}`").cast("double").alias("v"))
        for j, c in enumerate(classes)
    ])
    long = raw.select(actual_idx.alias("actual_idx"), F.explode(cells).alias("cell"))
    return long.select(
        "actual_idx", F.element_at(names, F.col("actual_idx") + 1).alias("actual"),
        F.col("cell.predicted_idx").alias("predicted_idx"), F.col("cell.predicted").alias("predicted"),
        F.col("cell.v").cast("long").alias("n"))

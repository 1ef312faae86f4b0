"""Feature engineering (F1-F3, F6) with spark.ml stages.

Several categorical columns are indexed by one multi-column StringIndexer and
encoded by one multi-column OneHotEncoder: one set of jobs for all columns,
instead of one per column."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX_SUFFIX = "_index"
VEC_SUFFIX = "_vec"
INVALID = ("error", "keep", "skip")


def index_stage(cols: Sequence[str], handle_invalid: str = "error", suffix: str = INDEX_SUFFIX,
                order: str = "frequencyDesc") -> StringIndexer:
    """``<c>`` -> ``<c>_index`` (frequency desc, ties alphabetical). An unseen
    value raises by default; ``keep`` gives it one extra last index."""
    if handle_invalid not in INVALID:
        raise ValueError(f"handle_invalid must be one of {INVALID}")
    cols = list(cols)
    return StringIndexer(inputCols=cols, outputCols=[c + suffix for c in cols],
                         handleInvalid=handle_invalid, stringOrderType=order)


def one_hot_stage(cols: Sequence[str], handle_invalid: str = "error", in_suffix: str = INDEX_SUFFIX,
                  out_suffix: str = VEC_SUFFIX, drop_last: bool = True) -> OneHotEncoder:
    """``<c>_index`` -> ``<c>_vec``; the last category is dropped (all zeros)."""
    cols = list(cols)
    return OneHotEncoder(inputCols=[c + in_suffix for c in cols], outputCols=[c + out_suffix for c in cols],
                         dropLast=drop_last, handleInvalid="keep" if handle_invalid == "keep" else "error")


def one_hot_pipeline(cols: Sequence[str], handle_invalid: str = "error") -> Pipeline:
    """index + one-hot for any number of columns as one two-stage pipeline."""
    return Pipeline(stages=[index_stage(cols, handle_invalid), one_hot_stage(cols, handle_invalid)])


def column_one_hot_pipeline(col: str) -> Pipeline:
    """F3 for one column (the study's per-column mini-pipeline)."""
    return one_hot_pipeline([col])


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with fewer than two distinct non-null values, which the one-hot
    encoder rejects. One aggregate pass (min/max per column), one row returned."""
    cols = list(cols)
    if not cols:
        return []
    row = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"_{i}"]]


def assembler(cols: Sequence[str], out: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    """numeric and vector columns, in the given order, into one vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def feature_order(schema_cols: Sequence[str], categorical: Sequence[str], exclude: Sequence[str] = (),
                  vec_suffix: str = VEC_SUFFIX) -> list[str]:
    """Assembler inputs in schema order, categorical columns as their vectors."""
    cat, ex = set(categorical), set(exclude)
    return [c + vec_suffix if c in cat else c for c in schema_cols if c not in ex]


def vector_slot_sums(df: DataFrame, features: str = "features") -> DataFrame:
    """Per vector slot, the sum over all rows: ``(slot, total)``.

    Uses the built-in vector aggregate (Summarizer), a partial + final aggregate
    of one vector per task; only the single summed vector is exploded."""
    summed = df.select(Summarizer.sum(F.col(features)).alias("s"))
    return summed.select(F.posexplode(vector_to_array("s")).alias("slot", "total"))


def vector_as_array(col: str, dtype: str = "float64"):
    return vector_to_array(F.col(col), dtype)

"""Cleaning, filters and de-duplication."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forestlens.functions.labels import binarize, strip_suffix
from forestlens.schema import ANOMALY_LABEL, LABEL_COLUMN, NORMAL_LABEL


def strip_label_suffix(df: DataFrame, label: str = LABEL_COLUMN, suffix: str = ".") -> DataFrame:
    """Drop the trailing period the raw files put at the end of every record."""
    return df.withColumn(label, strip_suffix(label, suffix))


def dedup_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact-row de-duplication (all columns unless ``cols`` is given).

    Planned as a partial + final hash aggregate on the row: duplicates collapse
    map-side before the shuffle, so a heavily repeated record costs one row per task."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def tag_by_rule(df: DataFrame, rule: Column, status: str = "status",
                kept: str = "kept", rejected: str = "rejected") -> DataFrame:
    """One pass: add a status column, ``rejected`` where the rule is TRUE.
    A rule that evaluates to NULL does not reject the row."""
    return df.withColumn(status, F.when(F.coalesce(rule, F.lit(False)), F.lit(rejected)).otherwise(F.lit(kept)))


def quarantine(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Split into (kept, rejected); rejected rows are kept in their own frame,
    not dropped. ``rule`` TRUE means illegal (e.g. ``service = 'icmp'``)."""
    bad = F.coalesce(rule, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def write_quarantined(df: DataFrame, rule: Column, path: str, status: str = "status",
                      fmt: str = "parquet", mode: str = "overwrite") -> str:
    """C3 at scale: kept and rejected rows written in one pass, partitioned by
    ``status`` (``<path>/status=kept``, ``<path>/status=rejected``)."""
    tag_by_rule(df, rule, status).write.mode(mode).partitionBy(status).format(fmt).save(path)
    return path


def illegal_service_rule(service: str = "service", value: str = "icmp") -> Column:
    """The study's illegal-record rule: a protocol name found in the service column."""
    return F.col(service) == F.lit(value)


def with_binary_label(df: DataFrame, label: str = LABEL_COLUMN, out: str | None = None,
                      normal: str = NORMAL_LABEL, anomaly: str = ANOMALY_LABEL) -> DataFrame:
    """P2 (and C4 when ``out`` is None): derive normal/anomaly labels."""
    return df.withColumn(out or label, binarize(label, normal, anomaly))


def binarize_dataset(df: DataFrame, label: str = LABEL_COLUMN,
                     normal: str = NORMAL_LABEL, anomaly: str = ANOMALY_LABEL) -> DataFrame:
    """C4: the whole data set with its label replaced by normal/anomaly; write it
    with :func:`forestlens.sources.sinks.write_records`."""
    return with_binary_label(df, label, None, normal, anomaly)


def select_labels(df: DataFrame, *cols: str) -> DataFrame:
    """The prediction pair / triplet projection."""
    return df.select(*cols)

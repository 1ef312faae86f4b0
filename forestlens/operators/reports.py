"""Reports from the study's notes (R1-R7), as aggregations.

Every report first reduces the raw rows with a partial + final aggregate to one
row per class (or per distinct record), and only then joins, so joins and sorts
run on class-sized frames and a hot class costs nothing extra."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forestlens.functions.labels import category_of, cell_opacity
from forestlens.operators.evaluate import ClassDomain
from forestlens.schema import ANOMALY_LABEL, CATEGORY_MAP, NORMAL_LABEL, UNKNOWN_CATEGORY


def _distinct_with_multiplicity(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    cols = list(cols) if cols else df.columns
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))


def class_counts(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Per class: raw row count and de-duplicated row count, in one pass.

    Rows are first grouped on all columns (``cols``, default every column) into
    distinct records with their multiplicity; a second, class-sized aggregate sums
    both. Exact distinct, not approximate."""
    if cols and label not in cols:
        raise ValueError("the label must be one of the de-duplication columns")
    return (_distinct_with_multiplicity(df, cols)
            .groupBy(label)
            .agg(F.sum("_n").cast("long").alias("count"), F.count(F.lit(1)).alias("dedup_count")))


def class_distribution(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Class, count, de-duplicated count, sorted by count (desc), then class."""
    return class_counts(df, label, cols).orderBy(F.desc("count"), F.asc(label))


def category_rollup(df: DataFrame, label: str, category_map: dict[str, list[str]] = CATEGORY_MAP,
                    cols: Sequence[str] | None = None, unknown: str = UNKNOWN_CATEGORY,
                    total_name: str = "TOTAL") -> DataFrame:
    """R2: class -> category, both counts per category, plus a grand-total row
    (``ROLLUP``). Classes outside the map roll up to ``unknown``."""
    return rollup_class_counts(class_counts(df, label, cols), label, category_map, unknown, total_name)


def rollup_class_counts(per_class: DataFrame, label: str, category_map: dict[str, list[str]] = CATEGORY_MAP,
                        unknown: str = UNKNOWN_CATEGORY, total_name: str = "TOTAL") -> DataFrame:
    """R2 on per-class ``(label, count, dedup_count)`` rows (class-sized input)."""
    per_class = per_class.withColumn("category", category_of(label, category_map, unknown))
    rolled = per_class.rollup("category").agg(
        F.sum("count").cast("long").alias("count"), F.sum("dedup_count").cast("long").alias("dedup_count"),
        F.grouping("category").alias("_g"))
    return rolled.select(
        F.when(F.col("_g") == 1, F.lit(total_name)).otherwise(F.col("category")).alias("category"),
        "count", "dedup_count").orderBy(F.col("category") == total_name, F.desc("count"))


def label_attribution(pred: DataFrame, actual: str, predicted: str, train: DataFrame | None = None,
                      train_label: str | None = None, domain: ClassDomain | None = None,
                      normal: str = NORMAL_LABEL, anomaly: str = ANOMALY_LABEL) -> DataFrame:
    """Per actual class: rows labeled ``normal`` and ``anomaly`` by a binary model, rows labeled
    otherwise (``labeled_other``, NULL predictions included), their ``total``, and whether the
    class occurs in training (from ``train`` rows or a domain). Rows without a label are a
    class of their own (NULL), so the totals add up to the rows of ``pred``."""
    per_class = pred.groupBy(F.col(actual).alias("attack_type")).agg(
        F.count(F.when(F.col(predicted) == normal, 1)).alias("labeled_normal"),
        F.count(F.when(F.col(predicted) == anomaly, 1)).alias("labeled_anomaly"),
        F.count(F.when(~F.coalesce(F.col(predicted).isin(normal, anomaly), F.lit(False)), 1)).alias("labeled_other"),
        F.count(F.lit(1)).alias("total"))
    if train is not None:
        seen = (train.select(F.col(train_label or actual).alias("_seen_type")).distinct()
                .withColumn("in_train", F.lit(True)))
        per_class = (per_class.join(seen, F.col("attack_type").eqNullSafe(F.col("_seen_type")), "left").drop("_seen_type")
                     .withColumn("in_train", F.coalesce(F.col("in_train"), F.lit(False))))
    elif domain is not None:
        per_class = per_class.withColumn("in_train", domain.in_train_of(F.col("attack_type")))
    else:
        per_class = per_class.withColumn("in_train", F.lit(None).cast("boolean"))
    return per_class


def false_normal_attribution(attr: DataFrame, min_errors: int = 20, normal: str = NORMAL_LABEL) -> DataFrame:
    """Attack classes with at least ``min_errors`` rows labeled normal, by errors desc."""
    return (attr.filter(~F.col("attack_type").eqNullSafe(normal) & (F.col("labeled_normal") >= min_errors))
            .select("attack_type", "labeled_normal", "labeled_anomaly", "in_train")
            .orderBy(F.desc("labeled_normal"), F.asc("attack_type")))


def correct_anomaly_attribution(attr: DataFrame, min_correct: int = 100, normal: str = NORMAL_LABEL) -> DataFrame:
    """Attack classes with at least ``min_correct`` rows labeled anomaly, by those desc."""
    return (attr.filter(~F.col("attack_type").eqNullSafe(normal) & (F.col("labeled_anomaly") >= min_correct))
            .select("attack_type", "labeled_anomaly", "labeled_normal", "in_train")
            .orderBy(F.desc("labeled_anomaly"), F.asc("attack_type")))


def excluded_tail(attr: DataFrame, min_errors: int = 20, normal: str = NORMAL_LABEL) -> DataFrame:
    """The classes R3 leaves out (0 < errors < threshold): how many, and their rows."""
    tail = attr.filter(~F.col("attack_type").eqNullSafe(normal) & (F.col("labeled_normal") > 0)
                       & (F.col("labeled_normal") < min_errors))
    return tail.agg(F.count(F.lit(1)).alias("labels"),
                    F.coalesce(F.sum("labeled_normal"), F.lit(0)).cast("long").alias("instances"))


def unseen_class_rows(train: DataFrame, test: DataFrame, label: str, test_label: str | None = None,
                      weight: str | None = None) -> DataFrame:
    """Test rows whose class never occurs in training, and the total.

    A NULL label is a class like any other: unseen only if no training row has it.
    Both sides are reduced to one row per class before the join, so neither
    raw side is shuffled by the join. ``weight`` counts a test row that many times
    (for pre-aggregated input)."""
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    test_counts = test.groupBy(F.col(test_label or label).alias("_c")).agg(n.alias("_n"))
    seen = train.select(F.col(label).alias("_t")).distinct().withColumn("_seen", F.lit(True))
    j = test_counts.join(seen, F.col("_c").eqNullSafe(F.col("_t")), "left")
    unseen = F.col("_seen").isNull()
    return j.agg(
        F.coalesce(F.sum(F.when(unseen, F.col("_n"))), F.lit(0)).cast("long").alias("unseen_rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_rows"),
        F.count(F.when(unseen, 1)).alias("unseen_classes"))


def heatmap_cells(matrix: DataFrame, domain: ClassDomain | None = None) -> DataFrame:
    """One cell per matrix entry: x = predicted index, y = actual index, count,
    shading, and whether the row / column class was seen in training (the
    quadrant lines of the plot)."""
    out = matrix.select(
        F.col("predicted_idx").alias("x"), F.col("actual_idx").alias("y"),
        "actual", "predicted", F.col("n").cast("long").alias("n"),
        cell_opacity("n").alias("opacity"))
    if domain is not None:
        out = out.withColumn("actual_in_train", domain.in_train_of(F.col("actual"))) \
                 .withColumn("predicted_in_train", domain.in_train_of(F.col("predicted")))
    return out

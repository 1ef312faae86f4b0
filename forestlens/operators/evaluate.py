"""Evaluation as Spark aggregates.

Predictions are never collected: ``(actual, predicted)`` pairs are counted with
a partial (map-side) hash aggregate, so the shuffle carries at most k^2 rows per
map task however skewed the labels are (one cell may hold a third of all rows
and still collapses to a single row per task). Everything after that works on
the k^2-row matrix.

Numeric rules follow the study's confusion-matrix class:
  * precision of a never-predicted class is 0;
  * recall of a zero-support class is NaN and is left out of the weighted recall;
  * per-class F1 is NaN when precision + recall is 0;
  * overall F1 is the harmonic mean of weighted precision and weighted recall
    (not the support-weighted mean of per-class F1 that Spark's evaluator returns).
Overall metrics of an empty input are NULL (the study gives NaN / throws).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAN = float("nan")


def sql_string(value: str) -> str:
    """A Spark SQL string literal for ``value``."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class ClassDomain:
    """Ordered class list (matrix order) plus the classes seen in training.

    Expressions built from it are O(k) literals (lookups by hash set); the dense grid it
    generates has k^2 rows and is streamed, never held as one array."""

    classes: tuple[str, ...]
    train_classes: frozenset[str] | None = None

    def __post_init__(self):
        classes = tuple(self.classes)
        object.__setattr__(self, "classes", classes)
        if not classes:
            raise ValueError("class domain is empty")
        if len(set(classes)) != len(classes):
            raise ValueError("class domain has duplicates")
        if self.train_classes is not None:
            object.__setattr__(self, "train_classes", frozenset(self.train_classes))

    @classmethod
    def of(cls, classes: Iterable[str], train_classes: Iterable[str] | None = None) -> "ClassDomain":
        return cls(tuple(classes), None if train_classes is None else frozenset(train_classes))

    def __len__(self) -> int:
        return len(self.classes)

    def seen(self, c: str) -> bool:
        return True if self.train_classes is None else c in self.train_classes

    def contains(self, col: Column) -> Column:
        """TRUE if the label is in the domain; NULL labels count as outside."""
        return F.coalesce(col.isin(list(self.classes)), F.lit(False))

    def in_train_of(self, col: Column) -> Column:
        if self.train_classes is None:
            return F.lit(True)
        return F.coalesce(col.isin(sorted(self.train_classes)), F.lit(False))

    def _structs_sql(self) -> str:
        return "array(" + ", ".join(
            f"named_struct('idx', {i}, 'name', {sql_string(c)}, 'seen', {'true' if self.seen(c) else 'false'})"
            for i, c in enumerate(self.classes)) + ")"

    def class_structs(self) -> Column:
        return F.expr(self._structs_sql())

    def grid(self, base: DataFrame) -> DataFrame:
        """``base`` times all k^2 (actual, predicted) cells, by two generators over the
        k-class literal: rows are made one by one, no k^2-sized value exists."""
        d = self._structs_sql()
        keys = [F.col(f"`{c}`") for c in base.columns]
        rows = base.select(*keys, F.expr(f"inline({d}) AS (actual_idx, actual, _a_seen)"))
        return rows.select(*keys, "actual_idx", "actual", F.expr(f"inline({d}) AS (predicted_idx, predicted, _p_seen)")).drop("_p_seen")

    def to_df(self, spark: SparkSession) -> DataFrame:
        """``(class_idx int, class string, in_train boolean)``."""
        return spark.range(0, 1, 1, 1).select(F.explode(self.class_structs()).alias("c")).select(
            F.col("c.idx").alias("class_idx"), F.col("c.name").alias("class"), F.col("c.seen").alias("in_train"))


def _cols(keys: Sequence[str] | str | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


# --- E1/E2 ------------------------------------------------------------------

def confusion_counts(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     keys: Sequence[str] | str | None = None, weight: str | None = None) -> DataFrame:
    """Sparse counts ``(keys..., actual, predicted, n)``: one partial + final aggregate. A row
    counts as many times as its ``weight`` says (once without one)."""
    keys = _cols(keys)
    n = F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))
    return (pred.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
            .agg(n.alias("n")))


def stray_labels(counts: DataFrame, domain: ClassDomain) -> DataFrame:
    """Aggregated cells whose actual or predicted label is outside the domain."""
    ok = domain.contains(F.col("actual")) & domain.contains(F.col("predicted"))
    return counts.filter(~ok)


def require_in_domain(counts: DataFrame, domain: ClassDomain) -> DataFrame:
    """Lazily fail the job if a label is outside the domain (the check runs inside
    the same job as the aggregate, no extra pass). The predicate references the
    aggregated count, so the optimizer keeps it above the aggregate: it runs once
    per matrix cell, not once per raw row."""
    ok = domain.contains(F.col("actual")) & domain.contains(F.col("predicted"))
    msg = F.concat(F.lit("label outside the class domain: actual="), F.coalesce(F.col("actual"), F.lit("NULL")),
                   F.lit(", predicted="), F.coalesce(F.col("predicted"), F.lit("NULL")))
    return counts.filter(F.when(~ok, F.raise_error(msg)).otherwise(F.col("n") >= 0))


def split_strays(counts: DataFrame, domain: ClassDomain) -> tuple[DataFrame, DataFrame]:
    """``(cells inside the domain, stray cells with their counts)``: nothing is dropped unseen."""
    ok = domain.contains(F.col("actual")) & domain.contains(F.col("predicted"))
    return counts.filter(ok), counts.filter(~ok)


def dense_matrix(counts: DataFrame, domain: ClassDomain, keys: Sequence[str] | str | None = None) -> DataFrame:
    """Dense long matrix ``(keys..., actual_idx, actual, predicted_idx, predicted, n)``
    with every domain cell present (zeros kept) for each key value seen. A label outside
    the domain fails the job; :func:`split_strays` sets such cells apart first.

    The k^2 grid is generated over the (tiny) distinct key rows, then left-joined to the
    aggregated counts: no join touches raw rows, and Spark picks the join by size at run time."""
    keys = _cols(keys)
    counts = require_in_domain(counts, domain)
    if not keys:
        grid = domain.grid(counts.sparkSession.range(0, 1, 1, 1))
        joined = grid.join(counts, on=["actual", "predicted"], how="left")
    else:
        # Key values may be NULL (a split with no id): match them null-safely.
        g, c = domain.grid(counts.select(*keys).distinct()).alias("_g"), counts.alias("_c")
        cond = [F.col(f"_g.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in keys] + [
            F.col("_g.actual") == F.col("_c.actual"), F.col("_g.predicted") == F.col("_c.predicted")]
        joined = g.join(c, on=cond, how="left").select(
            *[F.col(f"_g.{k}").alias(k) for k in keys],
            *[F.col(f"_g.{x}").alias(x) for x in ("actual_idx", "actual", "predicted_idx", "predicted")],
            F.col("_c.n").alias("n"))
    return joined.select(*keys, "actual_idx", "actual", "predicted_idx", "predicted",
                         F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def confusion_matrix(pred: DataFrame, domain: ClassDomain, actual: str = "actual", predicted: str = "predicted",
                     keys: Sequence[str] | str | None = None, weight: str | None = None) -> DataFrame:
    """E1+E2: dense confusion matrix over a declared domain."""
    return dense_matrix(confusion_counts(pred, actual, predicted, keys, weight), domain, keys)


# --- the domain as a table -----------------------------------------------------
# For domains of any size: classes are joined in, so the plan does not grow with them. ``domain`` is
# a frame ``(class_idx, class, in_train)`` with one row per class, as ``ClassDomain.to_df`` gives it.

def table_strays(counts: DataFrame, domain: DataFrame) -> DataFrame:
    """Aggregated cells whose actual or predicted label (or NULL) is not in the domain table."""
    known = domain.select("class")
    by_actual = counts.join(known, F.col("actual") == F.col("class"), "left_anti")
    rest = counts.join(known, F.col("actual") == F.col("class"), "left_semi")
    return by_actual.union(rest.join(known, F.col("predicted") == F.col("class"), "left_anti"))


def indexed_counts(counts: DataFrame, domain: DataFrame, strict: bool = True) -> DataFrame:
    """The sparse matrix ``(actual_idx, actual, predicted_idx, predicted, n)`` by two joins of aggregated cells. A label
    outside the domain fails the job; without ``strict`` its cells are left out (see :func:`table_strays`)."""
    a = domain.select(F.col("class").alias("actual"), F.col("class_idx").alias("actual_idx"))
    p = domain.select(F.col("class").alias("predicted"), F.col("class_idx").alias("predicted_idx"))
    how = "left" if strict else "inner"
    cells = counts.join(a, "actual", how).join(p, "predicted", how)
    if strict:
        msg = F.concat(F.lit("label outside the class domain: actual="), F.coalesce(F.col("actual"), F.lit("NULL")),
                       F.lit(", predicted="), F.coalesce(F.col("predicted"), F.lit("NULL")))
        stray = F.col("actual_idx").isNull() | F.col("predicted_idx").isNull()
        cells = cells.filter(F.when(stray, F.raise_error(msg)).otherwise(F.col("n") >= 0))
    return cells.select("actual_idx", "actual", "predicted_idx", "predicted", F.col("n").cast("long").alias("n"))


def with_every_class(cells: DataFrame, domain: DataFrame) -> DataFrame:
    """A sparse matrix with a zero diagonal cell for each class of the domain table, so that every class is listed by
    :func:`per_class_metrics` without a dense grid."""
    zero = domain.select(F.col("class_idx").alias("actual_idx"), F.col("class").alias("actual"), F.col("class_idx").alias("predicted_idx"),
                         F.col("class").alias("predicted"), F.lit(0).cast("long").alias("n"))
    return cells.union(zero).groupBy("actual_idx", "actual", "predicted_idx", "predicted").agg(F.sum("n").alias("n"))


# --- E3/E5/E7/E9 ------------------------------------------------------------

def per_class_metrics(matrix: DataFrame, keys: Sequence[str] | str | None = None) -> DataFrame:
    """Per class: support, predicted_total, tp, precision, recall, f1, class_ratio.

    Input is a dense matrix (so every domain class appears), or sparse counts
    (then only classes that occur are listed, without indices). Each cell contributes
    to its row class (support, tp) and to its column class (predicted_total); one
    aggregate over the k^2 cells gives all sums."""
    keys = _cols(keys)
    sparse = "actual_idx" not in matrix.columns     # sparse counts: no indices, classes by name
    a_idx = F.lit(None).cast("int") if sparse else F.col("actual_idx")
    p_idx = F.lit(None).cast("int") if sparse else F.col("predicted_idx")
    zero = F.lit(0).cast("long")
    n = F.col("n").cast("long")
    contrib = matrix.select(*keys, F.inline(F.array(
        F.struct(a_idx.alias("class_idx"), F.col("actual").alias("class"), n.alias("support"),
                 F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero).alias("tp"),
                 zero.alias("predicted_total")),
        F.struct(p_idx.alias("class_idx"), F.col("predicted").alias("class"), zero.alias("support"),
                 zero.alias("tp"), n.alias("predicted_total")))))
    sums = contrib.groupBy(*keys, "class_idx", "class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted_total").alias("predicted_total"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum("support").over(w)
    tp = F.col("tp").cast("double")
    precision = F.when(F.col("predicted_total") == 0, F.lit(0.0)).otherwise(tp / F.col("predicted_total"))
    recall = F.when(F.col("support") == 0, F.lit(NAN)).otherwise(tp / F.col("support"))
    # f1 reuses the two expressions; Catalyst evaluates common subexpressions once
    f1 = F.when(precision + recall == 0, F.lit(NAN)).otherwise(
        F.lit(2.0) * ((precision * recall) / (precision + recall)))
    return sums.select(
        *keys, "class_idx", "class", "support", "predicted_total", "tp",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        F.when(total > 0, F.col("support") / total).alias("class_ratio"))


# --- E4/E6/E8/E10 -----------------------------------------------------------

def overall_metrics(per_class: DataFrame, keys: Sequence[str] | str | None = None) -> DataFrame:
    """Weighted precision (E4), weighted recall (E6, equals accuracy), and F1."""
    keys = _cols(keys)
    r = F.col("recall")
    agg = per_class.groupBy(*keys).agg(
        F.sum(F.col("precision") * F.col("class_ratio")).alias("precision"),
        F.sum(F.when(~F.isnan(r * F.col("class_ratio")), r * F.col("class_ratio"))).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r == 0, F.lit(NAN)).otherwise(F.lit(2.0) * ((p * r) / (p + r)))
    return agg.select(*keys, "precision", "recall", f1.alias("f1"))


def metrics_table(pred: DataFrame, domain: ClassDomain, actual: str = "actual", predicted: str = "predicted",
                  split: str | None = None, weight: str | None = None) -> DataFrame:
    """One metrics row per split value in one job (``split, precision, recall, f1``).
    Without a split column there is one row, numbered 0 as in the study's file."""
    keys = [split] if split else []
    # Weighted metrics need no zero cells (a class with neither support nor
    # predictions adds 0 to both sums), so the domain-checked sparse counts are
    # used directly: no per-split grid, no join.
    counts = require_in_domain(confusion_counts(pred, actual, predicted, keys, weight), domain)
    om = overall_metrics(per_class_metrics(counts, keys), keys)
    if split:
        return om.withColumnRenamed(split, "split")
    return om.select(F.lit(0).alias("split"), "precision", "recall", "f1")


@dataclass
class Evaluation:
    counts: DataFrame
    matrix: DataFrame
    per_class: DataFrame
    overall: DataFrame


def evaluate(pred: DataFrame, domain: ClassDomain, actual: str = "actual", predicted: str = "predicted",
             keys: Sequence[str] | str | None = None, checkpoint: bool = False, weight: str | None = None) -> Evaluation:
    """All evaluation frames. With ``checkpoint=True`` the dense matrix (k^2 rows)
    is written once to the reliable checkpoint folder, so the reports derived from it
    never re-run scoring, and survive lost executors."""
    counts = confusion_counts(pred, actual, predicted, keys, weight)
    matrix = dense_matrix(counts, domain, keys)
    if checkpoint:
        from forestlens.session import checkpoint_root
        checkpoint_root(matrix.sparkSession)
        matrix = matrix.checkpoint(eager=True)
    pc = per_class_metrics(matrix, keys)
    return Evaluation(counts, matrix, pc, overall_metrics(pc, keys))

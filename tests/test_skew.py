"""A hot cell holding 40% of all rows costs one shuffled row per map task."""
from pyspark.sql import functions as F

from forestlens.operators import evaluate as ev, reports
from tests.plan_shape import shuffle_records_written

N, TASKS = 400_000, 8


def _skewed(spark):
    # 40% of rows in one (actual, predicted) cell, the rest spread over 5 x 5 cells
    ids = spark.range(0, N, 1, TASKS)
    hot = F.col("id") % 5 < 2
    return ids.select(
        F.when(hot, F.lit("c0")).otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("actual"),
        F.when(hot, F.lit("c0")).otherwise(F.concat(F.lit("c"), (F.col("id") % 7 % 5).cast("string"))).alias(
            "predicted"),
        F.col("id"))


def test_confusion_counts_shuffle_is_bounded_by_cells(spark):
    dom = ev.ClassDomain.of([f"c{i}" for i in range(5)])
    m = ev.confusion_matrix(_skewed(spark), dom)
    rows = m.collect()
    assert sum(r["n"] for r in rows) == N
    written = shuffle_records_written(m)
    assert written and max(written) <= TASKS * len(dom) ** 2


def test_class_counts_shuffle_collapses_duplicates(spark):
    # one record repeated for 40% of the rows: de-dup counting shuffles it once per task
    df = _skewed(spark).select("actual", (F.col("id") % 1000).alias("k"))
    df = df.withColumn("k", F.when(F.col("actual") == "c0", F.lit(-1)).otherwise(F.col("k")))
    out = reports.class_counts(df, "actual")
    rows = {r["actual"]: (r["count"], r["dedup_count"]) for r in out.collect()}
    assert rows["c0"][1] == 1 and sum(c for c, _ in rows.values()) == N
    written = shuffle_records_written(out)
    # first exchange: distinct records per task (<= 1000 keys x 5 labels + 1 hot record), never raw rows
    assert written and max(written) <= TASKS * (1000 * 4 + 1)

"""Bucketed staging: right results, and no exchange above the scan."""

from collections import Counter

from pyspark.sql import functions as F

from forestlens.operators import records as rc, reports
from forestlens.sources import staging
from tests.test_incremental import batch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def test_staged_steps(spark):
    df, distinct = batch(spark, 3)
    staged = staging.stage_bucketed(df, 4)
    assert rows(rc.expand(staged.drop(staging.DIGEST))) == rows(df)
    assert rows(staging.distinct_rows(staged)) == Counter(distinct)
    assert rows(staging.staged_class_distribution(staged, "k")) == rows(reports.class_distribution(df, "k").select("k", "count", "dedup_count"))
    train, test = staging.staged_split(staged)
    assert rows(rc.expand(train)) + rows(rc.expand(test)) == rows(df)
    for x in (staging.distinct_rows(staged), train, test):
        assert "Exchange" not in plan(x)


def test_staged_sets_join_bucket_by_bucket(spark):
    (a, one), (b, two) = batch(spark, 3), batch(spark, 4)
    x, y = staging.stage_bucketed(a, 4), staging.stage_bucketed(b, 4)
    both, rest = staging.records_in(x, y), staging.records_in(x, y, "left_anti")
    assert "Exchange" not in plan(both) and "Exchange" not in plan(rest) and "SortMergeJoin" in plan(both)
    assert rows(staging.distinct_rows(both)) == Counter(one & two) and rows(staging.distinct_rows(rest)) == Counter(one - two)


def test_a_hot_record_is_one_row(spark):
    hot = spark.range(10_000).select(F.lit("smurf").alias("k"), (F.col("id") % 3).alias("v"))
    staged = staging.stage_bucketed(hot, 4)
    assert staged.count() == 3 and staged.agg(F.sum(rc.WEIGHT)).first()[0] == 10_000
    assert staging.stage_bucketed(hot.limit(0), 2).count() == 0

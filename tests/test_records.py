"""Splits and fits over records with multiplicity: independent of layout, exact, no hot partition."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forestlens.operators import evaluate as ev, records as rc
from forestlens.plans import experiments as xp
from tests.conftest import SF_SMALL


def frame(spark, seed=1, n=4000):
    rng = random.Random(seed)
    rows = [("hot", 1, None)] * (n // 2) + [(rng.choice("abc"), rng.randint(0, 400), rng.choice([None, "x"])) for _ in range(n // 2)]
    rows += [(None, 1, "x"), ("x", 1, None), (None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, v int, w string"), rows


def table(df):
    return Counter({tuple(r)[:-1]: r[-1] for r in df.collect()})


def test_collapse_and_expand(spark):
    df, rows = frame(spark)
    got = rc.collapse(df)
    assert table(got) == Counter(rows)
    assert table(rc.collapse(got.union(got))) == Counter(rows * 2)
    assert Counter(map(tuple, rc.expand(got).collect())) == Counter(rows)
    assert rc.collapse(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [(0.8, 0.2), (1, 1, 1), (0.5, 0, 0.25, 0.25), (1,), (0, 1)])
def test_split_is_exact_and_independent_of_layout(spark, weights):
    df, rows = frame(spark)
    want, parts = Counter(rows), []
    for n in (1, 7):
        splits = rc.split(rc.collapse(df.repartition(n)), weights)
        parts.append([table(s) for s in splits])
    assert parts[0] == parts[1]
    assert sum(parts[0], Counter()) == want
    total, share = len(rows), 0
    sizes = [sum(p.values()) for p in parts[0]]
    for i, w in enumerate(weights):
        share += w
        assert abs(sum(sizes[:i + 1]) - total * share / sum(weights)) <= 1
    for r, m in want.items():          # each record within a row of its share of the ring
        for w, p in zip(weights, parts[0]):
            assert abs(p[r] - m * w / sum(weights)) <= 1 + 0.05 * m


def test_split_of_one_record_and_of_many_copies(spark):
    one = spark.createDataFrame([("a", 1_000_003)], f"k string, {rc.WEIGHT} long")
    assert [r[rc.WEIGHT] for s in rc.split(one, (0.8, 0.2)) for r in s.collect()] == [800_002, 200_001]
    assert [s.count() for s in rc.split(one.limit(0), (0.8, 0.2))] == [0, 0]
    a, b = (table(rc.split(rc.collapse(frame(spark)[0]), seed=s)[0]) for s in (1, 2))
    assert a != b
    with pytest.raises(ValueError):
        rc.split(one, (-1, 2))


def test_no_partition_holds_the_copies_of_a_record(spark):
    """80 % identical rows: the largest partition stays near the mean, and no row of the split is moved."""
    df = spark.range(0, 50_000, 1, 8).select(F.when(F.col("id") % 5 != 0, -1).otherwise(F.col("id")).alias("v"), (F.col("id") * 0).alias("c"))
    dealt, held = rc.persisted_records(df, 8)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_001 and max(sizes) < 1.5 * sum(sizes) / 8
    train, _ = rc.split(dealt)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange") == 0
    for h in held:
        h.unpersist()


def noisy(spark):
    return fx_lineitem(spark).select("l_linestatus", (F.floor(F.col("l_quantity") / 10)).cast("int").alias("q"), "l_discount",
                                     F.col("l_returnflag").alias("attack_type"))


def fx_lineitem(spark):
    return spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")


NOISY = dict(categorical=["l_linestatus"], features=["l_linestatus_vec", "q", "l_discount"], classes=["A", "N", "R"])


def test_forest_and_split_follow_the_records_only(spark):
    """No partition count given: the same split, vocabulary, predictions and matrix for any layout of the input."""
    out = []
    for parts in (2, 9):
        r = xp.run_experiment(noisy(spark).repartition(parts), None, xp.ExperimentConfig(5, 6, label_scope="train", **NOISY))
        try:
            assert r.scored.columns[-1] != r.weight and r.weight in r.scored.columns
            matrix = sorted(map(tuple, r.evaluation().matrix.collect()))
            rows = Counter(map(tuple, r.pairs().collect()))
            assert {(c[1], c[3]): c[4] for c in matrix if c[4]} == dict(rows)
            out.append((r.labels, matrix, r.train.count(), r.test.count()))
        finally:
            r.release()
    n = noisy(spark).count()
    assert out[0] == out[1] and out[0][2] + out[0][3] == n and abs(out[0][2] - 0.8 * n) <= 1
    assert sum(c[4] for c in out[0][1]) == out[0][3]


def test_weighted_fit_equals_rows_in_vocabulary_and_in_an_unsampled_tree(spark):
    """One tree without sampling has the same splits from weighted records as from the rows themselves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from forestlens.operators import model as mdl
    rows = noisy(spark)
    recs = rc.collapse(rows)
    by_rows, _, _ = mdl.fit_categorical_index(rows, ["l_linestatus", "attack_type"])
    by_weight, _, _ = mdl.fit_categorical_index(recs, ["l_linestatus", "attack_type"], weight=rc.WEIGHT)
    assert by_rows.labelsArray == [list(s.labels) for s in by_weight.stages]
    assert list(mdl.fit_label_index(recs, "attack_type", test=rows, weight=rc.WEIGHT).labels) == list(
        mdl.fit_label_index(rows, "attack_type", test=rows).labels)
    va = VectorAssembler(inputCols=["l_linestatus_index", "q", "l_discount"], outputCol="features")
    trees = []
    for df, w in ((rows, None), (recs, rc.WEIGHT)):
        x = va.transform(by_rows.transform(df))
        t = DecisionTreeClassifier(labelCol="attack_type_index", maxDepth=4, maxBins=64, **({"weightCol": w} if w else {}))
        trees.append(t.fit(x).toDebugString.split("\n", 1)[1])
    assert trees[0] == trees[1]


def test_collapsed_training_set(spark):
    """A training set that is mostly one record trains as one weighted row of it."""
    hot = spark.range(20_000).select(F.lit("tcp").alias("proto"), F.lit(1.0).alias("x"), F.lit("smurf").alias("attack_type"))
    rest = spark.range(200).select(F.when(F.col("id") % 2 == 0, "udp").otherwise("tcp").alias("proto"), (F.col("id") + 2.0).alias("x"), F.lit("normal").alias("attack_type"))
    r = xp.run_experiment(hot.union(rest), rest, xp.ExperimentConfig(5, 4, categorical=["proto"], features=["proto_vec", "x"], classes=["normal", "smurf"]))
    assert r.trained_records == 201 and r.predictions.filter("predicted_label = 'normal'").count() == 200


def test_weighted_counts(spark):
    pred = spark.createDataFrame([("a", "a", 5), ("a", "b", 2), ("a", "a", 1)], "actual string, predicted string, w long")
    dom = ev.ClassDomain.of(["a", "b"])
    assert {(r.actual, r.predicted): r.n for r in ev.confusion_matrix(pred, dom, weight="w").collect()} == {
        ("a", "a"): 6, ("a", "b"): 2, ("b", "a"): 0, ("b", "b"): 0}
    assert ev.metrics_table(pred, dom, weight="w").first()["recall"] == 0.75
    assert ev.confusion_counts(pred, weight="w").schema["n"].dataType == T.LongType()
    assert json.dumps(ev.evaluate(pred, dom, weight="w").overall.first().asDict())

import math

import pytest
from pyspark.sql import functions as F

from forestlens.operators import evaluate as ev
from forestlens.schema import ALL_CLASSES, BIN_CLASSES, TRAIN_CLASSES
from tests import goldens as g

CASES = [
    (g.RF_BASE, TRAIN_CLASSES, g.RF_BASE_METRICS),
    (g.RF_BASE_TEST, ALL_CLASSES, g.RF_BASE_TEST_METRICS),
    (g.RF_BIN_TEST, BIN_CLASSES, g.RF_BIN_TEST_METRICS),
    (g.RF_BIN200_TEST, BIN_CLASSES, g.RF_BIN200_TEST_METRICS),
]


def counts_df(spark, text):
    return spark.createDataFrame(g.parse_cells(text), "actual string, predicted string, n long")


@pytest.mark.parametrize("text,classes,expected", CASES)
def test_golden_metrics(spark, text, classes, expected):
    dom = ev.ClassDomain.of(classes)
    m = ev.dense_matrix(counts_df(spark, text), dom)
    row = ev.overall_metrics(ev.per_class_metrics(m)).first()
    for got, want in zip((row["precision"], row["recall"], row["f1"]), expected):
        assert got == pytest.approx(want, abs=1e-15)


@pytest.mark.parametrize("text,classes,expected", CASES)
def test_golden_matrix_dense_and_total(spark, text, classes, expected):
    dom = ev.ClassDomain.of(classes)
    m = ev.dense_matrix(counts_df(spark, text), dom)
    rows = m.collect()
    assert len(rows) == len(classes) ** 2
    assert sum(r["n"] for r in rows) == sum(n for _, _, n in g.parse_cells(text))
    assert {(r["actual_idx"], r["predicted_idx"]) for r in rows} == {(i, j) for i in range(len(classes))
                                                                     for j in range(len(classes))}


def test_rf_base_test_zero_support_and_never_predicted(spark):
    dom = ev.ClassDomain.of(ALL_CLASSES, TRAIN_CLASSES)
    pc = {r["class"]: r for r in ev.per_class_metrics(ev.dense_matrix(counts_df(spark, g.RF_BASE_TEST), dom)).collect()}
    # zero support: recall NaN; spy also never predicted -> precision 0, F1 NaN
    assert math.isnan(pc["spy"]["recall"]) and pc["spy"]["precision"] == 0.0 and math.isnan(pc["spy"]["f1"])
    assert math.isnan(pc["warezclient"]["recall"]) and pc["warezclient"]["precision"] == 0.0
    # a test-only class is never predicted: precision 0, recall 0 -> F1 NaN
    assert pc["mailbomb"]["precision"] == 0.0 and pc["mailbomb"]["recall"] == 0.0 and math.isnan(pc["mailbomb"]["f1"])
    never = [c for c, r in pc.items() if r["predicted_total"] == 0]
    assert len(never) == 27
    assert sum(r["support"] for c, r in pc.items() if c not in TRAIN_CLASSES) == g.UNSEEN_TEST_ROWS


def test_weighted_recall_equals_accuracy(spark):
    dom = ev.ClassDomain.of(ALL_CLASSES)
    cells = g.parse_cells(g.RF_BASE_TEST)
    acc = sum(n for a, p, n in cells if a == p) / sum(n for _, _, n in cells)
    row = ev.overall_metrics(ev.per_class_metrics(ev.dense_matrix(counts_df(spark, g.RF_BASE_TEST), dom))).first()
    assert row["recall"] == pytest.approx(acc, abs=1e-15)


def test_f1_differs_from_mean_of_per_class_f1(spark):
    dom = ev.ClassDomain.of(ALL_CLASSES)
    pc = ev.per_class_metrics(ev.dense_matrix(counts_df(spark, g.RF_BASE_TEST), dom))
    spark_style = pc.agg(F.sum(F.when(~F.isnan("f1"), F.col("f1") * F.col("class_ratio"))).alias("x")).first()["x"]
    assert spark_style == pytest.approx(0.88643, abs=1e-5)
    assert g.RF_BASE_TEST_METRICS[2] != pytest.approx(spark_style, abs=1e-4)


def test_empty_predictions_give_null_metrics(spark):
    dom = ev.ClassDomain.of(["a", "b"])
    empty = spark.createDataFrame([], "actual string, predicted string")
    row = ev.overall_metrics(ev.per_class_metrics(ev.confusion_matrix(empty, dom))).first()
    assert row["precision"] is None and row["recall"] is None and row["f1"] is None


def test_unknown_label_raises_and_strays_are_returned(spark):
    dom = ev.ClassDomain.of(["a", "b"])
    pred = spark.createDataFrame([("a", "a"), ("c", "a"), (None, "b")], "actual string, predicted string")
    with pytest.raises(Exception, match="outside the class domain"):
        ev.confusion_matrix(pred, dom).collect()
    strays = ev.stray_labels(ev.confusion_counts(pred), dom).collect()
    assert sorted((r["actual"] or "", r["predicted"]) for r in strays) == [("", "b"), ("c", "a")]


def test_metrics_by_split_in_one_job(spark):
    dom = ev.ClassDomain.of(["a", "b"])
    rows = [(0, "a", "a"), (0, "b", "a"), (1, "a", "a"), (1, "b", "b")]
    pred = spark.createDataFrame(rows, "s int, actual string, predicted string")
    out = {r["split"]: r for r in ev.metrics_table(pred, dom, split="s").collect()}
    assert out[1]["precision"] == 1.0 and out[1]["recall"] == 1.0
    assert out[0]["recall"] == 0.5 and out[0]["precision"] == pytest.approx(0.25)


def test_domain_guards(spark):
    with pytest.raises(ValueError):
        ev.ClassDomain.of([])
    with pytest.raises(ValueError):
        ev.ClassDomain.of(["a", "a"])
    # no limit on the number of classes
    dom = ev.ClassDomain.of([f"c{i}" for i in range(5000)])
    pred = spark.createDataFrame([("c1", "c1"), ("c1", "c4999"), ("c2", "c2")], "actual string, predicted string")
    m = ev.confusion_matrix(pred, dom).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n")).first()
    assert (m["cells"], m["n"]) == (25_000_000, 3)
    inside, strays = ev.split_strays(ev.confusion_counts(pred), ev.ClassDomain.of(["c1", "c2"]))
    assert inside.count() == 2 and [(r["actual"], r["predicted"], r["n"]) for r in strays.collect()] == [("c1", "c4999", 1)]


def test_null_split_key_keeps_its_counts(spark):
    dom = ev.ClassDomain.of(["a", "b"])
    rows = [(None, "a", "a"), (None, "a", "b"), (1, "b", "b")]
    pred = spark.createDataFrame(rows, "s int, actual string, predicted string")
    m = ev.confusion_matrix(pred, dom, keys="s").collect()
    assert len(m) == 8 and sum(r["n"] for r in m) == 3
    assert {(r["s"], r["actual"], r["predicted"]): r["n"] for r in m}[(None, "a", "b")] == 1


def test_domain_frame(spark):
    dom = ev.ClassDomain.of(["x", "y", "z"], train_classes=["x", "z"])
    rows = [(r["class_idx"], r["class"], r["in_train"]) for r in dom.to_df(spark).orderBy("class_idx").collect()]
    assert rows == [(0, "x", True), (1, "y", False), (2, "z", True)]

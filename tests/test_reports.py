from forestlens.operators import evaluate as ev, reports
from forestlens.schema import ALL_CLASSES, TRAIN_CLASSES
from tests import goldens as g


def test_category_rollup_golden(spark):
    per_class = spark.createDataFrame(g.CLASS_COUNTS, "attack_type string, count long, dedup_count long")
    out = {r["category"]: (r["count"], r["dedup_count"])
           for r in reports.rollup_class_counts(per_class, "attack_type").collect()}
    assert out == g.CATEGORY_COUNTS


def test_class_distribution_counts_and_dedup(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 5), ("c", 1), ("c", 1), ("c", 1)]
    df = spark.createDataFrame(rows, "label string, x int")
    out = [(r["label"], r["count"], r["dedup_count"]) for r in reports.class_distribution(df, "label").collect()]
    assert out == [("a", 3, 2), ("c", 3, 1), ("b", 1, 1)]


def test_unknown_category(spark):
    df = spark.createDataFrame([("smurf", 1), ("mailbomb", 2)], "attack_type string, x int")
    out = {r["category"]: r["count"] for r in reports.category_rollup(df, "attack_type").collect()}
    assert out == {"dos": 1, "unknown": 1, "TOTAL": 2}


def test_unseen_class_rows_golden(spark):
    cells = g.parse_cells(g.RF_BASE_TEST)
    test = spark.createDataFrame([(a, n) for a, _, n in cells], "attack_type string, n long")
    train = spark.createDataFrame([(c,) for c in TRAIN_CLASSES], "attack_type string")
    r = reports.unseen_class_rows(train, test, "attack_type", weight="n").first()
    assert (r["unseen_rows"], r["total_rows"]) == (g.UNSEEN_TEST_ROWS, g.TEST_ROWS)


def _attr_frame(spark):
    rows = ([("mailbomb", "normal")] * 25 + [("smurf", "anomaly")] * 120 + [("smurf", "normal")] * 3
            + [("back", "normal")] * 5 + [("normal", "normal")] * 50 + [("normal", "anomaly")] * 30)
    pred = spark.createDataFrame(rows, "attack_type string, predicted string")
    train = spark.createDataFrame([("smurf",), ("back",), ("normal",)], "attack_type string")
    return reports.label_attribution(pred, "attack_type", "predicted", train=train)


def test_attribution_reports(spark):
    attr = _attr_frame(spark)
    fn = [(r["attack_type"], r["labeled_normal"], r["labeled_anomaly"], r["in_train"])
          for r in reports.false_normal_attribution(attr, 20).collect()]
    assert fn == [("mailbomb", 25, 0, False)]
    ca = [(r["attack_type"], r["labeled_anomaly"]) for r in reports.correct_anomaly_attribution(attr, 100).collect()]
    assert ca == [("smurf", 120)]
    tail = reports.excluded_tail(attr, 20).first()
    assert (tail["labels"], tail["instances"]) == (2, 8)


def test_heatmap_cells(spark):
    dom = ev.ClassDomain.of(ALL_CLASSES, TRAIN_CLASSES)
    counts = spark.createDataFrame([("back", "back", 1091), ("back", "normal", 7), ("mailbomb", "normal", 5000),
                                    ("normal", "pod", 500)], "actual string, predicted string, n long")
    cells = {(r["actual"], r["predicted"]): r for r in
             reports.heatmap_cells(ev.dense_matrix(counts, dom), dom).collect()}
    assert len(cells) == 1600
    assert cells[("back", "back")]["opacity"] == 1.0
    assert cells[("back", "normal")]["opacity"] == 0.05
    assert cells[("normal", "pod")]["opacity"] == 0.5
    assert cells[("back", "pod")]["opacity"] == 0.0
    m = cells[("mailbomb", "normal")]
    assert (m["x"], m["y"], m["actual_in_train"], m["predicted_in_train"]) == (22, 25, False, True)


def test_category_map_with_names_needing_escapes(spark):
    from forestlens.functions import category_of
    cmap = {"odd": ["it's", "back\\slash"], "plain": ["x"]}
    df = spark.createDataFrame([("it's",), ("back\\slash",), ("x",), ("y",), (None,)], "c string")
    got = [r[0] for r in df.select(category_of("c", cmap)).collect()]
    assert got == ["odd", "odd", "plain", "unknown", "unknown"]

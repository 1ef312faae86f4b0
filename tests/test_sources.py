import pytest

from forestlens.operators import evaluate as ev
from forestlens.schema import ALL_CLASSES, BIN_CLASSES, TRAIN_CLASSES, connection_feature_order, connection_schema
from forestlens.sources import csv as src, sinks
from tests import goldens as g

ROW = ("0,tcp,http,SF,181,5450,0,0,0,0,0,1,0,0,0,0,0,0,0,0,0,0,8,8,0.00,0.00,0.00,0.00,1.00,0.00,0.00,9,9,1.00,"
       "0.00,0.11,0.00,0.00,0.00,0.00,0.00,normal.")


def test_connection_schema_and_features():
    s = connection_schema()
    assert len(s.fields) == 42 and s.fields[-1].name == "attack_type"
    f = connection_feature_order()
    assert len(f) == 40 and "dst_host_srv_rerror_rate" not in f and f[1] == "protocol_type_vec"


def test_typed_csv_modes(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(ROW + "\n")
    df = src.read_connections(spark, str(good))
    r = df.first()
    assert r["duration"] == 0 and r["service"] == "http" and r["attack_type"] == "normal."
    bad = tmp_path / "bad.csv"
    bad.write_text(ROW.replace("181", "x1") + "\n")
    assert src.read_connections(spark, str(bad)).first()["src_bytes"] is None
    with pytest.raises(Exception):
        src.read_connections(spark, str(bad), mode="FAILFAST").collect()
    with pytest.raises(Exception, match="NULL"):
        src.require_not_null(src.read_connections(spark, str(bad))).collect()


def test_matrix_reader_both_layouts(spark, tmp_path):
    new = tmp_path / "new.csv"
    new.write_text("A\\P,anomaly,normal\nanomaly,227474.0,22962.0\nnormal,281.0,60310.0\n")
    old = tmp_path / "old.csv"
    old.write_text(",anomaly,normal\n0,227474.0,22962.0\n1,281.0,60310.0\n")
    for p in (new, old):
        cells = {(r["actual"], r["predicted"]): (r["actual_idx"], r["predicted_idx"], r["n"])
                 for r in src.read_matrix_csv(spark, str(p)).collect()}
        assert cells[("anomaly", "normal")] == (0, 1, 22962)
        assert cells[("normal", "anomaly")] == (1, 0, 281)


def test_matrix_and_metrics_writers_round_trip(spark, tmp_path):
    dom = ev.ClassDomain.of(BIN_CLASSES)
    counts = spark.createDataFrame([("anomaly", "anomaly", 5), ("normal", "anomaly", 2), ("normal", "normal", 3)],
                                   "actual string, predicted string, n long")
    m = ev.dense_matrix(counts, dom)
    path = sinks.write_confusion_matrix(m, dom, str(tmp_path / "matrix"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "matrix").glob("part-*.csv")))
    assert text.splitlines() == ["A\\P,anomaly,normal", "anomaly,5.0,0.0", "normal,2.0,3.0"]
    back = {(r["actual"], r["predicted"]): r["n"] for r in src.read_matrix_csv(spark, path).collect()}
    assert back == {("anomaly", "anomaly"): 5, ("anomaly", "normal"): 0, ("normal", "anomaly"): 2,
                    ("normal", "normal"): 3}
    om = ev.overall_metrics(ev.per_class_metrics(m)).selectExpr("0 AS split", "*")
    sinks.write_metrics(om, str(tmp_path / "metrics"))
    lines = "".join(p.read_text() for p in (tmp_path / "metrics").glob("part-*.csv")).splitlines()
    assert lines[0] == "Split #,Precision,Recall,F1" and lines[1].startswith("0,")


def test_pairs_and_triplets(spark, tmp_path):
    df = spark.createDataFrame([("smurf", "anomaly", "anomaly")], "attack_type string, attack_type_bin string, "
                                                                   "predicted_label string")
    sinks.write_triplets(df, str(tmp_path / "t"))
    sinks.write_pairs(df, str(tmp_path / "p"))
    t = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*.csv"))
    pr = "".join(p.read_text() for p in (tmp_path / "p").glob("part-*.csv"))
    assert t.strip() == "smurf,anomaly,anomaly" and pr.strip() == "smurf,anomaly"


@pytest.mark.parametrize("text,classes,metrics", [(g.RF_BASE, TRAIN_CLASSES, g.RF_BASE_METRICS), (g.RF_BASE_TEST, ALL_CLASSES, g.RF_BASE_TEST_METRICS)])
@pytest.mark.parametrize("numbered", [True, False])
def test_saved_matrices_of_the_study_in_both_layouts(spark, tmp_path, text, classes, metrics, numbered):
    """The 23- and 40-class matrices as saved files: read back, their metrics are the published ones."""
    (tmp_path / "matrix.csv").write_text(g.saved_layout(text, list(classes), numbered))
    m = src.read_matrix_csv(spark, str(tmp_path / "matrix.csv"))
    rows = m.collect()
    assert len(rows) == len(classes) ** 2 and {(r["actual"], r["predicted"], r["n"]) for r in rows if r["n"]} == set(g.parse_cells(text))
    assert all(classes[r["actual_idx"]] == r["actual"] and classes[r["predicted_idx"]] == r["predicted"] for r in rows)
    got = ev.overall_metrics(ev.per_class_metrics(m)).first()
    assert [got["precision"], got["recall"], got["f1"]] == pytest.approx(list(metrics), abs=1e-12)

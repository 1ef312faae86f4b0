"""Forest jobs on the separable lineitem fixture: seen classes are predicted
exactly, the test-only class lands on the class it was carved out of."""
import pytest
from pyspark.sql import functions as F

from forestlens.operators import clean, model as mdl
from forestlens.plans import experiments as xp, fixtures as fx
from forestlens.sources import sinks
from tests.conftest import SF_SMALL

COMMON = dict(categorical=fx.FOREST_CATEGORICAL, features=fx.FOREST_FEATURES)


@pytest.fixture(scope="module")
def frames(spark):
    return fx.forest_frames(fx.table(spark, SF_SMALL, "lineitem"))


@pytest.fixture(scope="module")
def x2(frames):
    train, test = frames
    return xp.x2_unseen_classes(train, test, 10, 8, classes=fx.FOREST_DOMAIN.classes,
                                train_classes=fx.FOREST_DOMAIN.train_classes, **COMMON)


def test_x2_predictions_follow_rule(x2):
    wrong = x2.predictions.filter(
        F.col("predicted_label") != F.when(F.col("attack_type") == "novel", "smurf").otherwise(F.col("attack_type")))
    assert wrong.count() == 0
    assert "novel" in x2.labels and len(x2.labels) == 4


def test_x2_matrix_and_outputs(spark, x2, tmp_path):
    e = x2.evaluation(checkpoint=True)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in e.matrix.collect()}
    assert cells[("novel", "normal")] == 0 and cells[("novel", "smurf")] > 0
    paths = xp.write_outputs(x2, str(tmp_path / "out"), pairs=True, save_model=True)
    assert set(paths) == {"metrics", "matrix", "pairs", "model"}
    loaded = sinks.load_model(str(tmp_path / "out"))
    a = mdl.score(loaded, x2.test).select("predicted_label").groupBy("predicted_label").count()
    b = x2.predictions.select("predicted_label").groupBy("predicted_label").count()
    assert sorted(a.collect()) == sorted(b.collect())


def test_x3_binary_triplets(frames):
    train, test = frames
    r = xp.x3_binary(train, test, 10, 8, **COMMON)
    trip = r.triplets().groupBy("attack_type_bin", "predicted_label").count().collect()
    assert all(row["attack_type_bin"] == row["predicted_label"] for row in trip)
    assert sorted(r.labels) == ["anomaly", "normal"]


def test_x4_vocabulary_mixes_binary_and_multiclass(frames):
    train, test = frames
    r = xp.x4_binary_on_multiclass(clean.binarize_dataset(train), test, 10, 8, **COMMON)
    assert set(r.labels) == {"anomaly", "normal", "neptune", "smurf", "novel"}
    got = set(r.pairs().select("predicted_label").distinct().toPandas()["predicted_label"])
    assert got <= {"anomaly", "normal"}


def test_x1_split_invariants(spark):
    data = fx.forest_all_seen(fx.table(spark, SF_SMALL, "lineitem"))
    r = xp.x1_multiclass_split(data, 10, 8, classes=["normal", "neptune", "smurf"], **COMMON)
    try:
        n_train, n_test, total = r.train.count(), r.test.count(), data.count()
        assert n_train + n_test == total
        m = r.evaluation(checkpoint=False).overall.first()
        assert m["precision"] == 1.0 and m["recall"] == 1.0
    finally:
        r.release()


def test_x4_attribution_reports(spark, frames):
    train, test = frames
    r = xp.x4_binary_on_multiclass(clean.binarize_dataset(train), test, 10, 8, **COMMON)
    rep = xp.attribution_reports(r, min_errors=20, min_correct=100)
    assert rep["false_normal"].count() == 0
    counts = {x["attack_type"]: x["n"] for x in test.groupBy("attack_type").count().withColumnRenamed(
        "count", "n").collect()}
    got = {x["attack_type"]: (x["labeled_anomaly"], x["labeled_normal"], x["in_train"])
           for x in rep["correct_anomaly"].collect()}
    want = {c: (n, 0, c != "novel") for c, n in counts.items() if c != "normal" and n >= 100}
    assert got == want
    tail = rep["excluded_tail"].first()
    assert (tail["labels"], tail["instances"]) == (0, 0)


def test_deep_trees_use_node_id_cache_and_checkpoints(spark, frames):
    """Node-id caching with checkpoints in the session's checkpoint folder (the study's
    jobs use depth 20)."""
    train, test = frames
    r = xp.x2_unseen_classes(train, test, 5, 16, cache_node_ids=True, classes=fx.FOREST_DOMAIN.classes,
                             train_classes=fx.FOREST_DOMAIN.train_classes, **COMMON)
    clf = r.model.stages[-2]
    assert clf.getOrDefault("cacheNodeIds") and clf.getOrDefault("checkpointInterval") == 10
    wrong = r.predictions.filter(
        F.col("predicted_label") != F.when(F.col("attack_type") == "novel", "smurf").otherwise(F.col("attack_type")))
    assert wrong.count() == 0


def test_constant_columns_need_one_indexing_pass(spark):
    from forestlens.operators import model as mdl
    df = spark.createDataFrame([("a", "k", "x"), ("b", "k", "y"), ("a", "k", "z")], "c1 string, same string, c2 string")
    m, keep, dropped = mdl.fit_categorical_index(df, ["c1", "same", "c2"])
    assert (keep, dropped) == (["c1", "c2"], ["same"])
    assert [list(s.labels) for s in m.stages] == [["a", "b"], ["x", "y", "z"]]


def test_fixed_partitions_make_the_forest_independent_of_files(spark):
    """Noisy labels: the same job gives the same predictions whatever the input's partitions."""
    li = fx.table(spark, SF_SMALL, "lineitem").select("l_linestatus", "l_quantity", "l_discount", "l_tax",
                                                      F.col("l_returnflag").alias("attack_type"))
    def run(parts):
        r = xp.run_experiment(li.repartition(parts), li, xp.ExperimentConfig(
            10, 8, categorical=["l_linestatus"], features=["l_linestatus_vec", "l_quantity", "l_discount", "l_tax"],
            train_partitions=4))
        return sorted((x[0], x[1], x[2]) for x in r.predictions.groupBy("attack_type", "predicted_label").count().collect())
    assert run(2) == run(7)

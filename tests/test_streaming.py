from forestlens.operators import evaluate as ev
from forestlens.plans import fixtures as fx
from forestlens.streaming import scoring
from tests.conftest import SF_SMALL


def test_running_counts_equal_batch_counts(spark, tmp_path):
    batch = fx.table(spark, SF_SMALL, "lineitem")
    stream = scoring.read_record_stream(spark, f"{SF_SMALL}/lineitem.parquet", batch.schema)
    q = scoring.start_running_matrix_table(fx.rule_predictions(stream), "actual", "predicted", str(tmp_path / "cm"))
    try:
        q.processAllAvailable()
        snap = scoring.read_running_matrix(spark, str(tmp_path / "cm"))
        got = sorted((r["actual"], r["predicted"], r["n"]) for r in snap.collect())
    finally:
        q.stop()
    want = sorted((r["actual"], r["predicted"], r["n"])
                  for r in ev.confusion_counts(fx.rule_predictions(batch)).collect())
    assert got == want
    views = scoring.matrix_from_counts(snap, fx.RULE_DOMAIN)
    assert views["matrix"].count() == len(fx.RULE_DOMAIN) ** 2


def test_running_counts_published_to_a_table(spark, tmp_path):
    """A folder of several files, over several triggers."""
    batch = fx.table(spark, SF_SMALL, "lineitem")
    batch.repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    stream = scoring.read_record_stream(spark, str(tmp_path / "lineitem.parquet"), batch.schema, max_files_per_trigger=1)
    out = str(tmp_path / "counts")
    q = scoring.start_running_matrix_table(fx.rule_predictions(stream), "actual", "predicted", out,
                                           checkpoint_location=str(tmp_path / "ckpt"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["actual"], r["predicted"], r["n"]) for r in scoring.read_running_matrix(spark, out).collect())
    assert spark.read.parquet(out).select("batch").distinct().count() == 5
    want = sorted((r["actual"], r["predicted"], r["n"])
                  for r in ev.confusion_counts(fx.rule_predictions(batch)).collect())
    assert got == want


def test_scoring_a_stream_with_a_fitted_pipeline(spark, tmp_path):
    from forestlens.plans import experiments as xp
    li = fx.table(spark, SF_SMALL, "lineitem")
    train, test = fx.forest_frames(li)
    r = xp.x2_unseen_classes(train, test, 3, 4, classes=fx.FOREST_DOMAIN.classes,
                             train_classes=fx.FOREST_DOMAIN.train_classes,
                             categorical=fx.FOREST_CATEGORICAL, features=fx.FOREST_FEATURES)
    stream = scoring.read_record_stream(spark, f"{SF_SMALL}/lineitem.parquet", li.schema)
    _, test_stream = fx.forest_frames(stream)
    out = str(tmp_path / "scored")
    q = scoring.start_running_matrix_table(scoring.score_stream(r.model, test_stream), "attack_type", "predicted_label", out)
    try:
        q.processAllAvailable()
        got = sorted((x["actual"], x["predicted"], x["n"]) for x in scoring.read_running_matrix(spark, out).collect())
    finally:
        q.stop()
    want = sorted((x["actual"], x["predicted"], x["n"])
                  for x in ev.confusion_counts(r.predictions, "attack_type", "predicted_label").collect())
    assert got == want and sum(n for _, _, n in got) == test.count()


def test_counts_from_the_state_store(spark, tmp_path):
    """Counts after several batches and a restart, read from the checkpoint alone; an empty folder has none."""
    batch = fx.table(spark, SF_SMALL, "lineitem")
    src, state = str(tmp_path / "lineitem.parquet"), str(tmp_path / "state")
    assert scoring.read_state_counts(spark, state).count() == 0 and scoring.read_running_matrix(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty").mkdir()
    empty = scoring.read_record_stream(spark, str(tmp_path / "empty"), batch.schema)
    q = scoring.start_running_matrix(fx.rule_predictions(empty), "actual", "predicted", str(tmp_path / "none-state"), trigger={"availableNow": True})
    q.awaitTermination()
    assert scoring.read_state_counts(spark, str(tmp_path / "none-state")).count() == 0
    for part in range(3):
        batch.filter(f"l_orderkey % 3 = {part}").repartition(2).write.mode("append").parquet(src)
        stream = scoring.read_record_stream(spark, src, batch.schema, max_files_per_trigger=1)
        q = scoring.start_running_matrix(fx.rule_predictions(stream), "actual", "predicted", state, trigger={"availableNow": True})
        q.awaitTermination()
        seen = batch.filter(f"l_orderkey % 3 <= {part}")
        want = sorted(map(tuple, ev.confusion_counts(fx.rule_predictions(seen)).collect()))
        assert sorted(map(tuple, scoring.read_state_counts(spark, state).collect())) == want

"""Incremental de-duplication against a set, and outputs that are committed whole."""

import random

import pytest
from pyspark.sql import functions as F

from forestlens.operators import incremental as inc, records as rc
from forestlens.plans import experiments as xp, fixtures as fx
from forestlens.sources import sinks
from tests.conftest import SF_SMALL


def batch(spark, seed, n=600):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 150), rng.choice([None, 0.5, float("nan")])) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, v int, x double"), {tuple(map(str, r)) for r in rows}


@pytest.mark.parametrize("rows_per_filter,broadcast", [(64, 1 << 20), (4096, 0)])
def test_batches_equal_a_set(spark, tmp_path, rows_per_filter, broadcast, monkeypatch):
    monkeypatch.setattr(inc, "BROADCAST_DIGESTS", broadcast)
    kept, seen = inc.CleanedSet(spark, str(tmp_path / "set"), rows_per_filter), set()
    assert kept.records() is None
    for seed in (1, 2, 1, 3):
        df, rows = batch(spark, seed)
        got = [tuple(map(str, r)) for r in kept.add(df).collect()]
        assert len(got) == len(set(got)) and set(got) == rows - seen
        seen |= rows
    assert kept.add(df.limit(0)).count() == 0
    stored = [tuple(map(str, r)) for r in kept.records().collect()]
    assert len(stored) == len(seen) and set(stored) == seen


def test_filters_have_no_false_misses_and_few_hits(spark):
    digests = spark.range(20_000).select(F.xxhash64("id").alias("record_digest"))
    filters = inc.bloom_filters(digests, 5)
    assert filters.count() == 5
    assert inc.maybe_stored(digests, filters, 5).filter("NOT hit").count() == 0
    others = spark.range(20_000, 40_000).select(F.xxhash64("id").alias("record_digest"))
    assert inc.maybe_stored(others, filters, 5).filter("hit").count() < 0.06 * 20_000
    assert inc.maybe_stored(others, filters.limit(0), 5).filter("hit").count() == 0


def test_the_stored_set_is_not_shuffled(spark, tmp_path):
    df, _ = batch(spark, 5)
    kept = inc.CleanedSet(spark, str(tmp_path / "set"))
    kept.add(df)
    stored = spark.read.parquet(*kept._manifest()["folders"])
    digests = df.limit(5).select(rc.digest(df).alias("record_digest"))
    plan = stored.join(F.broadcast(digests), "record_digest", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_failed_batch_leaves_the_set(spark, tmp_path, monkeypatch):
    kept = inc.CleanedSet(spark, str(tmp_path / "set"))
    kept.add(batch(spark, 1)[0])
    before = sorted(map(str, kept.records().collect()))
    monkeypatch.setattr(inc, "write_json", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        kept.add(batch(spark, 2)[0])
    assert sorted(map(str, kept.records().collect())) == before


def test_a_failed_run_leaves_the_last_one_whole(spark, tmp_path, monkeypatch):
    train, test = fx.forest_frames(fx.table(spark, SF_SMALL, "lineitem"))
    r = xp.x2_unseen_classes(train, test, 3, 3, classes=fx.FOREST_DOMAIN.classes, train_classes=fx.FOREST_DOMAIN.train_classes,
                             categorical=fx.FOREST_CATEGORICAL, features=fx.FOREST_FEATURES)
    out = str(tmp_path / "out")
    first = xp.commit_outputs(r, out)
    assert xp.current_outputs(spark, out) == first
    saved = spark.read.option("header", True).csv(first["matrix"]).collect()
    monkeypatch.setattr(sinks, "write_confusion_matrix", lambda *a, **k: (_ for _ in ()).throw(OSError("after metrics")))
    with pytest.raises(OSError):
        xp.commit_outputs(r, out)
    assert xp.current_outputs(spark, out) == first
    assert spark.read.option("header", True).csv(first["matrix"]).collect() == saved
    assert spark.read.option("header", True).csv(first["metrics"]).count() == 1
    monkeypatch.undo()
    assert xp.commit_outputs(r, out, matrix=True) == xp.current_outputs(spark, out) != first

"""Forest sizes, distributed ranks, domain tables and counted rejects."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from forestlens.operators import clean, evaluate as ev, features as fe, forest_sizes, model as mdl, ranking, records as rc
from forestlens.plans import cli, experiments as xp
from forestlens.schema import connection_schema
from forestlens.sources import csv as src
from tests.conftest import SF_SMALL


# --- forest sizes --------------------------------------------------------------

@pytest.fixture(scope="module")
def noisy(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        "l_linestatus", "l_quantity", "l_discount", "l_tax", F.col("l_returnflag").alias("attack_type"))
    r = xp.run_experiment(li, li.limit(800), xp.ExperimentConfig(
        9, 5, categorical=["l_linestatus"], features=["l_linestatus_vec", "l_quantity", "l_discount", "l_tax"], classes=["A", "N", "R"]))
    return r


def test_sizes_equal_forests_cut_by_hand(spark, noisy):
    sizes = [1, 2, 4, 9]
    rows = noisy.test.withColumn("id", F.monotonically_increasing_id()).persist()
    got = {(r["id"], r["size"]): r["predicted_label"] for r in forest_sizes.score_by_size(noisy.model, rows, sizes, ["id"]).collect()}
    before, forest, labels = forest_sizes._parts(noisy.model)
    points = before.transform(rows).select("id", vector_to_array("features").alias("x")).collect()
    from pyspark.ml.linalg import Vectors
    assert len(got) == len(points) * len(sizes)
    probabilities = [[t.predictProbability(Vectors.dense(p["x"])).toArray() for p in points[:150]] for t in forest.trees]
    for k, p in enumerate(points[:150]):
        votes = np.zeros(forest.numClasses)
        for i in range(9):
            votes = votes + probabilities[i][k]
            if i + 1 in sizes:
                assert got[(p["id"], i + 1)] == labels[int(np.argmax(votes))]
    whole = {r["id"]: r["predicted_label"] for r in noisy.model.transform(rows).select("id", "predicted_label").collect()}
    assert whole == {i: v for (i, s), v in got.items() if s == 9}
    rows.unpersist()


def test_sizes_read_the_test_set_once(spark, noisy):
    scored = forest_sizes.score_by_size(noisy.model, noisy.test, [3, 9], ["attack_type"])
    metrics = ev.metrics_table(scored, noisy.domain(), "attack_type", "predicted_label", split="size")
    plan = metrics._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and {r["split"] for r in metrics.collect()} == {3, 9}
    for bad in ([], [0], [10]):
        with pytest.raises(ValueError):
            forest_sizes.score_by_size(noisy.model, noisy.test, bad, ["attack_type"])


# --- ranks -------------------------------------------------------------------------

def test_ranks_equal_the_string_indexer(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice(["b", "a", "É", "zz", None] + [f"v{i}" for i in range(60)]),) for _ in range(900)], "c string")
    for parts in (1, 6):
        got = {r["value"]: r["index"] for r in ranking.frequency_index(df.repartition(parts), "c").collect()}
        labels = fe.index_stage(["c"], "skip").fit(df).labelsArray[0]
        assert got == {v: i for i, v in enumerate(labels)}
    counts = rc.collapse(df)
    assert {r["value"]: r["index"] for r in ranking.frequency_index(counts, "c", weight=rc.WEIGHT).collect()} == got
    both = {r["value"]: r["index"] for r in ranking.frequency_index(df.limit(300), "c", also=df).collect()}
    assert both == {v: i for i, v in enumerate(mdl.fit_label_index(df.limit(300).na.drop(), "c", test=df.na.drop()).labels)}


def test_a_million_values_without_a_collect(spark):
    n = 1_000_000
    keys = spark.range(n).select(((F.col("id") * 7919) % n).alias("k")).union(spark.range(3000).select((F.col("id") % 1000).alias("k")))
    vocabulary = ranking.frequency_index(keys, "k")
    stats = vocabulary.agg(F.count("*").alias("n"), F.countDistinct("index").alias("d"), F.min("index").alias("lo"), F.max("index").alias("hi")).first()
    assert tuple(stats) == (n, n, 0, n - 1)
    head = vocabulary.filter("index < 1000").agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(head) == (4, 4, 1000)
    out = ranking.index_by_join(keys, "k", vocabulary)
    assert tuple(out.agg(F.count("*"), F.countDistinct("k_index")).first()) == (n + 3000, n)


def test_index_by_join_of_invalid_values(spark):
    vocabulary = ranking.frequency_index(spark.createDataFrame([("a",), ("a",), ("b",)], "c string"), "c")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3), (None, 4)], "c string, i int")
    assert {r["i"]: r["c_index"] for r in ranking.index_by_join(df, "c", vocabulary, handle_invalid="keep").collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 2.0}
    assert {r["i"]: r["c_index"] for r in ranking.index_by_join(df, "c", vocabulary, handle_invalid="skip").collect()} == {1: 0.0, 2: 1.0}
    for bad in ("i = 3", "i = 4"):
        with pytest.raises(Exception, match="no index for c"):
            ranking.index_by_join(df.filter(bad), "c", vocabulary).collect()
    empty = ranking.frequency_index(df.limit(0), "c")
    assert empty.count() == 0 and ranking.index_by_join(df, "c", empty, handle_invalid="keep").filter("c_index = 0").count() == 4


# --- the domain as a table ------------------------------------------------------------

def test_domain_table_equals_literals(spark):
    rng = random.Random(3)
    dom = ev.ClassDomain.of(["a", "b", "c", "never"], ["a", "b"])
    pred = spark.createDataFrame([(rng.choice("abc"), rng.choice("abc")) for _ in range(200)], "actual string, predicted string")
    table, counts = dom.to_df(spark), ev.confusion_counts(pred)
    dense = ev.dense_matrix(counts, dom)
    cells = ev.indexed_counts(counts, table)
    assert sorted(map(tuple, cells.collect())) == sorted(tuple(r) for r in dense.collect() if r["n"])
    a, b = (sorted(map(str, ev.per_class_metrics(m).collect())) for m in (dense, ev.with_every_class(cells, table)))
    assert a == b
    stray = spark.createDataFrame([("a", "q"), ("q", "a"), (None, "a"), ("a", None), ("b", "b")], "actual string, predicted string")
    counts = ev.confusion_counts(stray)
    assert Counter(map(tuple, ev.table_strays(counts, table).collect())) == Counter(map(tuple, ev.stray_labels(counts, dom).collect()))
    assert ev.indexed_counts(counts, table, strict=False).count() == 1
    with pytest.raises(Exception, match="outside the class domain"):
        ev.indexed_counts(counts, table).collect()


def test_plan_size_does_not_follow_the_domain(spark):
    def plan(k):
        domain = spark.range(k).select(F.col("id").cast("int").alias("class_idx"), F.col("id").cast("string").alias("class"), F.lit(True).alias("in_train"))
        pred = spark.range(k * 2).select((F.col("id") % k).cast("string").alias("actual"), (F.col("id") * 3 % k).cast("string").alias("predicted"))
        cells = ev.indexed_counts(ev.confusion_counts(pred), domain)
        return ev.per_class_metrics(ev.with_every_class(cells, domain))
    size = [len(plan(k)._jdf.queryExecution().optimizedPlan().toString()) for k in (10, 200_000)]
    assert abs(size[1] - size[0]) < 200
    assert plan(200_000).agg(F.count("*"), F.sum("support")).first() == (200_000, 400_000)


# --- counted rejects -----------------------------------------------------------------

def lines():
    fields = [f.name for f in connection_schema().fields]
    good = ["0"] * len(fields)
    good[1:4], good[-1] = ["tcp", "http", "SF"], "normal."

    def line(**kw):
        return ",".join(kw.get(n, v) for n, v in zip(fields, good))
    return [line(), line(attack_type="smurf."), line(service="icmp"), line(src_bytes="many"), line(dst_bytes=""), line(dst_bytes="", flag=""),
            line() + ",surplus", ",".join(good[:10]), line()]


def test_every_line_is_kept_and_counted(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    text = lines()
    (tmp_path / "raw/a.csv").write_text("\n".join(text[:4]) + "\n")
    (tmp_path / "raw/b.csv").write_text("\n".join(text[4:]) + "\n")
    seen = src.stage_records(spark, str(tmp_path / "raw"), str(tmp_path / "out"), illegal={"illegal service": clean.illegal_service_rule()},
                             clean=clean.strip_label_suffix)
    assert seen == {"lines": 9, "kept": 3, "malformed": 3, "null": 2, "illegal service": 1}
    kept = src.staged_records(spark, str(tmp_path / "out"))
    assert Counter(r["attack_type"] for r in kept.collect()) == {"normal": 2, "smurf": 1} and kept.columns == [f.name for f in connection_schema().fields]
    bad = src.staged_rejects(spark, str(tmp_path / "out")).collect()
    got = Counter((r[src.REASON], r[src.FILE].rsplit("/", 1)[1]) for r in bad)
    assert got == {("malformed", "a.csv"): 1, ("illegal service", "a.csv"): 1, ("null: dst_bytes", "b.csv"): 1, ("null: flag,dst_bytes", "b.csv"): 1,
                   ("malformed", "b.csv"): 2}
    assert {r[src.LINE] for r in bad if r[src.REASON] == "malformed"} == {text[3], text[6], text[7]}
    assert src.stage_records(spark, str(tmp_path / "raw/a.csv"), str(tmp_path / "none"), illegal={"any": F.lit(True)})["kept"] == 0
    assert src.staged_records(spark, str(tmp_path / "none")).count() == 0


def test_job_with_bad_lines(spark, tmp_path):
    """``--keep-rejects``: the job runs on the good lines and the bad ones are set aside; without it, it fails."""
    good = lines()[0]
    bad = good.replace("normal.", "smurf.").replace(",0", ",9")      # every number differs
    text = [x.replace("0,", f"{i},", 1) for x in (good, bad) for i in range(30)] + lines()[3:5]
    for name in ("train", "test"):
        (tmp_path / f"{name}.csv").write_text("\n".join(text) + "\n")
    args = ["x2", str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), str(tmp_path / "out"), "31", "3"]
    with pytest.raises(Exception, match="NULL in a non-null column"):
        cli.main([*args, "--clean"])
    paths = cli.main([*args, "--clean", "--keep-rejects"])
    assert paths["rejects"].endswith("rejects.json")
    import json
    seen = json.loads(open(paths["rejects"]).read())
    assert seen["train"]["lines"] == 62 and seen["train"]["kept"] == 60 and seen["test"]["malformed"] == 1
    assert spark.read.option("header", True).csv(paths["metrics"]).first()["Recall"] == "1.0"

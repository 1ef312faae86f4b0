from pyspark.sql import functions as F

from forestlens.functions import binarize, register_binarizer
from forestlens.operators import clean, split as sp


def test_strip_suffix_and_binarize(spark):
    df = spark.createDataFrame([("normal.",), ("smurf.",), ("a.b.",), (None,)], "attack_type string")
    out = clean.strip_label_suffix(df).collect()
    assert [r[0] for r in out] == ["normal", "smurf", "a.b", None]
    b = clean.with_binary_label(clean.strip_label_suffix(df), out="bin").collect()
    assert [r["bin"] for r in b] == ["normal", "anomaly", "anomaly", None]


def test_binarize_already_binary_unchanged(spark):
    df = spark.createDataFrame([("normal",), ("anomaly",)], "l string")
    assert [r[0] for r in df.select(binarize("l")).collect()] == ["normal", "anomaly"]


def test_sql_binarizer_is_inlined(spark):
    register_binarizer(spark)
    spark.createDataFrame([("normal",), ("neptune",), (None,)], "l string").createOrReplaceTempView("labels_t")
    q = spark.sql("SELECT binarizer(l) AS b FROM labels_t")
    assert [r["b"] for r in q.collect()] == ["normal", "anomaly", None]
    assert "PythonUDF" not in q._jdf.queryExecution().executedPlan().toString()


def test_dedup_and_quarantine(spark):
    df = spark.createDataFrame([("icmp", 1), ("http", 1), ("http", 1), (None, 2)], "service string, x int")
    assert clean.dedup_rows(df).count() == 3
    kept, rejected = clean.quarantine(df, clean.illegal_service_rule())
    assert kept.count() == 3 and rejected.count() == 1
    tagged = {(r["service"], r["status"]) for r in clean.tag_by_rule(df, clean.illegal_service_rule()).collect()}
    assert ("icmp", "rejected") in tagged and (None, "kept") in tagged


def test_split_is_a_partition(spark):
    df = spark.range(0, 5000).withColumn("v", F.col("id") % 7)
    base, (a, b) = sp.persisted_split(df, (0.8, 0.2), 42)
    try:
        na, nb = a.count(), b.count()
        assert na + nb == 5000
        assert a.join(b, "id").count() == 0
        assert abs(na / 5000 - 0.8) < 0.03
    finally:
        sp.release(base)


def test_union_is_positional(spark):
    a = spark.createDataFrame([("x", 1)], "l string, k int")
    b = spark.createDataFrame([("y", 2)], "l string, k int")
    assert [r["l"] for r in sp.union_labels(a, b, "l").collect()] == ["x", "y"]


def test_quarantine_written_in_one_pass_and_binarized_dataset(spark, tmp_path):
    from forestlens.sources import sinks
    df = spark.createDataFrame([("icmp", "smurf"), ("http", "normal"), ("http", "neptune")],
                               "service string, attack_type string")
    out = clean.write_quarantined(df, clean.illegal_service_rule(), str(tmp_path / "q"))
    back = spark.read.parquet(out)
    assert {(r["service"], r["status"]) for r in back.collect()} == {
        ("icmp", "rejected"), ("http", "kept")}
    assert (tmp_path / "q" / "status=rejected").is_dir() and (tmp_path / "q" / "status=kept").is_dir()
    path = sinks.write_records(clean.binarize_dataset(df), str(tmp_path / "bin"))
    lines = sorted("".join(p.read_text() for p in (tmp_path / "bin").glob("part-*.csv")).splitlines())
    assert lines == ["http,anomaly", "http,normal", "icmp,anomaly"]

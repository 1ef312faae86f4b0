import pytest

from forestlens.operators import features as fe, model as mdl


def test_index_tie_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "x string")
    m = fe.index_stage(["x"]).fit(df)
    assert m.labelsArray[0] == ["c", "a", "b"]


def test_unseen_category_error_and_keep(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "x string")
    test = spark.createDataFrame([("z",)], "x string")
    with pytest.raises(Exception):
        fe.one_hot_pipeline(["x"]).fit(train).transform(test).collect()
    out = fe.one_hot_pipeline(["x"], "keep").fit(train).transform(test).first()
    assert out["x_index"] == 2.0 and out["x_vec"].toArray().tolist()[-1] == 1.0


def test_one_hot_drops_last_and_constant_columns(spark):
    df = spark.createDataFrame([("a", "k"), ("b", "k"), ("b", "k")], "x string, y string")
    assert fe.constant_columns(df, ["x", "y"]) == ["y"]
    m, keep, dropped = mdl.fit_categorical_index(df, ["x", "y"])
    assert keep == ["x"] and dropped == ["y"]
    enc = fe.one_hot_pipeline(["x"]).fit(df).transform(df).collect()
    vecs = {r["x"]: r["x_vec"].toArray().tolist() for r in enc}
    assert vecs == {"b": [1.0], "a": [0.0]}


def test_assembler_and_slot_sums(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a")], "q double, c string")
    enc = fe.one_hot_pipeline(["c"]).fit(df).transform(df)
    out = fe.assembler(["q", "c_vec"]).transform(enc)
    sums = {r["slot"]: r["total"] for r in fe.vector_slot_sums(out).collect()}
    assert sums == {0: 6.0, 1: 2.0}
    with pytest.raises(Exception):
        fe.assembler(["q"]).transform(spark.createDataFrame([(None,)], "q double")).collect()


def test_single_column_mini_pipeline(spark):
    df = spark.createDataFrame([("tcp",), ("udp",), ("tcp",), ("icmp",)], "protocol_type string")
    out = fe.column_one_hot_pipeline("protocol_type").fit(df).transform(df)
    vecs = {r["protocol_type"]: r["protocol_type_vec"].toArray().tolist() for r in out.collect()}
    # tcp most frequent -> index 0; icmp/udp tie -> alphabetical; last one dropped
    assert vecs == {"tcp": [1.0, 0.0], "icmp": [0.0, 1.0], "udp": [0.0, 0.0]}

from forestlens.session import checkpoint_root, scratch_path


def test_checkpoint_root_comes_from_the_session(spark):
    root = checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir().rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root + "/forestlens/x-")

"""The four jobs through the command line, on hand-made connection records
with the full 42-field schema and the default 40-feature order."""
from forestlens.plans import cli
from forestlens.schema import ALL_CLASSES

TEMPLATE = ("{dur},{proto},{svc},SF,{src},{dst},0,0,0,0,0,{logged},0,0,0,0,0,0,0,0,0,0,{cnt},8,0.00,0.00,0.00,0.00,"
            "1.00,0.00,0.00,9,9,1.00,0.00,0.11,0.00,0.00,0.00,0.00,0.00,{label}")


def _records(n, novel=False):
    out = []
    for i in range(n):
        tcp = i % 2 == 0
        label = "normal" if tcp else ("mailbomb" if novel and i % 6 == 1 else "smurf")
        out.append(TEMPLATE.format(dur=i % 5, proto="tcp" if tcp else "icmp", svc="http" if tcp else "ecr_i",
                                   src=200 + i if tcp else 1032, dst=5000 if tcp else 0, logged=1 if tcp else 0,
                                   cnt=3 if tcp else 500, label=label))
    return "\n".join(out) + "\n"


def test_cli_jobs(spark, tmp_path):
    train, test = tmp_path / "train.csv", tmp_path / "test.csv"
    train.write_text(_records(60))
    test.write_text(_records(30, novel=True))
    p2 = cli.main(["x2", str(train), str(test), str(tmp_path / "x2"), "3", "4"])
    metrics = (tmp_path / "x2" / "metrics.csv").read_text().splitlines()
    assert metrics[0] == "Split #,Precision,Recall,F1"
    matrix = (tmp_path / "x2" / "matrix.csv").read_text().splitlines()
    assert matrix[0].startswith("A\\P,back,") and len(matrix) == 41
    rows = {line.split(",")[0]: line.split(",")[1:] for line in matrix[1:]}
    # the test-only class (icmp rows) is predicted as the seen icmp class
    assert float(rows["mailbomb"][ALL_CLASSES.index("smurf")]) == 5.0
    p3 = cli.main(["x3", str(train), str(test), str(tmp_path / "x3"), "3", "4"])
    assert set(p3) == {"metrics", "matrix", "triplets"}
    p4 = cli.main(["x4", str(train), str(test), str(tmp_path / "x4"), "3", "4", "--reports"])
    assert set(p4) == {"pairs", "false_normal", "correct_anomaly", "excluded_tail"}
    fn = (tmp_path / "x4" / "false_normal.csv").read_text().splitlines()
    assert fn[0] == "attack_type,labeled_normal,labeled_anomaly,in_train"
    tail = (tmp_path / "x4" / "excluded_tail.csv").read_text().splitlines()
    assert tail[0] == "labels,instances"
    p1 = cli.main(["x1", str(train), str(tmp_path / "x1"), "3", "4"])
    assert set(p1) == {"metrics", "matrix"} and set(p2) == {"metrics", "matrix"}


def test_cli_clean_raw_files(spark, tmp_path):
    train, test = tmp_path / "train.csv", tmp_path / "test.csv"
    raw_train = _records(60).replace("normal\n", "normal.\n").replace("smurf\n", "smurf.\n")
    train.write_text(raw_train + raw_train)                       # duplicated records
    raw_test = _records(30).replace("normal\n", "normal.\n").replace("smurf\n", "smurf.\n")
    illegal = TEMPLATE.format(dur=0, proto="icmp", svc="icmp", src=1, dst=0, logged=0, cnt=1, label="smurf.")
    test.write_text(raw_test + illegal + "\n")
    paths = cli.main(["x2", str(train), str(test), str(tmp_path / "out"), "3", "4", "--clean"])
    matrix = (tmp_path / "out" / "matrix.csv").read_text().splitlines()
    total = sum(float(v) for line in matrix[1:] for v in line.split(",")[1:])
    assert total == 30.0 and set(paths) == {"metrics", "matrix"}
    p1 = cli.main(["x1", str(train), str(tmp_path / "x1"), "3", "4", "--clean"])
    m1 = (tmp_path / "x1" / "matrix.csv").read_text().splitlines()
    # 60 distinct records after de-duplicating the doubled file; the 80/20 split scores the rest
    assert set(p1) == {"metrics", "matrix"} and 0 < sum(float(v) for line in m1[1:] for v in line.split(",")[1:]) < 60
    staged = spark.read.parquet(str(tmp_path / "out" / "test_clean"))
    rejected = staged.filter("status = 'rejected'").collect()
    assert len(rejected) == 1 and rejected[0]["service"] == "icmp"
    assert staged.filter("status = 'kept'").count() == 30


def test_cli_parquet_inputs(spark, tmp_path):
    from forestlens.sources.csv import read_connections
    train_csv, test_csv = tmp_path / "train.csv", tmp_path / "test.csv"
    train_csv.write_text(_records(60))
    test_csv.write_text(_records(30, novel=True))
    read_connections(spark, str(train_csv)).write.parquet(str(tmp_path / "train.parquet"))
    read_connections(spark, str(test_csv)).write.parquet(str(tmp_path / "test.parquet"))
    paths = cli.main(["x2", str(tmp_path / "train.parquet"), str(tmp_path / "test.parquet"), str(tmp_path / "out"),
                      "3", "4", "--format", "parquet"])
    matrix = (tmp_path / "out" / "matrix.csv").read_text().splitlines()
    assert set(paths) == {"metrics", "matrix"}
    assert sum(float(v) for line in matrix[1:] for v in line.split(",")[1:]) == 30.0

"""A failed task is retried and recomputed without changing results (own
session: local[4,2] allows one retry). The failure is injected upstream of a
round-robin repartition and of the evaluation aggregate."""
import json
import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent("""
    import json, sys
    sys.path.insert(0, {root!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    spark = (SparkSession.builder.master("local[4,2]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from forestlens.operators import evaluate as ev
    from forestlens.plans import fixtures as fx

    @F.udf("string")
    def flaky(label):
        ctx = TaskContext.get()
        if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        return label

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(4)
    pred = fx.rule_predictions(li)
    clean = ev.confusion_matrix(pred.repartition(8), fx.RULE_DOMAIN).collect()
    failing = ev.confusion_matrix(pred.withColumn("actual", flaky("actual")).repartition(8), fx.RULE_DOMAIN).collect()
    key = lambda rows: sorted((r["actual"], r["predicted"], r["n"]) for r in rows)
    print(json.dumps({{"clean": key(clean), "failing": key(failing)}}))
""")


def test_results_survive_a_task_retry(tmp_path):
    script = tmp_path / "retry.py"
    script.write_text(SCRIPT.format(root=ROOT))
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")]
    assert line, out.stderr[-2000:]
    res = json.loads(line[-1])
    assert res["clean"] == res["failing"] and sum(n for _, _, n in res["clean"]) > 0

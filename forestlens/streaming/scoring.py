"""Scoring a stream of records with a fitted pipeline and keeping a running
confusion count (F11 + E1 on Structured Streaming).

The fitted ``PipelineModel`` transforms a streaming DataFrame like a batch one.
The running counts are a streaming aggregate on (actual, predicted): state is
one row per matrix cell, kept in the state store under the query's checkpoint
location, so a restarted query resumes from its last committed batch."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forestlens.operators.evaluate import ClassDomain, confusion_counts, dense_matrix, overall_metrics, per_class_metrics
from forestlens.session import scratch_path


def read_record_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of records with a declared schema (no inference). ``path``: a table's own
    path, a single file or a folder of files."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a pattern that matches only this path: Spark then takes a file as well as a folder
    path = path.rstrip("/")
    return r.load(f"{path[:-1]}[{path[-1]}]")


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    return model.transform(stream)


def running_confusion_counts(pred_stream: DataFrame, actual: str, predicted: str,
                             keys: Sequence[str] | None = None) -> DataFrame:
    """Streaming (keys..., actual, predicted, n); emit with output mode
    ``complete`` or ``update``."""
    return confusion_counts(pred_stream, actual, predicted, keys)


def start_running_matrix_table(pred_stream: DataFrame, actual: str, predicted: str, path: str,
                               checkpoint_location: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """The running counts, published to shared storage: each micro-batch writes the complete
    counts (at most k^2 rows per key) to a folder of its own, ``<path>/batch=<id>``.
    A replayed batch rewrites the same folder; earlier snapshots stay, so a reader
    (:func:`read_running_matrix`) always finds a whole one."""
    spark = pred_stream.sparkSession
    loc = checkpoint_location or scratch_path(spark, "stream-table")

    def publish(batch: DataFrame, batch_id: int) -> None:
        # a shuffle of the (<= k^2) output rows keeps the stateful stage parallel
        batch.repartition(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = (running_confusion_counts(pred_stream, actual, predicted).writeStream
         .outputMode("complete").foreachBatch(publish).option("checkpointLocation", loc))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def start_running_matrix(pred_stream: DataFrame, actual: str, predicted: str, checkpoint_location: str,
                         trigger: dict | None = None) -> StreamingQuery:
    """The running counts in the state store of ``checkpoint_location`` and nowhere else; read them with
    :func:`read_state_counts`."""
    w = (running_confusion_counts(pred_stream, actual, predicted).writeStream
         .outputMode("update").format("noop").option("checkpointLocation", checkpoint_location))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and len(fs.listStatus(target)) > 0


def read_state_counts(spark: SparkSession, checkpoint_location: str) -> DataFrame:
    """``(actual, predicted, n)`` from the state of a running or ended query: its latest committed version, whatever the number of
    batches. A query that has committed nothing has no counts."""
    if not _exists(spark, f"{checkpoint_location}/commits"):
        return spark.createDataFrame([], "actual string, predicted string, n long")
    state = spark.read.format("statestore").load(checkpoint_location)
    return state.select("key.actual", "key.predicted", F.col("value.count").cast("long").alias("n"))


def read_running_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The latest published counts ``(actual, predicted, n)``; none before the first batch."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "actual string, predicted string, n long")
    every = spark.read.schema("actual string, predicted string, n long, batch long").parquet(path)
    latest = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == latest).drop("batch")


def matrix_from_counts(counts: DataFrame, domain: ClassDomain) -> dict[str, DataFrame]:
    """Batch view over a snapshot of the running counts: dense matrix and metrics."""
    m = dense_matrix(counts, domain)
    pc = per_class_metrics(m)
    return {"matrix": m, "per_class": pc, "overall": overall_metrics(pc)}

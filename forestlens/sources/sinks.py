"""Sinks (S2-S7): DataFrame writers and pipeline persistence.

Row-level outputs (pairs, triplets, binarized records) are written in parallel,
one file per partition. Only the metrics table and the confusion matrix, whose
size is bounded by the number of splits and k^2 cells, are written as one file,
in the study's layout; they are brought to one partition by a (tiny) shuffle,
never by coalescing, which would pull the upstream stage into one task."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forestlens.operators.evaluate import ClassDomain

METRICS_HEADER = ["Split #", "Precision", "Recall", "F1"]
MATRIX_CORNER = "A\\P"


def publish_single_file(spark, out_dir: str, target: str) -> str:
    """Move the one ``part-*`` file of a single-partition output directory to
    ``target`` (e.g. ``<dir>/metrics.csv``) through the Hadoop FileSystem API, so
    it works on any cluster file system; the directory is then removed. Only
    used for outputs bounded by the class count."""
    jvm = spark._jvm
    hconf = spark._jsc.hadoopConfiguration()
    src_dir = jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = src_dir.getFileSystem(hconf)
    parts = [st.getPath() for st in fs.listStatus(src_dir) if st.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"expected one part file in {out_dir}, found {len(parts)}")
    dst = jvm.org.apache.hadoop.fs.Path(target)
    # one rename over the old file: a reader sees the old result or the new one
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), hconf).rename(fs.makeQualified(parts[0]), fs.makeQualified(dst), over)
    fs.delete(src_dir, True)
    return target


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> str:
    """``metrics.csv`` layout: header ``Split #,Precision,Recall,F1``."""
    out = metrics.select(
        F.col("split").alias(METRICS_HEADER[0]), F.col("precision").alias(METRICS_HEADER[1]),
        F.col("recall").alias(METRICS_HEADER[2]), F.col("f1").alias(METRICS_HEADER[3]))
    (out.repartition(1).sortWithinPartitions(METRICS_HEADER[0])
     .write.mode(mode).option("header", True).csv(path))
    return path


def matrix_wide(matrix: DataFrame, domain: ClassDomain) -> DataFrame:
    """S3 layout as a frame: one row per actual class in domain order, one double
    column per predicted class in domain order, first column ``A\\P``."""
    classes = list(domain.classes)
    wide = (matrix.groupBy("actual_idx", "actual")
            .pivot("predicted", classes)
            .agg(F.sum(F.col("n").cast("double"))))
    return wide.select("actual_idx", F.col("actual").alias(MATRIX_CORNER),
                       *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in classes])


def write_confusion_matrix(matrix: DataFrame, domain: ClassDomain, path: str, mode: str = "overwrite") -> str:
    """S3: write the dense matrix as ``A\\P,<classes>`` CSV, rows in domain order."""
    wide = matrix_wide(matrix, domain)
    (wide.repartition(1).sortWithinPartitions("actual_idx").drop("actual_idx")
     .write.mode(mode).option("header", True).option("escape", "\u0000").csv(path))
    return path


def write_records(df: DataFrame, path: str, header: bool = False, mode: str = "overwrite") -> str:
    """Headerless CSV, written in parallel (C4 data sets, S4/S5 label tuples)."""
    df.write.mode(mode).option("header", header).csv(path)
    return path


def write_pairs(pred: DataFrame, path: str, actual: str = "attack_type",
                predicted: str = "predicted_label", mode: str = "overwrite") -> str:
    """``actual,predicted`` lines, no header."""
    return write_records(pred.select(actual, predicted), path, mode=mode)


def write_triplets(pred: DataFrame, path: str, actual: str = "attack_type", actual_bin: str = "attack_type_bin",
                   predicted: str = "predicted_label", mode: str = "overwrite") -> str:
    """``actual,actual_bin,predicted_bin`` lines, no header."""
    return write_records(pred.select(actual, actual_bin, predicted), path, mode=mode)


def write_json(spark, value, target: str) -> str:
    """A small driver-side value (counts, a manifest) as one JSON file, replaced in one rename."""
    tmp = f"{target}.tmp-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").repartition(1).write.text(tmp)
    return publish_single_file(spark, tmp, target)


def save_pipeline(pipeline: Pipeline, out_dir: str) -> str:
    """The unfitted pipeline spec under ``<dir>/pipeline`` (overwrite)."""
    path = out_dir.rstrip("/") + "/pipeline"
    pipeline.write().overwrite().save(path)
    return path


def save_model(model: PipelineModel, out_dir: str) -> str:
    """The fitted pipeline under ``<dir>/pipelineModel`` (overwrite)."""
    path = out_dir.rstrip("/") + "/pipelineModel"
    model.write().overwrite().save(path)
    return path


def load_pipeline(out_dir: str) -> Pipeline:
    return Pipeline.load(out_dir.rstrip("/") + "/pipeline")


def load_model(out_dir: str) -> PipelineModel:
    return PipelineModel.load(out_dir.rstrip("/") + "/pipelineModel")

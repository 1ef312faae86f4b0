"""End-to-end jobs X1-X4 as one parametrized ``run_experiment`` plus presets.

The four study jobs differ only in label source (multi-class or binarized),
label-index scope (train only, or train UNION ALL test) and outputs (matrix +
metrics, triplets, pairs). Predictions stay a lazy DataFrame; evaluation is the
distributed aggregate of ``forestlens.operators.evaluate``; outputs are written by
DataFrame writers."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forestlens.operators import clean, evaluate as ev, features as fe, model as mdl, records as rc, reports, split as sp
from forestlens.schema import (
    ALL_CLASSES, BIN_CLASSES, CATEGORICAL_COLUMNS, LABEL_COLUMN, TRAIN_CLASSES, connection_feature_order,
)
from forestlens.session import checkpoint_root
from forestlens.sources import sinks

PREDICTED_LABEL = "predicted_label"
LABEL_INDEX = "attack_type_index"


@dataclass
class ExperimentConfig:
    num_trees: int = 50
    max_depth: int = 20
    seed: int = 42
    label: str = LABEL_COLUMN
    categorical: Sequence[str] = tuple(CATEGORICAL_COLUMNS)
    features: Sequence[str] = field(default_factory=connection_feature_order)
    binarize: bool = False                 # X3: derive <label>_bin and train on it
    label_scope: str = "union"             # "train" (X1: a pipeline stage) or "union" (X2-X4)
    split_weights: Sequence[float] = (0.8, 0.2)   # X1 only (no test frame given)
    split_seed: int = 42
    classes: Sequence[str] | None = None   # evaluation domain (matrix order)
    train_classes: Sequence[str] | None = None
    handle_invalid: str = "error"
    drop_constant: bool = True
    cache_train: bool = True
    train_partitions: int | None = None    # number of training partitions, dealt by value; by default it follows the number of records
    collapse: bool = True                  # train on (record, weight); False: on the rows as the input's files deal them
    cache_node_ids: bool = False           # deep trees; needs a checkpoint folder


@dataclass
class ExperimentResult:
    config: ExperimentConfig
    model: PipelineModel
    labels: list[str]
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    actual: str                # label column the matrix is built on
    dropped_constant: list[str]
    persisted: list[DataFrame] = field(default_factory=list)
    scored: DataFrame | None = None    # predictions; X1's are of records, with their weight
    weight: str | None = None
    trained_records: int | None = None
    train_records: DataFrame | None = None     # X1's training split as records

    def domain(self) -> ev.ClassDomain:
        classes = self.config.classes or self.labels
        return ev.ClassDomain.of(classes, self.config.train_classes)

    def evaluation(self, checkpoint: bool = True, predictions: DataFrame | None = None) -> ev.Evaluation:
        """Of the test set, records counted by weight; of ``predictions`` if given (row by row
        unless they carry the weight column)."""
        pred = self.scored if predictions is None else predictions
        weight = self.weight if self.weight in pred.columns else None
        return ev.evaluate(pred, self.domain(), self.actual, PREDICTED_LABEL, checkpoint=checkpoint, weight=weight)

    def rows(self, scored: DataFrame) -> DataFrame:
        """One row per scored row, whatever stands for it."""
        return rc.expand(scored, self.weight) if self.weight in scored.columns else scored

    def pairs(self) -> DataFrame:
        return self.predictions.select(self.config.label, PREDICTED_LABEL)

    def triplets(self) -> DataFrame:
        return self.predictions.select(self.config.label, self.config.label + "_bin", PREDICTED_LABEL)

    def release(self) -> None:
        sp.release(*self.persisted)


def run_experiment(train: DataFrame, test: DataFrame | None, cfg: ExperimentConfig) -> ExperimentResult:
    label = cfg.label
    persisted: list[DataFrame] = []
    raw = sorted(set(cfg.categorical) | {f for f in cfg.features if not f.endswith(fe.VEC_SUFFIX)} | {label})
    if cfg.cache_node_ids:
        checkpoint_root(train.sparkSession)
    weight = rc.WEIGHT if cfg.collapse else None
    whole = None
    if test is None and cfg.collapse:                   # X1: one file, collapsed to records and split 80/20
        base, held = rc.persisted_records(train.select(*raw), cfg.train_partitions)
        persisted += held
        train, test = rc.split(base, cfg.split_weights, cfg.split_seed)
        whole = weight
    elif test is None:
        base, (train, test) = sp.persisted_split(train.select(*raw), cfg.split_weights, cfg.split_seed)
        persisted.append(base)
    if cfg.binarize:                                    # X3: P2 on both sets
        train = clean.with_binary_label(train, label, label + "_bin")
        test = clean.with_binary_label(test, label, label + "_bin")
    target = label + "_bin" if cfg.binarize else label

    categorical = list(cfg.categorical)
    feats = list(cfg.features)
    needed = sorted(set(categorical) | {f for f in feats if not f.endswith(fe.VEC_SUFFIX)} | {target})
    fitting: list[DataFrame] = []
    if whole:                                           # a split's records keep the partitions they have
        train_in = train.select(*needed, weight)
    elif cfg.collapse:
        train_in, fitting = rc.persisted_records(train.select(*needed), cfg.train_partitions)
    else:
        train_in = sp.fixed_partitions(train.select(*needed), cfg.train_partitions)
    if cfg.cache_train and not fitting:
        train_in = train_in.persist(StorageLevel.MEMORY_AND_DISK)
        fitting = [train_in]
    try:
        # Vocabularies of all categorical columns in one pass; constant columns are
        # found from them (no separate scan) and left out, as the encoder rejects them.
        index_model, categorical, dropped = mdl.fit_categorical_index(train_in, categorical, cfg.handle_invalid, weight)
        if dropped and not cfg.drop_constant:
            raise ValueError(f"single-valued categorical columns: {dropped}")
        feats = [f for f in feats if f not in {d + fe.VEC_SUFFIX for d in dropped}]

        clf = mdl.forest(cfg.num_trees, cfg.max_depth, LABEL_INDEX, seed=cfg.seed, cache_node_ids=cfg.cache_node_ids, weight=weight)
        if cfg.label_scope == "train":                      # X1: label index is a stage, fit on train
            stage = mdl.fit_label_index(train_in, target, LABEL_INDEX, weight=weight) if weight else mdl.label_indexer(target, LABEL_INDEX)
            pipe = mdl.build_pipeline(categorical, feats, clf, labels=None, label_stage=stage,
                                      handle_invalid=cfg.handle_invalid, index_model=index_model)
            n_cat = 2 if categorical else 0
            model = mdl.fit_with_label_stage(pipe, train_in, n_cat, PREDICTED_LABEL, cache=False)
            labels = list(model.stages[n_cat].labels)
        elif cfg.label_scope == "union":                    # X2-X4: index over train UNION ALL test
            lm = mdl.fit_label_index(train_in, target, LABEL_INDEX, test=test, weight=weight)
            labels = list(lm.labels)
            pipe = mdl.build_pipeline(categorical, feats, clf, labels=labels, handle_invalid=cfg.handle_invalid,
                                      index_model=index_model)
            model = mdl.fit(pipe, lm.transform(train_in), cache=False)
        else:
            raise ValueError("label_scope must be 'train' or 'union'")
        trained = train_in.count() if fitting else None
    finally:
        sp.release(*fitting)

    scored = mdl.score(model, test)
    result = ExperimentResult(cfg, model, labels, train, test, scored, target, dropped, persisted, scored, whole, trained)
    if whole:
        result.train_records = train
        result.train, result.test, result.predictions = (rc.expand(x, weight) for x in (train, test, scored))
    return result


def write_outputs(result: ExperimentResult, out_dir: str, pairs: bool = False, triplets: bool = False,
                  matrix: bool = True, save_model: bool = False, single_files: bool = True,
                  attribution: bool = False) -> dict[str, str]:
    """metrics.csv / matrix.csv layouts (S2, S3), pairs / triplets (S4, S5), model (S6, S7),
    attribution tables (R3-R5). The test set is scored once, whatever is written.

    The metrics and the matrix (bounded by the class count) end up as the single
    files ``metrics.csv`` and ``matrix.csv``; pairs and triplets (one line per
    scored row) stay distributed directories."""
    out = out_dir.rstrip("/")
    paths: dict[str, str] = {}
    label, cfg = result.config.label, result.config
    cols = [label] + ([label + "_bin"] if cfg.binarize else []) + [PREDICTED_LABEL]
    if result.weight:
        cols.append(result.weight)
    scored = result.scored.select(*dict.fromkeys(cols))
    shared = matrix + pairs + triplets + attribution > 1
    if shared:
        # Score once: the label columns of the predictions feed both the matrix
        # and the row-level files (a lost block is re-scored from the model).
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if matrix:
            e = result.evaluation(checkpoint=True, predictions=scored)
            om = e.overall.selectExpr("0 AS split", "precision", "recall", "f1")
            paths["metrics"] = sinks.write_metrics(om, f"{out}/metrics")
            paths["matrix"] = sinks.write_confusion_matrix(e.matrix, result.domain(), f"{out}/matrix")
            if single_files:
                spark = result.predictions.sparkSession
                paths["metrics"] = sinks.publish_single_file(spark, paths["metrics"], f"{out}/metrics.csv")
                paths["matrix"] = sinks.publish_single_file(spark, paths["matrix"], f"{out}/matrix.csv")
        if pairs:
            paths["pairs"] = sinks.write_pairs(result.rows(scored), f"{out}/pairs", label, PREDICTED_LABEL)
        if triplets:
            paths["triplets"] = sinks.write_triplets(result.rows(scored), f"{out}/triplets", label, label + "_bin",
                                                     PREDICTED_LABEL)
        if attribution:
            paths |= write_attribution_reports(result, out, result.rows(scored))
    finally:
        if shared:
            scored.unpersist()
    if save_model:
        paths["model"] = sinks.save_model(result.model, out)
    return paths


def commit_outputs(result: ExperimentResult, out_dir: str, **options) -> dict[str, str]:
    """:func:`write_outputs` into a folder of this run, then one rename of ``current.json`` that names it. A run
    that fails half-way leaves the earlier run readable whole (:func:`current_outputs`)."""
    out = out_dir.rstrip("/")
    paths = write_outputs(result, f"{out}/runs/{uuid.uuid4().hex[:12]}", **options)
    sinks.write_json(result.scored.sparkSession, paths, f"{out}/current.json")
    return paths


def current_outputs(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """The paths of the last run that was committed whole."""
    return json.loads(spark.read.text(f"{out_dir.rstrip('/')}/current.json").first()[0])


def attribution_reports(result: ExperimentResult, train_classes: Sequence[str] = TRAIN_CLASSES,
                        min_errors: int = 20, min_correct: int = 100, scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """The notes' tables after the binary-on-multiclass job (X4): per actual class,
    rows labeled normal / anomaly (R3, by errors), correct anomalies (R4), and the
    classes below the error threshold (R5). "In training" refers to the
    multi-class training classes, which X4 itself never sees. All three come from one
    class-sized table, which is checkpointed, so predictions are read once."""
    dom = ev.ClassDomain.of(sorted(set(train_classes)), train_classes)
    attr = reports.label_attribution(result.predictions if scored is None else scored, result.config.label, PREDICTED_LABEL, domain=dom)
    checkpoint_root(attr.sparkSession)
    attr = attr.checkpoint(eager=True)
    return {"false_normal": reports.false_normal_attribution(attr, min_errors),
            "correct_anomaly": reports.correct_anomaly_attribution(attr, min_correct),
            "excluded_tail": reports.excluded_tail(attr, min_errors)}


def write_attribution_reports(result: ExperimentResult, out_dir: str, scored: DataFrame | None = None, **kw) -> dict[str, str]:
    """R3-R5 as ``<dir>/<name>.csv`` with headers (class-sized tables, one file each, sorted
    within their one partition)."""
    spark = result.predictions.sparkSession
    order = {"false_normal": [F.desc("labeled_normal"), F.asc("attack_type")],
             "correct_anomaly": [F.desc("labeled_anomaly"), F.asc("attack_type")], "excluded_tail": ["labels"]}
    paths = {}
    for name, df in attribution_reports(result, scored=scored, **kw).items():
        tmp = f"{out_dir.rstrip('/')}/{name}"
        df.repartition(1).sortWithinPartitions(*order[name]).write.mode("overwrite").option("header", True).csv(tmp)
        paths[name] = sinks.publish_single_file(spark, tmp, f"{tmp}.csv")
    return paths


# --- presets ------------------------------------------------------------------

def x1_multiclass_split(data: DataFrame, num_trees: int = 50, max_depth: int = 20, **kw) -> ExperimentResult:
    """One de-duplicated file, 80/20 random split, label index fitted on train."""
    kw.setdefault("classes", TRAIN_CLASSES)
    return run_experiment(data, None, ExperimentConfig(num_trees, max_depth, label_scope="train", **kw))


def x2_unseen_classes(train: DataFrame, test: DataFrame, num_trees: int = 50, max_depth: int = 20,
                      **kw) -> ExperimentResult:
    """Separate train/test; test has classes never seen in training."""
    kw.setdefault("classes", ALL_CLASSES)
    kw.setdefault("train_classes", TRAIN_CLASSES)
    return run_experiment(train, test, ExperimentConfig(num_trees, max_depth, label_scope="union", **kw))


def x3_binary(train: DataFrame, test: DataFrame, num_trees: int = 100, max_depth: int = 20,
              **kw) -> ExperimentResult:
    """normal/anomaly model; matrix on the binary labels, triplets out."""
    kw.setdefault("classes", BIN_CLASSES)
    return run_experiment(train, test, ExperimentConfig(num_trees, max_depth, binarize=True, label_scope="union", **kw))


def x4_binary_on_multiclass(train_bin: DataFrame, test: DataFrame, num_trees: int = 100, max_depth: int = 20,
                            **kw) -> ExperimentResult:
    """Trained on binary labels, scored on multi-class data; the label vocabulary
    is binary train labels UNION ALL multi-class test labels; pairs out."""
    return run_experiment(train_bin, test, ExperimentConfig(num_trees, max_depth, label_scope="union", **kw))

"""Label indexing, random forest, pipeline fit and scoring.

Training uses MLlib's distributed random forest (histogram aggregation per tree
level). The training input is projected to the columns the pipeline needs and
persisted for the fit, which reads it several times (vocabularies, split
candidates, the bagged input), then released. For deep trees node ids are
cached and checkpointed to the session's checkpoint folder, so long chains of
levels don't build long lineages."""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forestlens.operators.features import assembler, one_hot_stage, index_stage
from forestlens.operators.split import union_labels


def label_indexer(label: str, out: str = "label_index", handle_invalid: str = "error") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=out, handleInvalid=handle_invalid)


def fit_label_index(train: DataFrame, label: str, out: str = "label_index", test: DataFrame | None = None,
                    test_label: str | None = None, weight: str | None = None) -> StringIndexerModel:
    """F4 (train only) or F5 (train UNION ALL test, so classes only in test get an
    index too). Only the label column is scanned; the vocabulary (one entry per
    class) is the only thing returned to the driver. Training records that have a
    ``weight`` count by it, so the order is that of the rows they stand for."""
    if weight:
        src = train.select(label, F.col(weight).cast("long").alias(weight))
        if test is not None:
            src = src.union(test.select(test_label or label, F.lit(1).cast("long")))
        return StringIndexerModel.from_labels(weighted_vocabularies(src, [label], weight)[0], inputCol=label, outputCol=out,
                                              handleInvalid="error")
    src = train.select(label)
    if test is not None:
        src = union_labels(train, test.withColumnRenamed(test_label, label) if test_label else test, label)
    return label_indexer(label, out).fit(src)


def label_unindexer(labels: Sequence[str], in_col: str = "prediction", out: str = "predicted_label") -> IndexToString:
    """prediction index -> label string through the label model's array."""
    return IndexToString(inputCol=in_col, outputCol=out, labels=list(labels))


def forest(num_trees: int, max_depth: int, label_col: str = "label_index", features: str = "features",
           prediction: str = "prediction", seed: int = 42, subset: str = "auto", max_bins: int = 32,
           max_memory_mb: int = 1024, checkpoint_interval: int = 10, cache_node_ids: bool = False,
           weight: str | None = None, **kw) -> RandomForestClassifier:
    """F8: random forest; other settings default (gini, 32 bins). Node-id caching
    (with checkpoints every ``checkpoint_interval`` levels, for which the session needs
    a checkpoint folder) pays off for deep trees. ``weight`` names the column of record
    weights, if records are collapsed."""
    if weight:
        kw["weightCol"] = weight
    return RandomForestClassifier(
        numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy=subset, labelCol=label_col,
        featuresCol=features, predictionCol=prediction, seed=seed, maxBins=max_bins,
        maxMemoryInMB=max_memory_mb, cacheNodeIds=cache_node_ids, checkpointInterval=checkpoint_interval, **kw)


def build_pipeline(categorical: Sequence[str], features: Sequence[str], classifier: RandomForestClassifier,
                   labels: Sequence[str] | None = None, label_stage: StringIndexer | None = None,
                   handle_invalid: str = "error", predicted_label: str = "predicted_label",
                   index_model: StringIndexerModel | None = None) -> Pipeline:
    """[index + one-hot of the categorical columns] -> [label index (X1 only)]
    -> assembler -> forest -> un-index. ``labels`` is the label array for the
    un-indexer when the label index was fitted outside the pipeline (F5).
    ``index_model`` is an already fitted categorical indexer (see
    :func:`fit_categorical_index`), passed through by the pipeline fit."""
    stages = []
    if categorical:
        stages += [index_model or index_stage(categorical, handle_invalid), one_hot_stage(categorical, handle_invalid)]
    if label_stage is not None:
        stages.append(label_stage)
    stages += [assembler(features, classifier.getFeaturesCol()), classifier]
    if labels is not None:
        stages.append(label_unindexer(labels, classifier.getPredictionCol(), predicted_label))
    return Pipeline(stages=stages)


def weighted_vocabularies(df: DataFrame, cols: Sequence[str], weight: str) -> list[list[str]]:
    """Each column's values by total weight (ties alphabetical), as the index of the rows behind the records would have
    them: one pass and one partial + final aggregate for all columns; NULLs get no index."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)]))
    sums = df.select(cells.alias("cell"), F.col(weight).alias("n")).filter("cell.value IS NOT NULL").groupBy("cell.i", "cell.value").agg(F.sum("n").alias("n"))
    out: list[list] = [[] for _ in cols]
    for r in sums.collect():
        out[r["i"]].append((-r["n"], r["value"]))
    return [[v for _, v in sorted(x, key=lambda t: (t[0], t[1].encode("utf-16-be", "surrogatepass")))] for x in out]


def fit_categorical_index(train: DataFrame, categorical: Sequence[str], handle_invalid: str = "error", weight: str | None = None
                          ) -> tuple[StringIndexerModel | PipelineModel | None, list[str], list[str]]:
    """Fit the categorical vocabularies in one pass and find the single-valued
    columns (which the one-hot encoder rejects) from them, without another scan: the model of
    the usable columns is made from the vocabularies already fitted.
    Returns (indexer model over the usable columns, usable columns, dropped)."""
    cols = list(categorical)
    if not cols:
        return None, [], []
    stage = index_stage(cols, handle_invalid)
    if weight:
        m, labels_of = None, weighted_vocabularies(train, cols, weight)
    else:
        m = stage.fit(train)
        labels_of = [list(x) for x in m.labelsArray]
    dropped = [c for c, labels in zip(cols, labels_of) if len(labels) < 2]
    if m is not None and not dropped:
        return m, cols, []
    keep = [c for c in cols if c not in dropped]
    if not keep:
        return None, [], dropped
    return PipelineModel(stages=[
        StringIndexerModel.from_labels(labels, inputCol=c, outputCol=out, handleInvalid=handle_invalid)
        for c, out, labels in zip(cols, stage.getOutputCols(), labels_of) if c in keep]), keep, dropped


def fit(pipeline: Pipeline, train: DataFrame, cache: bool = True) -> PipelineModel:
    """F10. The (projected) training frame is persisted only for the fit. The model is a copy,
    which has no training summary: that would take the session and the training predictions along
    in every scoring task."""
    if not cache:
        return pipeline.fit(train).copy()
    persisted = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(persisted).copy()
    finally:
        persisted.unpersist()


def fit_with_label_stage(pipeline: Pipeline, train: DataFrame, label_stage_model_index: int,
                         predicted_label: str = "predicted_label", cache: bool = True) -> PipelineModel:
    """Fit a pipeline whose label indexer is a stage (X1), then append the
    un-indexer built from the fitted label vocabulary."""
    model = fit(pipeline, train, cache)
    label_model = model.stages[label_stage_model_index]
    clf = model.stages[-1]
    unindex = label_unindexer(label_model.labels, clf.getPredictionCol(), predicted_label)
    return PipelineModel(stages=list(model.stages) + [unindex])


def score(model: PipelineModel, test: DataFrame) -> DataFrame:
    """batch scoring (lazy)."""
    return model.transform(test)

"""One forest scored at several sizes in one pass (X3's 100 against 200 trees).

A forest's votes are the sum of its trees' class probabilities, in tree order. The votes after s trees are those of
the forest cut to s trees, so one read of the test set and one evaluation of each tree give the predictions of every size;
the sums are made in the order the forest makes them, so ties fall alike."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(model: PipelineModel) -> tuple[PipelineModel, RandomForestClassificationModel, Sequence[str]]:
    """The stages before the forest, the forest, and the labels of its un-indexer."""
    at = next((i for i, s in enumerate(model.stages) if isinstance(s, RandomForestClassificationModel)), None)
    if at is None:
        raise ValueError("the pipeline has no random forest")
    labels = next((s.getLabels() for s in model.stages[at + 1:] if isinstance(s, IndexToString)), None)
    if labels is None:
        raise ValueError("the pipeline does not turn predictions back into labels")
    return PipelineModel(stages=list(model.stages[:at])), model.stages[at], labels


def _added(votes: Column, trees: Column) -> Column:
    return F.aggregate(trees, votes, lambda acc, p: F.zip_with(acc, p, lambda x, y: x + y))


def score_by_size(model: PipelineModel, test: DataFrame, sizes: Sequence[int], keep: Sequence[str],
                  size: str = "size", predicted: str = "predicted_label") -> DataFrame:
    """Columns ``keep`` of ``test`` with ``size`` and the label that the first ``size`` trees predict: one row per
    scored row and size."""
    before, forest, labels = _parts(model)
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1 or sizes[-1] > forest.getNumTrees:
        raise ValueError(f"sizes must lie between 1 and the forest's {forest.getNumTrees} trees")
    rows, names = before.transform(test), []
    for i, tree in enumerate(forest.trees[:sizes[-1]]):
        names.append(f"_votes_{i}")
        tree.setFeaturesCol(forest.getFeaturesCol())
        rows = tree.setProbabilityCol(names[-1]).setRawPredictionCol("").setPredictionCol("").transform(rows)
    rows = rows.select(*keep, F.array(*[vector_to_array(n) for n in names]).alias("_trees"))
    votes, done, found = F.array(*[F.lit(0.0)] * forest.numClasses), 0, []
    for i, s in enumerate(sizes):
        rows = rows.withColumn(f"_sum_{i}", _added(votes, F.slice("_trees", done + 1, s - done)))
        votes, done = F.col(f"_sum_{i}"), s
        first_most = F.array_position(votes, F.array_max(votes)).cast("int")
        found.append(F.struct(F.lit(s).alias(size), F.element_at(F.array(*[F.lit(x) for x in labels]), first_most).alias(predicted)))
    return rows.select(*keep, F.inline(F.array(*found)))

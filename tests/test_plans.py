"""Scale properties read from the physical plans of the registered queries."""
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_MID
from tests.plan_shape import ancestors, formatted, joins_above_raw_scans, plan_tree

PLAN_QUERIES = ["confusion_matrix", "per_class_metrics", "overall_metrics", "false_normal_attribution",
                "correct_anomaly_attribution", "excluded_tail", "unseen_class_rows", "class_distribution",
                "category_rollup", "dedup_rows", "quarantine", "union_all_vocab", "string_index", "one_hot",
                "assemble_features", "confusion_matrix_by_split", "per_class_metrics_by_split"]


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_python_and_joins_only_after_aggregates(spark, name):
    df = entry.queries()[name](spark, SF_MID)
    nodes = plan_tree(df)
    names = [n for n, _, _ in nodes]
    assert not any("Python" in n or "ArrowEval" in n for n in names)
    assert joins_above_raw_scans(nodes) == []


def test_confusion_matrix_plan(spark):
    df = entry.queries()["confusion_matrix"](spark, SF_MID)
    nodes = plan_tree(df)
    names = [n for n, _, _ in nodes]
    # partial aggregate under the first exchange above the scan (map-side combine)
    scan = names.index(next(n for n in names if n.startswith("Scan parquet")))
    above = [nodes[i][0] for i in reversed(range(scan))]
    first_exchange = next(i for i, n in enumerate(above) if n.startswith("Exchange"))
    assert any(n.startswith("HashAggregate") for n in above[:first_exchange])
    # the broadcast side is the checked counts (at most k^2 rows): the domain check
    # over the final aggregate; the grid (generators over a one-row range) streams
    bcast = [i for i, (n, _, _) in enumerate(nodes) if n.startswith("BroadcastExchange")]
    assert len(bcast) == 1
    child = next(j for j, (_, _, p) in enumerate(nodes) if p == bcast[0])
    assert nodes[child][0].startswith("Filter")
    assert nodes[next(j for j, (_, _, p) in enumerate(nodes) if p == child)][0].startswith("HashAggregate")
    below = [n for j, (n, _, _) in enumerate(nodes) if bcast[0] in ancestors(nodes, j)]
    assert not any(n.startswith("Range") for n in below)


def test_scans_are_pruned_and_filters_pushed(spark):
    li = entry.queries()["unseen_class_rows"](spark, SF_MID)
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), GreaterThan(l_linenumber,5)]" in plan
    assert "ReadSchema: struct<l_linenumber:int,l_returnflag:string>" in plan


def test_domain_check_runs_above_the_aggregate(spark):
    df = entry.queries()["confusion_matrix"](spark, SF_MID)
    nodes = plan_tree(df)
    text = formatted(df)
    # the only Filter in the plan is the raise_error check, directly over the final aggregate
    filters = [i for i, (n, _, _) in enumerate(nodes) if n.startswith("Filter")]
    assert len(filters) == 1
    child = next(j for j, (_, _, p) in enumerate(nodes) if p == filters[0])
    assert nodes[child][0].startswith("HashAggregate")
    assert "raise_error" in text

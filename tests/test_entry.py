"""Driver contract, and a DuckDB oracle comparison of the non-forest queries at sf0.001."""
import math
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

FAST = ["confusion_matrix", "per_class_metrics", "overall_metrics", "metrics_by_split", "heatmap_cells",
        "false_normal_attribution", "correct_anomaly_attribution", "excluded_tail", "class_distribution",
        "category_rollup", "string_index", "one_hot", "assemble_features", "csv_roundtrip", "unseen_class_rows",
        "matrix_csv_layout", "connection_records_job", "confusion_matrix_by_split", "per_class_metrics_by_split",
        "dedup_rows", "dedup_documents", "document_distribution", "strip_label_suffix", "quarantine",
        "binarize_label", "union_all_vocab", "split_invariants", "stream_confusion_counts", "attribution_with_nulls",
        "unseen_class_rows_with_nulls", "quarantine_split", "binarizer_sql", "binarized_dataset_roundtrip", "split_by_record",
        "x4_attribution_reports", "forest_noisy_invariants"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 16 and set(df.columns) >= {"actual", "predicted", "n"}


def test_every_query_has_an_oracle_or_is_listed():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 27
    # the training-data operators list theirs in tests/llm
    assert all(re.match(r"op\d+_|pipeline$", n) for n in set(qs) - set(sqls))


def _entry_names(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(entry.__file__).parent)


def test_entry_without_a_package_that_only_the_training_data_operators_need():
    done = _entry_names("tokenizers")
    assert done.returncode == 0, done.stderr
    assert set(done.stdout.split()) == {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}


def test_entry_does_not_hide_a_missing_module_of_the_library():
    done = _entry_names("forestlens.operators.ranking")
    assert done.returncode != 0 and "forestlens.operators.ranking" in done.stderr


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "part", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    q = ", ".join('"' + c + '"' for c in cols)
    want = sorted((tuple(_norm(v) for v in r) for r in con.sql(f"SELECT {q} FROM ({entry.oracle_sql()[name]})").fetchall()),
                  key=repr)
    assert got == want

"""Command line for the four jobs, with the study's argument lists:

  spark-submit jobs.py x1 input-file output-directory num-trees max-depth
  spark-submit jobs.py x2|x3|x4 train-file test-file output-directory num-trees max-depth
  spark-submit jobs.py binarize input-file output-file

``binarize`` writes a data set with its labels replaced by normal / anomaly (what x4 trains on).

Inputs are headerless connection-record CSV (``--format parquet`` for Parquet). No
field may be NULL: a bad or missing value fails the job and names the column.
``--clean`` applies the study's preprocessing to raw files: trailing period
stripped from labels, training records de-duplicated, test records with the
illegal service value set aside: the test file is converted once to Parquet
under ``<output-directory>/test_clean`` with ``status=kept`` / ``status=rejected``
partitions, and the job reads the kept partition.
``--keep-rejects`` (CSV) keeps bad lines instead of failing: every input is staged once under
``<output-directory>/<name>_staged`` with its rejected lines, their file, reason and text, and ``rejects.json``
holds their numbers.
Outputs: x1, x2 metrics + matrix; x3 metrics + matrix + triplets; x4 pairs
(``--reports``: plus the attribution tables false_normal.csv, correct_anomaly.csv,
excluded_tail.csv).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from forestlens.operators import clean
from forestlens.plans import experiments as xp
from forestlens.sources import sinks
from forestlens.sources.csv import read_connections_strict, require_not_null, stage_records, staged_records


def _read(spark: SparkSession, path: str, fmt: str):
    return read_connections_strict(spark, path) if fmt == "csv" else require_not_null(spark.read.parquet(path))


def _staged(spark: SparkSession, path: str, out: str, name: str, rules: dict, seen: dict):
    where = f"{out}/{name}_staged"
    seen[name] = stage_records(spark, path, where, illegal=rules)
    return staged_records(spark, where)


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="forestlens")
    ap.add_argument("job", choices=["x1", "x2", "x3", "x4", "binarize"])
    ap.add_argument("args", nargs="+")
    ap.add_argument("--format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--seed", type=int, default=42)
    ap.add_argument("--train-partitions", type=int, help="partitions of the training rows, dealt by value (the forest depends on them)")
    ap.add_argument("--cache-node-ids", action="store_true", help="deep trees: cache node ids (needs spark.checkpoint.dir)")
    ap.add_argument("--save-model", action="store_true", help="also save the fitted pipeline")
    ap.add_argument("--clean", action="store_true", help="strip label periods, de-dup train, set aside illegal rows")
    ap.add_argument("--keep-rejects", action="store_true", help="set bad CSV lines aside, with their numbers, instead of failing")
    ap.add_argument("--reports", action="store_true", help="x4: also write the attribution tables (R3-R5)")
    ns = ap.parse_args(argv)
    if ns.keep_rejects and (ns.format != "csv" or ns.job == "binarize"):
        ap.error("--keep-rejects takes CSV inputs of x1 to x4")
    need = {"x1": 4, "binarize": 2}.get(ns.job, 5)
    if len(ns.args) != need:
        ap.error(f"{ns.job} takes {need} arguments")
    spark = SparkSession.builder.appName(f"forestlens-{ns.job}").getOrCreate()
    if ns.job == "binarize":
        data = _read(spark, ns.args[0], ns.format)
        data = clean.binarize_dataset(clean.strip_label_suffix(data) if ns.clean else data)
        return {"binarized": sinks.write_records(data, ns.args[1])}
    options = dict(seed=ns.seed, train_partitions=ns.train_partitions, cache_node_ids=ns.cache_node_ids)
    trees, depth = int(ns.args[-2]), int(ns.args[-1])
    out = ns.args[-3]
    seen: dict[str, dict[str, int]] = {}

    def read(i: int, name: str):
        if not ns.keep_rejects:
            return _read(spark, ns.args[i], ns.format)
        rules = {"illegal service": clean.illegal_service_rule()} if ns.clean and name == "test" else {}
        return _staged(spark, ns.args[i], out, name, rules, seen)

    def done(paths: dict[str, str]) -> dict[str, str]:
        return paths | ({"rejects": sinks.write_json(spark, seen, f"{out}/rejects.json")} if seen else {})

    if ns.job == "x1":
        data = read(0, "input")
        if ns.clean:
            data = clean.dedup_rows(clean.strip_label_suffix(data))
        r = xp.x1_multiclass_split(data, trees, depth, **options)
        try:
            return done(xp.write_outputs(r, out, save_model=ns.save_model))
        finally:
            r.release()
    train, test = read(0, "train"), read(1, "test")
    if ns.clean:
        train = clean.dedup_rows(clean.strip_label_suffix(train))
        test = clean.strip_label_suffix(test)
    if ns.clean and not ns.keep_rejects:
        # One pass over the raw test file: kept and rejected rows written as
        # Parquet partitions; the job then reads the kept partition only.
        staged = clean.write_quarantined(test, clean.illegal_service_rule(),
                                         f"{out}/test_clean")
        test = spark.read.parquet(staged).filter("status = 'kept'").drop("status")
    if ns.job == "x2":
        return done(xp.write_outputs(xp.x2_unseen_classes(train, test, trees, depth, **options), out, save_model=ns.save_model))
    if ns.job == "x3":
        return done(xp.write_outputs(xp.x3_binary(train, test, trees, depth, **options), out, triplets=True, save_model=ns.save_model))
    r = xp.x4_binary_on_multiclass(train, test, trees, depth, **options)
    return done(xp.write_outputs(r, out, pairs=True, matrix=False, attribution=ns.reports, save_model=ns.save_model))


def run() -> int:
    """Console entry point: run the job, print the written paths, exit 0."""
    for name, path in main(sys.argv[1:]).items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(run())

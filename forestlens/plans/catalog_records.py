"""Registered queries of records with multiplicity, forest sizes, distributed ranks, domain tables and counted rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from forestlens.operators import clean, evaluate as ev, forest_sizes, incremental, ranking, records as rc
from forestlens.plans import fixtures as fx
from forestlens.plans.catalog import FOREST_DEPTH, FOREST_TREES, _forest, register, surface
from forestlens.session import scratch_path
from forestlens.sources import csv as src, staging


# --- U2 / X1: split by record ---------------------------------------------------

@register("record_split", "U2 X1", """
WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS m FROM lineitem GROUP BY ALL),
t AS (SELECT sum(m) AS n, count(*) AS k FROM r)
SELECT CAST(n AS BIGINT) AS total_rows, CAST(k AS BIGINT) AS records, CAST(floor(0.5 * n + 0.5) AS BIGINT) AS first_rows,
       CAST(floor(0.8 * n + 0.5) - floor(0.5 * n + 0.5) AS BIGINT) AS second_rows,
       CAST(n - floor(0.8 * n + 0.5) AS BIGINT) AS third_rows, CAST(0 AS BIGINT) AS miscounted_records
FROM t
""")
def q_record_split(spark, sf_dir):
    """The whole table's repeated records shared out 50 : 30 : 20: each split has its exact number of rows, and every record's
    copies add up to its rows in the table."""
    rows = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    recs = rc.collapse(rows)
    parts = rc.split(recs, (0.5, 0.3, 0.2))
    names = ("first", "second", "third")
    tagged = recs.select(F.struct(*rows.columns).alias("r"), F.lit("table").alias("part"), F.col(rc.WEIGHT).alias("n"))
    for name, part in zip(names, parts):
        tagged = tagged.union(part.select(F.struct(*rows.columns), F.lit(name), F.col(rc.WEIGHT)))
    one = tagged.groupBy("r").agg(*[F.sum(F.when(F.col("part") == x, F.col("n")).otherwise(0)).alias(x) for x in ("table", *names)])
    off = F.col("table") != F.col("first") + F.col("second") + F.col("third")
    return one.agg(F.sum("table").alias("total_rows"), F.count(F.lit(1)).alias("records"),
                   *[F.sum(x).alias(f"{x}_rows") for x in names], F.sum(off.cast("long")).alias("miscounted_records"))


# --- F8 / F10: weighted training -------------------------------------------------

@register("forest_weighted_records", "F8 F10 E1", f"""
WITH tr AS (SELECT CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'R' THEN 'neptune' ELSE 'smurf' END AS attack_type, l_linestatus, l_returnflag
            FROM lineitem WHERE l_linenumber <= 5),
te AS ({fx.FOREST_TEST_SQL})
SELECT attack_type, CASE WHEN attack_type = 'novel' THEN 'smurf' ELSE attack_type END AS predicted, CAST(count(*) AS BIGINT) AS n,
       CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM tr) d) AS BIGINT) AS trained_records FROM te GROUP BY ALL
""")
def q_forest_weighted_records(spark, sf_dir):
    """A forest on two categorical columns: all training rows collapse to a handful of weighted records, and the test
    set, collapsed too, is counted by weight."""
    from forestlens.plans import experiments as xp
    train, test = fx.forest_frames(fx.table(spark, sf_dir, "lineitem"))
    cols = [*fx.FOREST_CATEGORICAL, "attack_type"]
    r = xp.x2_unseen_classes(train.select(*cols), rc.collapse(test.select(*cols)), FOREST_TREES, FOREST_DEPTH, classes=fx.FOREST_DOMAIN.classes,
                             train_classes=fx.FOREST_DOMAIN.train_classes, categorical=fx.FOREST_CATEGORICAL,
                             features=[f"{c}_vec" for c in fx.FOREST_CATEGORICAL])
    counts = ev.confusion_counts(r.predictions, r.actual, "predicted_label", weight=rc.WEIGHT)
    return counts.select(F.col("actual").alias("attack_type"), "predicted", "n", F.lit(r.trained_records).cast("long").alias("trained_records"))


# --- X3: several forest sizes ------------------------------------------------------

_SIZES = (FOREST_TREES // 2, FOREST_TREES)


@register("forest_size_matrices", "X3 E1 E10 F11", f"""
WITH te AS ({fx.FOREST_TEST_SQL}),
p AS (SELECT CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS c FROM te)
SELECT s.size, a.c AS actual, b.c AS predicted, CAST((SELECT count(*) FROM p WHERE p.c = a.c AND a.c = b.c) AS BIGINT) AS n
FROM (VALUES ({_SIZES[0]}), ({_SIZES[1]})) s(size), (VALUES ('normal'), ('anomaly')) a(c), (VALUES ('normal'), ('anomaly')) b(c)
""")
def q_forest_size_matrices(spark, sf_dir):
    """X3's matrices at half and at all of the trees, from one model and one read of the test set."""
    r = _forest(spark, sf_dir, "x3")
    scored = forest_sizes.score_by_size(r.model, r.test, _SIZES, [r.actual])
    return ev.confusion_matrix(scored, r.domain(), r.actual, "predicted_label", keys=["size"]).select("size", "actual", "predicted", "n")


@register("forest_size_metrics", "X3 E10", f"""
WITH t AS (SELECT count(*) AS n FROM ({fx.FOREST_TEST_SQL}) x)
SELECT size AS split, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1
FROM (VALUES ({_SIZES[0]}), ({_SIZES[1]})) s(size), t WHERE n > 0
""")
def q_forest_size_metrics(spark, sf_dir):
    """E10 over forest sizes instead of splits."""
    r = _forest(spark, sf_dir, "x3")
    scored = forest_sizes.score_by_size(r.model, r.test, _SIZES, [r.actual])
    return surface(ev.metrics_table(scored, r.domain(), r.actual, "predicted_label", split="size"))


# --- F1 / F5: ranks off the driver ----------------------------------------------------

@register("frequency_index", "F1 F5", """
WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1)
SELECT value, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS BIGINT) AS index FROM c
""")
def q_frequency_index(spark, sf_dir):
    """A string index of a key with as many values as there are parts, over both slices of the table."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_partkey")
    return ranking.frequency_index(li.filter("l_linenumber <= 5"), "l_partkey", also=li.filter("l_linenumber > 5"))


@register("index_by_join", "F1", """
WITH c AS (SELECT o_custkey AS value, row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) - 1 AS idx FROM orders GROUP BY o_custkey),
k AS (SELECT count(*) AS size FROM c)
SELECT c_custkey, CAST(coalesce(idx, size) AS DOUBLE) AS c_custkey_index FROM customer JOIN k ON TRUE LEFT JOIN c ON c.value = c_custkey
""")
def q_index_by_join(spark, sf_dir):
    """Customers indexed by their number of orders; those without one get the last index (``keep``)."""
    vocabulary = ranking.frequency_index(fx.table(spark, sf_dir, "orders"), "o_custkey")
    return ranking.index_by_join(fx.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", vocabulary, handle_invalid="keep")


# --- E2: the domain as a table -----------------------------------------------------------

_PART_PREDICTIONS_SQL = """
SELECT CAST(l_partkey AS VARCHAR) AS actual,
       CASE WHEN l_quantity >= 48 THEN 'none' WHEN l_discount = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS predicted
FROM lineitem
"""


def _part_predictions(spark, sf_dir):
    """One class per part, more than a plan could hold as literals; the predicted 'none' is outside the domain."""
    key = F.col("l_partkey").cast("string")
    rule = F.when(F.col("l_quantity") >= 48, "none").when(F.col("l_discount") == 0, F.col("l_suppkey").cast("string")).otherwise(key)
    domain = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("class_idx"), F.col("p_partkey").cast("string").alias("class"),
                                                    F.lit(True).alias("in_train"))
    return fx.table(spark, sf_dir, "lineitem").select(key.alias("actual"), rule.alias("predicted")), domain


@register("domain_table_strays", "E2", f"""
WITH p AS ({_PART_PREDICTIONS_SQL})
SELECT actual, predicted, CAST(count(*) AS BIGINT) AS n FROM p
WHERE actual NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) OR predicted NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)
GROUP BY ALL
""")
def q_domain_table_strays(spark, sf_dir):
    pred, domain = _part_predictions(spark, sf_dir)
    return ev.table_strays(ev.confusion_counts(pred), domain)


@register("domain_table_metrics", "E1 E2 E3 E5 E7 E9", f"""
WITH p AS (SELECT * FROM ({_PART_PREDICTIONS_SQL}) x WHERE predicted IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)),
d AS (SELECT CAST(p_partkey AS INTEGER) AS class_idx, CAST(p_partkey AS VARCHAR) AS class FROM part),
s AS (SELECT actual AS class, count(*) AS support, count(*) FILTER (WHERE actual = predicted) AS tp FROM p GROUP BY 1),
q AS (SELECT predicted AS class, count(*) AS predicted_total FROM p GROUP BY 1),
k AS (SELECT d.class_idx, d.class, coalesce(support, 0) AS support, coalesce(predicted_total, 0) AS predicted_total, coalesce(tp, 0) AS tp
      FROM d LEFT JOIN s USING (class) LEFT JOIN q USING (class)),
r AS (SELECT k.*, CASE WHEN predicted_total = 0 THEN 0.0 ELSE tp / predicted_total END AS precision,
             CASE WHEN support = 0 THEN NULL ELSE tp / support END AS recall, support / sum(support) OVER () AS class_ratio FROM k)
SELECT class_idx, class, CAST(support AS BIGINT) AS support, CAST(predicted_total AS BIGINT) AS predicted_total, CAST(tp AS BIGINT) AS tp,
       round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall,
       round(CAST(CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END AS DOUBLE), 6) AS f1,
       round(CAST(class_ratio AS DOUBLE), 6) AS class_ratio
FROM r
""")
def q_domain_table_metrics(spark, sf_dir):
    """Per-class metrics of every part, from the sparse matrix and the domain table; strays are set apart."""
    pred, domain = _part_predictions(spark, sf_dir)
    cells = ev.indexed_counts(ev.confusion_counts(pred), domain, strict=False)
    return surface(ev.per_class_metrics(ev.with_every_class(cells, domain)))


# --- S1 / C3: counted rejects ----------------------------------------------------------------

@register("counted_rejects", "S1 C1 C3", """
WITH l AS (SELECT CASE WHEN l_quantity = 50 THEN 'malformed' WHEN l_quantity = 49 THEN 'null: dst_bytes'
                       WHEN l_quantity = 48 THEN 'illegal service' END AS reason FROM lineitem)
SELECT coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS counted FROM l GROUP BY 1
""")
def q_counted_rejects(spark, sf_dir):
    """The whole lineitem table as raw connection lines, some of them cut short, without a value or with an illegal service: one
    pass keeps every line and counts it, by reason. ``lines`` is read back, ``counted`` is observed in the pass."""
    li = fx.table(spark, sf_dir, "lineitem")
    names, q = [f.name for f in src.connection_schema().fields], F.col("l_quantity")
    recs = fx.connection_fields(li).withColumn("service", F.when(q == 48, F.lit("icmp")).otherwise(F.col("service"))).withColumn(
        "dst_bytes", F.when(q != 49, F.col("dst_bytes")))
    whole = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    path = scratch_path(spark, "raw-lines")
    recs.select(F.when(q == 50, F.substring_index(whole, ",", 20)).otherwise(whole).alias("value")).write.text(path)
    out = scratch_path(spark, "staged")
    seen = src.stage_records(spark, path, out, illegal={"illegal service": clean.illegal_service_rule()}, clean=clean.strip_label_suffix)
    kept = src.staged_records(spark, out).groupBy().agg(F.count(F.lit(1)).alias("lines")).select(F.lit("kept").alias("reason"), "lines")
    bad = src.staged_rejects(spark, out).groupBy(F.col(src.REASON).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))
    kind = F.when(F.col("reason").startswith("null: "), "null").otherwise(F.col("reason"))
    number = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in seen.items()]).cast("long")
    return kept.filter("lines > 0").union(bad).withColumn("counted", number)


# --- C2: incremental de-duplication -----------------------------------------------------------

@register("incremental_dedup", "C2", """
WITH b AS (SELECT CASE WHEN l_linenumber <= 4 THEN 0 WHEN l_linenumber <= 5 THEN 1 ELSE 2 END AS batch,
                  l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem),
f AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, min(batch) AS batch FROM b GROUP BY ALL)
SELECT batch, CAST(count(*) AS BIGINT) AS new_records, round(sum(l_quantity), 2) AS quantity FROM f GROUP BY batch
""")
def q_incremental_dedup(spark, sf_dir):
    """The table's records in three batches against the set that the batches before have built."""
    li = fx.table(spark, sf_dir, "lineitem")
    cols = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
    kept = incremental.CleanedSet(spark, scratch_path(spark, "cleaned"))
    out = None
    for i, rule in enumerate(("l_linenumber <= 4", "l_linenumber = 5", "l_linenumber > 5")):
        part = kept.add(li.filter(rule).select(*cols)).agg(F.count(F.lit(1)).alias("new_records"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
        part = part.filter("new_records > 0").select(F.lit(i).alias("batch"), "*")
        out = part if out is None else out.union(part)
    return out


# --- S1 / C2 / R1: bucketed staging ---------------------------------------------------------------

@register("staged_class_distribution", "S1 R1", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT (l_linestatus, l_quantity, l_discount)) AS BIGINT) AS dedup_count
FROM lineitem GROUP BY l_returnflag
""")
def q_staged_class_distribution(spark, sf_dir):
    """R1 from records staged once in buckets."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return staging.staged_class_distribution(staging.stage_bucketed(li, 8), "l_returnflag")


@register("staged_records_in_both", "S1 C2 R6", """
WITH a AS (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem WHERE l_linenumber <= 5),
b AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, count(*) AS n FROM lineitem WHERE l_linenumber > 5 GROUP BY ALL)
SELECT a.l_returnflag IS NOT NULL AS in_train, CAST(count(*) AS BIGINT) AS records, CAST(sum(b.n) AS BIGINT) AS total_rows
FROM b LEFT JOIN a USING (l_returnflag, l_linestatus, l_quantity, l_discount, l_tax) GROUP BY 1
""")
def q_staged_records_in_both(spark, sf_dir):
    """Test records that training has, and those it has not: two staged sets compared bucket by bucket."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    train, test = (staging.stage_bucketed(li.filter(rule).drop("l_linenumber"), 8) for rule in ("l_linenumber <= 5", "l_linenumber > 5"))
    parts = [staging.records_in(test, train, how).agg(F.count(F.lit(1)).alias("records"), F.sum(rc.WEIGHT).alias("total_rows")).filter(
        "records > 0").select(F.lit(how == "left_semi").alias("in_train"), "*") for how in ("left_semi", "left_anti")]
    return parts[0].union(parts[1])

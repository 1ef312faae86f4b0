"""Registered queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame``
plus, where SQL can express it, an independent DuckDB oracle over the same tables.

Query surface rules (shared by both sides): doubles rounded to 6 places, NaN
emitted as NULL, counts BIGINT, every column aliased."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forestlens.operators import clean, evaluate as ev, reports, split as sp
from forestlens.plans import fixtures as fx
from forestlens.session import scratch_path
from forestlens.sources import csv as src, sinks

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def surface(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and turn NaN into NULL on the query surface."""
    out = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(f"CASE WHEN isnan({q}) THEN CAST(NULL AS DOUBLE) ELSE round({q}, {digits}) END AS {q}")
        else:
            out.append(q)
    return df.selectExpr(*out)


def _sql_round(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


# ---------------------------------------------------------------------------
# Evaluation (E1-E10, S2, S3) on rule predictions over the whole lineitem table
# ---------------------------------------------------------------------------

_DOM = fx.RULE_DOMAIN
_DENSE_SQL = f"""
WITH p AS ({fx.RULE_PREDICTIONS_SQL}),
c AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY actual, predicted),
d AS (SELECT * FROM {fx.domain_values_sql(_DOM)})
SELECT a.class_idx AS actual_idx, a.class AS actual, b.class_idx AS predicted_idx, b.class AS predicted,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM d a CROSS JOIN d b LEFT JOIN c ON c.actual = a.class AND c.predicted = b.class
"""


def _rule_matrix(spark, sf_dir, keys=None):
    pred = fx.rule_predictions(fx.table(spark, sf_dir, "lineitem"))
    return ev.confusion_matrix(pred, _DOM, keys=keys)


@register("confusion_matrix", "E1 E2", _DENSE_SQL)
def q_confusion_matrix(spark, sf_dir):
    return _rule_matrix(spark, sf_dir)


def _per_class_sql(dense_sql: str, domain: ev.ClassDomain) -> str:
    return f"""
WITH m AS ({dense_sql}),
s AS (
  SELECT d.class_idx, d.class,
         (SELECT sum(n) FROM m WHERE m.actual = d.class) AS support,
         (SELECT sum(n) FROM m WHERE m.predicted = d.class) AS predicted_total,
         (SELECT sum(n) FROM m WHERE m.actual = d.class AND m.predicted = d.class) AS tp
  FROM {fx.domain_values_sql(domain)}),
t AS (SELECT sum(support) AS total FROM s),
r AS (
  SELECT s.*, CASE WHEN predicted_total = 0 THEN 0.0 ELSE tp / predicted_total END AS precision,
         CASE WHEN support = 0 THEN NULL ELSE tp / support END AS recall,
         CASE WHEN t.total > 0 THEN support / t.total END AS class_ratio
  FROM s, t)
SELECT class_idx, class, CAST(support AS BIGINT) AS support, CAST(predicted_total AS BIGINT) AS predicted_total,
       CAST(tp AS BIGINT) AS tp, {_sql_round('precision')} AS precision, {_sql_round('recall')} AS recall,
       {_sql_round('CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END')}
         AS f1,
       {_sql_round('class_ratio')} AS class_ratio
FROM r
"""


_PER_CLASS_SQL = _per_class_sql(_DENSE_SQL, _DOM)


@register("per_class_metrics", "E3 E5 E7 E9", _PER_CLASS_SQL)
def q_per_class_metrics(spark, sf_dir):
    return surface(ev.per_class_metrics(_rule_matrix(spark, sf_dir)))


_OVERALL_SQL = f"""
WITH p AS ({fx.RULE_PREDICTIONS_SQL}),
sup AS (SELECT actual AS class, count(*) AS support FROM p GROUP BY actual),
prd AS (SELECT predicted AS class, count(*) AS predicted_total,
               count(*) FILTER (WHERE actual = predicted) AS tp FROM p GROUP BY predicted),
tot AS (SELECT count(*) AS total FROM p),
w AS (
  SELECT sum(CASE WHEN prd.predicted_total > 0 THEN prd.tp / prd.predicted_total ELSE 0 END
             * sup.support / tot.total) AS precision,
         sum(coalesce(prd.tp, 0) / tot.total) AS recall
  FROM sup LEFT JOIN prd USING (class), tot)
SELECT {_sql_round('precision')} AS precision, {_sql_round('recall')} AS recall,
       {_sql_round('2 * precision * recall / (precision + recall)')} AS f1
FROM w
"""


@register("overall_metrics", "E4 E6 E8", _OVERALL_SQL)
def q_overall_metrics(spark, sf_dir):
    pred = fx.rule_predictions(fx.table(spark, sf_dir, "lineitem"))
    return surface(ev.metrics_table(pred, _DOM).drop("split"))


_BY_SPLIT_SQL = f"""
WITH p AS ({fx.RULE_PREDICTIONS_SQL}),
sup AS (SELECT split, actual AS class, count(*) AS support FROM p GROUP BY split, actual),
prd AS (SELECT split, predicted AS class, count(*) AS predicted_total,
               count(*) FILTER (WHERE actual = predicted) AS tp FROM p GROUP BY split, predicted),
tot AS (SELECT split, count(*) AS total FROM p GROUP BY split),
w AS (
  SELECT sup.split,
         sum(CASE WHEN prd.predicted_total > 0 THEN prd.tp / prd.predicted_total ELSE 0 END
             * sup.support / tot.total) AS precision,
         sum(coalesce(prd.tp, 0) / tot.total) AS recall
  FROM sup LEFT JOIN prd USING (split, class) JOIN tot USING (split)
  GROUP BY sup.split)
SELECT split, {_sql_round('precision')} AS precision, {_sql_round('recall')} AS recall,
       {_sql_round('2 * precision * recall / (precision + recall)')} AS f1
FROM w
"""


@register("metrics_by_split", "E10 S2", _BY_SPLIT_SQL)
def q_metrics_by_split(spark, sf_dir):
    """E10 in one job for all splits, then written in the metrics layout (S2) and read back."""
    pred = fx.rule_predictions(fx.table(spark, sf_dir, "lineitem"))
    metrics = ev.metrics_table(pred, _DOM, split="split")
    path = sinks.write_metrics(metrics, scratch_path(spark, "metrics"))
    back = spark.read.option("header", True).csv(path)
    return surface(back.select(
        F.col("`Split #`").cast("int").alias("split"), F.col("Precision").cast("double").alias("precision"),
        F.col("Recall").cast("double").alias("recall"), F.col("F1").cast("double").alias("f1")))


_WIDE_SQL = f"""
WITH m AS ({_DENSE_SQL})
SELECT actual AS "A\\P", {", ".join(f"CAST(sum(CASE WHEN predicted = '{c}' THEN n ELSE 0 END) AS DOUBLE) AS {c}" for c in _DOM.classes)}
FROM m GROUP BY actual
"""


@register("matrix_csv_layout", "S3", _WIDE_SQL)
def q_matrix_csv_layout(spark, sf_dir):
    """S3: the matrix written as ``A\\P,<classes>`` CSV, read back as written."""
    path = sinks.write_confusion_matrix(_rule_matrix(spark, sf_dir), _DOM, scratch_path(spark, "matrix"))
    schema = T.StructType([T.StructField(sinks.MATRIX_CORNER, T.StringType())]
                          + [T.StructField(c, T.DoubleType()) for c in _DOM.classes])
    return spark.read.schema(schema).option("header", True).option("escape", "\u0000").csv(path)


_HEATMAP_SQL = f"""
WITH m AS ({_DENSE_SQL}), d AS (SELECT * FROM {fx.domain_values_sql(_DOM)})
SELECT m.predicted_idx AS x, m.actual_idx AS y, m.actual, m.predicted, m.n,
       {_sql_round('CASE WHEN n > 0 THEN greatest(least(n, 1000.0) / 1000.0, 0.05) ELSE 0.0 END')} AS opacity,
       da.in_train AS actual_in_train, dp.in_train AS predicted_in_train
FROM m JOIN d da ON da.class = m.actual JOIN d dp ON dp.class = m.predicted
"""


@register("heatmap_cells", "R7 S8", _HEATMAP_SQL)
def q_heatmap_cells(spark, sf_dir):
    """S3 write -> S8 read back into long form -> R7 cell table."""
    path = sinks.write_confusion_matrix(_rule_matrix(spark, sf_dir), _DOM, scratch_path(spark, "heatmap"))
    return surface(reports.heatmap_cells(src.read_matrix_csv(spark, path), _DOM))


# ---------------------------------------------------------------------------
# Attribution reports
# ---------------------------------------------------------------------------

_ATTR_SQL = f"""
WITH t AS ({fx.BINARY_TEST_SQL}), tr AS ({fx.BINARY_TRAIN_SQL}),
a AS (SELECT attack_type, count(*) FILTER (WHERE predicted_bin = 'normal') AS labeled_normal,
             count(*) FILTER (WHERE predicted_bin = 'anomaly') AS labeled_anomaly
      FROM t GROUP BY attack_type)
SELECT a.attack_type, CAST(labeled_normal AS BIGINT) AS labeled_normal,
       CAST(labeled_anomaly AS BIGINT) AS labeled_anomaly,
       EXISTS (SELECT 1 FROM tr WHERE tr.attack_type = a.attack_type) AS in_train
FROM a WHERE attack_type <> 'normal'
"""


def _attribution(spark, sf_dir):
    train, test = fx.binary_rule_predictions(fx.table(spark, sf_dir, "lineitem"))
    return reports.label_attribution(test, "attack_type", "predicted_bin", train=train)


@register("false_normal_attribution", "R3", _ATTR_SQL + " AND labeled_normal >= 20")
def q_false_normal(spark, sf_dir):
    return reports.false_normal_attribution(_attribution(spark, sf_dir), min_errors=20)


@register("correct_anomaly_attribution", "R4", _ATTR_SQL + " AND labeled_anomaly >= 100")
def q_correct_anomaly(spark, sf_dir):
    return reports.correct_anomaly_attribution(_attribution(spark, sf_dir), min_correct=100)


@register("excluded_tail", "R5", f"""
WITH x AS ({_ATTR_SQL} AND labeled_normal > 0 AND labeled_normal < 20)
SELECT CAST(count(*) AS BIGINT) AS labels, CAST(coalesce(sum(labeled_normal), 0) AS BIGINT) AS instances FROM x
""")
def q_excluded_tail(spark, sf_dir):
    return reports.excluded_tail(_attribution(spark, sf_dir), min_errors=20)


@register("unseen_class_rows", "R6", f"""
WITH te AS ({fx.FOREST_TEST_SQL}), tr AS ({fx.FOREST_TRAIN_SQL})
SELECT CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.attack_type = te.attack_type)) AS BIGINT)
         AS unseen_rows,
       CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(DISTINCT attack_type) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.attack_type = te.attack_type))
            AS BIGINT) AS unseen_classes
FROM te
""")
def q_unseen_class_rows(spark, sf_dir):
    train, test = fx.forest_frames(fx.table(spark, sf_dir, "lineitem"))
    return reports.unseen_class_rows(train, test, "attack_type")


# ---------------------------------------------------------------------------
# Distribution reports (R1, R2) and cleaning (C1-C4, P1-P3) on events
# ---------------------------------------------------------------------------

@register("class_distribution", "R1", """
SELECT event_type, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT user_id) AS BIGINT) AS dedup_count
FROM events GROUP BY event_type
""")
def q_class_distribution(spark, sf_dir):
    ev_ = fx.table(spark, sf_dir, "events").select("event_type", "user_id")
    return reports.class_distribution(ev_, "event_type")


def _category_case(col: str) -> str:
    parts = " ".join(f"WHEN {col} IN ({', '.join(repr(m) for m in ms)}) THEN '{cat}'"
                     for cat, ms in fx.EVENT_CATEGORIES.items())
    return f"CASE {parts} ELSE 'unknown' END"


@register("category_rollup", "R2", f"""
WITH c AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS dn FROM events GROUP BY event_type),
k AS (SELECT {_category_case('event_type')} AS category, n, dn FROM c)
SELECT CASE WHEN GROUPING(category) = 1 THEN 'TOTAL' ELSE category END AS category,
       CAST(sum(n) AS BIGINT) AS count, CAST(sum(dn) AS BIGINT) AS dedup_count
FROM k GROUP BY ROLLUP (category)
""")
def q_category_rollup(spark, sf_dir):
    ev_ = fx.table(spark, sf_dir, "events").select("event_type", "user_id")
    return reports.category_rollup(ev_, "event_type", fx.EVENT_CATEGORIES)


@register("dedup_rows", "C2", "SELECT DISTINCT event_type, user_id FROM events")
def q_dedup_rows(spark, sf_dir):
    return clean.dedup_rows(fx.table(spark, sf_dir, "events").select("event_type", "user_id"))


@register("strip_label_suffix", "C1", r"""
SELECT event_id, label_raw, regexp_replace(label_raw, '\.$', '') AS label
FROM (SELECT event_id, CASE WHEN value > 50 THEN event_type || '.' ELSE event_type END AS label_raw FROM events) e
""")
def q_strip_label_suffix(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    raw = e.select("event_id", F.when(F.col("value") > 50, F.concat("event_type", F.lit("."))).otherwise(
        F.col("event_type")).alias("label_raw"))
    return clean.strip_label_suffix(raw.withColumn("label", F.col("label_raw")), "label")


@register("quarantine", "C3", """
SELECT event_type, CASE WHEN event_type = 'error' AND value > 100 THEN 'rejected' ELSE 'kept' END AS status,
       CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS value_sum
FROM events GROUP BY ALL
""")
def q_quarantine(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_type", "value")
    tagged = clean.tag_by_rule(e, (F.col("event_type") == "error") & (F.col("value") > 100))
    return surface(tagged.groupBy("event_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))


@register("binarize_label", "C4 P1 P2 P3", """
SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN 'view' ELSE 'anomaly' END AS event_type_bin
FROM events
""")
def q_binarize_label(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    out = clean.with_binary_label(e, "event_type", "event_type_bin", normal="view")
    return clean.select_labels(out, "event_id", "event_type", "event_type_bin")


# ---------------------------------------------------------------------------
# Union, split, CSV round trip
# ---------------------------------------------------------------------------

@register("union_all_vocab", "U1", """
SELECT p_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT p_type FROM part WHERE p_size <= 25 UNION ALL SELECT p_type FROM part WHERE p_size > 25) u
GROUP BY p_type
""")
def q_union_all_vocab(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    u = sp.union_labels(part.filter(F.col("p_size") <= 25), part.filter(F.col("p_size") > 25), "p_type")
    return u.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@register("split_invariants", "U2 U3", """
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) AS BIGINT) AS covered_rows,
       CAST(0 AS BIGINT) AS overlap_rows, TRUE AS ratio_within_2pct
FROM lineitem
""")
def q_split_invariants(spark, sf_dir):
    """How many of the table's records the two splits hold together, and how many they hold too
    often, in one lazy aggregate. Records are identified by table columns (which
    repeat, so counts are compared); the frame is dealt by value, so both splits see the same rows."""
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    train, test = sp.random_split(sp.fixed_partitions(rows, sp.partitions_for(rows)), (0.8, 0.2), 42)

    def tagged(df, name):
        return df.select(*rows.columns, *[F.lit(int(name == n)).alias(n) for n in ("in_table", "in_train", "in_test")])

    every = tagged(rows, "in_table").union(tagged(train, "in_train")).union(tagged(test, "in_test"))
    counts = every.groupBy(*rows.columns).agg(
        F.sum("in_table").alias("base"), F.sum("in_train").alias("train"), F.sum(F.col("in_train") + F.col("in_test")).alias("both"))
    zero = F.lit(0).cast("long")
    total = F.coalesce(F.sum("base"), zero)
    return counts.agg(
        total.alias("total_rows"), F.coalesce(F.sum(F.least("both", "base")), zero).alias("covered_rows"),
        F.coalesce(F.sum(F.greatest(F.col("both") - F.col("base"), zero)), zero).alias("overlap_rows"),
        F.coalesce(F.abs(F.sum("train") / total - 0.8) <= 0.02, F.lit(True)).alias("ratio_within_2pct"))


_LI_CSV_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
])


@register("csv_roundtrip", "S1 S4", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 6) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc,
       round(sum(l_tax), 6) AS sum_tax, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders,
       CAST(sum(l_linenumber) AS BIGINT) AS sum_line
FROM lineitem GROUP BY ALL
""")
def q_csv_roundtrip(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(*_LI_CSV_SCHEMA.fieldNames())
    path = sinks.write_records(li, scratch_path(spark, "lineitem-csv"))
    back = src.read_typed_csv(spark, path, _LI_CSV_SCHEMA, mode="FAILFAST")
    return surface(back.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.avg("l_discount").alias("avg_disc"),
        F.sum("l_tax").alias("sum_tax"), F.countDistinct("l_orderkey").alias("n_orders"),
        F.sum("l_linenumber").cast("long").alias("sum_line")))


# ---------------------------------------------------------------------------
# Encodings (F1-F6) on part / lineitem
# ---------------------------------------------------------------------------

def _freq_index_sql(col: str, src: str) -> str:
    return (f"SELECT {col} AS v, row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 AS idx "
            f"FROM {src} GROUP BY {col}")


@register("string_index", "F1 F4 F5", f"""
WITH u AS (SELECT p_type FROM part WHERE p_size <= 25 UNION ALL SELECT p_type FROM part WHERE p_size > 25),
i AS ({_freq_index_sql('p_type', 'u')})
SELECT p.p_partkey, p.p_type, CAST(i.idx AS BIGINT) AS p_type_index FROM part p JOIN i ON i.v = p.p_type
""")
def q_string_index(spark, sf_dir):
    """Label index fitted over train UNION ALL test slices (F5), applied to all rows."""
    from forestlens.operators import model as mdl
    part = fx.table(spark, sf_dir, "part")
    lm = mdl.fit_label_index(part.filter(F.col("p_size") <= 25), "p_type", "p_type_index",
                             test=part.filter(F.col("p_size") > 25))
    return lm.transform(part.select("p_partkey", "p_type")).select(
        "p_partkey", "p_type", F.col("p_type_index").cast("long").alias("p_type_index"))


@register("one_hot", "F2 F3", f"""
WITH t AS ({_freq_index_sql('p_type', 'part')}), b AS ({_freq_index_sql('p_brand', 'part')}),
kt AS (SELECT count(*) AS k FROM t), kb AS (SELECT count(*) AS k FROM b)
SELECT p.p_partkey,
       CAST(CASE WHEN t.idx < kt.k - 1 THEN t.idx END AS INTEGER) AS p_type_slot,
       CAST(CASE WHEN b.idx < kb.k - 1 THEN b.idx END AS INTEGER) AS p_brand_slot,
       CAST(kt.k - 1 AS INTEGER) AS p_type_size, CAST(kb.k - 1 AS INTEGER) AS p_brand_size
FROM part p JOIN t ON t.v = p.p_type JOIN b ON b.v = p.p_brand, kt, kb
""")
def q_one_hot(spark, sf_dir):
    from forestlens.operators import features as fe
    part = fx.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    enc = fe.one_hot_pipeline(["p_type", "p_brand"]).fit(part).transform(part)
    out = [F.col("p_partkey")]
    for c in ("p_type", "p_brand"):
        arr = fe.vector_as_array(c + fe.VEC_SUFFIX)
        pos = F.array_position(arr, 1.0)
        out += [F.when(pos > 0, pos - 1).cast("int").alias(f"{c}_slot"), F.size(arr).alias(f"{c}_size")]
    return enc.select(*out)


_ASSEMBLE_SQL = f"""
WITH rf AS ({_freq_index_sql('l_returnflag', 'lineitem')}), ls AS ({_freq_index_sql('l_linestatus', 'lineitem')}),
kr AS (SELECT count(*) AS k FROM rf), kl AS (SELECT count(*) AS k FROM ls),
s AS (
  SELECT 0 AS slot, sum(l_quantity) AS total FROM lineitem
  UNION ALL SELECT 1 + rf.idx, count(*) FROM lineitem JOIN rf ON l_returnflag = rf.v
            WHERE rf.idx < (SELECT k FROM kr) - 1 GROUP BY rf.idx
  UNION ALL SELECT (SELECT k FROM kr), sum(l_discount) FROM lineitem
  UNION ALL SELECT (SELECT k FROM kr) + 1 + ls.idx, count(*) FROM lineitem JOIN ls ON l_linestatus = ls.v
            WHERE ls.idx < (SELECT k FROM kl) - 1 GROUP BY ls.idx
  UNION ALL SELECT (SELECT k FROM kr) + (SELECT k FROM kl), sum(l_tax) FROM lineitem)
SELECT CAST(slot AS INTEGER) AS slot, {_sql_round('total')} AS total FROM s
"""


@register("assemble_features", "F6", _ASSEMBLE_SQL)
def q_assemble_features(spark, sf_dir):
    from pyspark.ml import Pipeline
    from forestlens.operators import features as fe
    li = fx.table(spark, sf_dir, "lineitem").select(*(fx.FOREST_CATEGORICAL + fx.FOREST_NUMERIC))
    order = ["l_quantity", "l_returnflag_vec", "l_discount", "l_linestatus_vec", "l_tax"]
    pipe = Pipeline(stages=[fe.one_hot_pipeline(fx.FOREST_CATEGORICAL), fe.assembler(order)])
    return surface(fe.vector_slot_sums(pipe.fit(li).transform(li)))


# ---------------------------------------------------------------------------
# Random-forest jobs (X1-X4, F7-F11, S4-S7) on the separable lineitem fixture
# ---------------------------------------------------------------------------

FOREST_TREES, FOREST_DEPTH = 20, 10


def _dense_sql(pred_sql: str, domain: ev.ClassDomain) -> str:
    return f"""
WITH p AS ({pred_sql}),
c AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY actual, predicted),
d AS (SELECT * FROM {fx.domain_values_sql(domain)})
SELECT a.class_idx AS actual_idx, a.class AS actual, b.class_idx AS predicted_idx, b.class AS predicted,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM d a CROSS JOIN d b LEFT JOIN c ON c.actual = a.class AND c.predicted = b.class
"""


def _forest(spark, sf_dir, preset: str):
    """A job of its own for every call: each forest query includes its fit."""
    from forestlens.plans import experiments as xp
    li = fx.table(spark, sf_dir, "lineitem")
    common = dict(categorical=fx.FOREST_CATEGORICAL, features=fx.FOREST_FEATURES)
    if preset == "x1":
        r = xp.x1_multiclass_split(fx.forest_all_seen(li), FOREST_TREES, FOREST_DEPTH,
                                   classes=["normal", "neptune", "smurf"], **common)
    elif preset == "x2":
        train, test = fx.forest_frames(li)
        r = xp.x2_unseen_classes(train, test, FOREST_TREES, FOREST_DEPTH, classes=fx.FOREST_DOMAIN.classes,
                                 train_classes=fx.FOREST_DOMAIN.train_classes, **common)
    elif preset == "x3":
        train, test = fx.forest_frames(li)
        r = xp.x3_binary(train, test, FOREST_TREES, FOREST_DEPTH, **common)
    elif preset == "x4":
        train, test = fx.forest_frames(li)
        r = xp.x4_binary_on_multiclass(clean.binarize_dataset(train, "attack_type"), test,
                                       FOREST_TREES, FOREST_DEPTH, **common)
    else:
        raise KeyError(preset)
    return r


_X2_PRED_SQL = f"""
SELECT attack_type AS actual, CASE WHEN attack_type = 'novel' THEN 'smurf' ELSE attack_type END AS predicted
FROM ({fx.FOREST_TEST_SQL}) te
"""


@register("forest_unseen_classes", "X2 F5 F7 F8 F9 F10 F11", _dense_sql(_X2_PRED_SQL, fx.FOREST_DOMAIN))
def q_forest_unseen_classes(spark, sf_dir):
    r = _forest(spark, sf_dir, "x2")
    return ev.confusion_matrix(r.predictions, r.domain(), r.actual, "predicted_label")


@register("forest_multiclass_split", "X1 F4 U2 U3", """
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(0 AS BIGINT) AS errors, TRUE AS split_ratio_within_2pct,
       CAST(1.0 AS DOUBLE) AS precision, CAST(1.0 AS DOUBLE) AS recall, CAST(1.0 AS DOUBLE) AS f1
FROM lineitem
""")
def q_forest_multiclass_split(spark, sf_dir):
    r = _forest(spark, sf_dir, "x1")
    r.release()         # the result is lazy: records and split follow from the table again
    zero, key, n = F.lit(0).cast("long"), F.lit(0).alias("key"), F.col(r.weight)
    part = r.train_records.select(F.lit("train").alias("part"), F.lit(False).alias("wrong"), n.alias("n")).union(
        r.scored.select(F.lit("test"), F.col(r.actual) != F.col("predicted_label"), n))
    counts = part.agg(F.coalesce(F.sum("n"), zero).alias("total_rows"), F.coalesce(F.sum(F.when(F.col("wrong"), F.col("n"))), zero).alias("errors"),
                      F.sum(F.when(F.col("part") == "train", F.col("n"))).alias("train")).select(key, "*")
    overall = r.evaluation(checkpoint=False).overall.select(key, "precision", "recall", "f1")
    ratio = F.coalesce(F.abs(F.col("train") / F.col("total_rows") - 0.8) <= 0.02, F.lit(True))
    return surface(counts.join(overall, "key", "left").select(
        "total_rows", "errors", ratio.alias("split_ratio_within_2pct"), "precision", "recall", "f1"))


@register("forest_binary_triplets", "X3 S5 P1 P2", f"""
WITH te AS ({fx.FOREST_TEST_SQL})
SELECT attack_type, CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS attack_type_bin,
       CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS predicted_label,
       CAST(count(*) AS BIGINT) AS n
FROM te GROUP BY ALL
""")
def q_forest_binary_triplets(spark, sf_dir):
    r = _forest(spark, sf_dir, "x3")
    path = sinks.write_triplets(r.predictions, scratch_path(spark, "triplets"), "attack_type", "attack_type_bin",
                                "predicted_label")
    back = src.read_typed_csv(spark, path, T.StructType(
        [T.StructField(c, T.StringType()) for c in ("attack_type", "attack_type_bin", "predicted_label")]))
    return back.groupBy("attack_type", "attack_type_bin", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


@register("forest_binary_on_multiclass", "X4 S4 C4", f"""
WITH te AS ({fx.FOREST_TEST_SQL}), tr AS ({fx.FOREST_TRAIN_SQL}),
v AS (SELECT count(DISTINCT l) AS k FROM (
        SELECT CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS l FROM tr
        UNION ALL SELECT attack_type FROM te) u)
SELECT attack_type, CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS predicted_label,
       CAST(count(*) AS BIGINT) AS n, CAST(max(v.k) AS INTEGER) AS vocabulary_size
FROM te, v GROUP BY ALL
""")
def q_forest_binary_on_multiclass(spark, sf_dir):
    r = _forest(spark, sf_dir, "x4")
    path = sinks.write_pairs(r.predictions, scratch_path(spark, "pairs"), "attack_type", "predicted_label")
    back = src.read_typed_csv(spark, path, T.StructType(
        [T.StructField(c, T.StringType()) for c in ("attack_type", "predicted_label")]))
    return back.groupBy("attack_type", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.lit(len(r.labels)).cast("int").alias("vocabulary_size"))


@register("model_reload", "S6 S7", _dense_sql(_X2_PRED_SQL, fx.FOREST_DOMAIN))
def q_model_reload(spark, sf_dir):
    """Save the pipeline spec and the fitted model, load both, rescore the test set."""
    from forestlens.operators import model as mdl
    r = _forest(spark, sf_dir, "x2")
    out = scratch_path(spark, "model")
    spec = mdl.build_pipeline(fx.FOREST_CATEGORICAL, fx.FOREST_FEATURES,
                              mdl.forest(FOREST_TREES, FOREST_DEPTH, "attack_type_index"), labels=r.labels)
    sinks.save_pipeline(spec, out)
    sinks.save_model(r.model, out)
    if len(sinks.load_pipeline(out).getStages()) != len(spec.getStages()):
        raise RuntimeError("reloaded pipeline spec differs")
    loaded = sinks.load_model(out)
    return ev.confusion_matrix(mdl.score(loaded, r.test), r.domain(), r.actual, "predicted_label")


@register("forest_unseen_metrics", "X2 E3 E5 E7 E9", _per_class_sql(_dense_sql(_X2_PRED_SQL, fx.FOREST_DOMAIN),
                                                                    fx.FOREST_DOMAIN))
def q_forest_unseen_metrics(spark, sf_dir):
    """Per-class metrics of the forest's predictions (the test-only class has
    recall 0 and is never predicted; the class it falls to loses precision)."""
    r = _forest(spark, sf_dir, "x2")
    return surface(ev.per_class_metrics(ev.confusion_matrix(r.predictions, r.domain(), r.actual, "predicted_label")))


# ---------------------------------------------------------------------------
# De-duplication of whole texts (C2, R1) on documents
# ---------------------------------------------------------------------------

@register("dedup_documents", "C2", "SELECT DISTINCT lang, text FROM documents")
def q_dedup_documents(spark, sf_dir):
    """Exact de-duplication on the whole text (no prefix, no hashing shortcut)."""
    return clean.dedup_rows(fx.table(spark, sf_dir, "documents").select("lang", "text"))


@register("document_distribution", "R1 C2", """
SELECT lang, CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS dedup_count
FROM (SELECT lang, text, count(*) AS n FROM documents GROUP BY lang, text) d
GROUP BY lang
""")
def q_document_distribution(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("lang", "text")
    return reports.class_distribution(docs, "lang")


# ---------------------------------------------------------------------------
# Streaming: running confusion counts over a record stream (F11/E1 incrementally)
# ---------------------------------------------------------------------------

@register("stream_confusion_counts", "E1 streaming", """
WITH p AS (""" + fx.RULE_PREDICTIONS_SQL + """)
SELECT actual, predicted, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY actual, predicted
""")
def q_stream_confusion_counts(spark, sf_dir):
    """The lineitem table (a file or a folder of files) read as a stream; the counts live in the
    state store of the query's checkpoint and are read from there after all available input is processed."""
    from forestlens.streaming import scoring
    schema = fx.table(spark, sf_dir, "lineitem").schema
    stream = scoring.read_record_stream(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", schema)
    state = scratch_path(spark, "running-counts")
    q = scoring.start_running_matrix(fx.rule_predictions(stream), "actual", "predicted", state, trigger={"availableNow": True})
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return scoring.read_state_counts(spark, state)


# ---------------------------------------------------------------------------
# The study's job path end to end: 42-field headerless CSV -> clean -> X2
# ---------------------------------------------------------------------------

_RECORD_PRED_SQL = f"""
SELECT attack_type AS actual, CASE WHEN attack_type = 'mailbomb' THEN 'smurf' ELSE attack_type END AS predicted
FROM ({fx.RECORD_TEST_SQL}) te
"""


@register("connection_records_job", "S1 C1 C2 F1-F11 X2", _dense_sql(_RECORD_PRED_SQL, fx.RECORD_DOMAIN))
def q_connection_records_job(spark, sf_dir):
    """Records derived from the whole lineitem table are written as raw
    headerless CSV, read back with the 42-field schema, cleaned (label period
    stripped, training records de-duplicated) and run through the X2 job with
    the default 40-feature order; the result is the dense matrix."""
    from forestlens.plans import experiments as xp
    train_raw, test_raw = fx.connection_records(fx.table(spark, sf_dir, "lineitem"))
    root = scratch_path(spark, "records")
    sinks.write_records(train_raw, f"{root}/train")
    sinks.write_records(test_raw, f"{root}/test")
    train = clean.dedup_rows(clean.strip_label_suffix(src.read_connections(spark, f"{root}/train")))
    test = clean.strip_label_suffix(src.read_connections(spark, f"{root}/test"))
    r = xp.x2_unseen_classes(train, test, FOREST_TREES, FOREST_DEPTH, classes=fx.RECORD_DOMAIN.classes,
                             train_classes=fx.RECORD_DOMAIN.train_classes)
    return ev.confusion_matrix(r.predictions, r.domain(), r.actual, "predicted_label")


# ---------------------------------------------------------------------------
# One dense matrix per split in one job (E1 with keys, E10's matrices)
# ---------------------------------------------------------------------------

@register("confusion_matrix_by_split", "E1 E10", f"""
WITH p AS ({fx.RULE_PREDICTIONS_SQL}),
c AS (SELECT split, actual, predicted, count(*) AS n FROM p GROUP BY split, actual, predicted),
s AS (SELECT DISTINCT split FROM p),
d AS (SELECT * FROM {fx.domain_values_sql(_DOM)})
SELECT s.split, a.class_idx AS actual_idx, a.class AS actual, b.class_idx AS predicted_idx, b.class AS predicted,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM s CROSS JOIN d a CROSS JOIN d b
LEFT JOIN c ON c.split = s.split AND c.actual = a.class AND c.predicted = b.class
""")
def q_confusion_matrix_by_split(spark, sf_dir):
    """Dense matrices for every split value: the k^2 grid is generated per distinct
    split (a class-sized frame) and left-joined to the per-split counts."""
    return _rule_matrix(spark, sf_dir, keys=["split"])


@register("per_class_metrics_by_split", "E3 E5 E7 E9 E10", f"""
WITH m AS (
  WITH p AS ({fx.RULE_PREDICTIONS_SQL}),
  c AS (SELECT split, actual, predicted, count(*) AS n FROM p GROUP BY split, actual, predicted),
  s AS (SELECT DISTINCT split FROM p),
  d AS (SELECT * FROM {fx.domain_values_sql(_DOM)})
  SELECT s.split, a.class_idx AS actual_idx, a.class AS actual, b.class_idx AS predicted_idx, b.class AS predicted,
         coalesce(c.n, 0) AS n
  FROM s CROSS JOIN d a CROSS JOIN d b
  LEFT JOIN c ON c.split = s.split AND c.actual = a.class AND c.predicted = b.class),
k AS (
  SELECT m.split, d.class_idx, d.class,
         sum(CASE WHEN m.actual = d.class THEN n ELSE 0 END) AS support,
         sum(CASE WHEN m.predicted = d.class THEN n ELSE 0 END) AS predicted_total,
         sum(CASE WHEN m.actual = d.class AND m.predicted = d.class THEN n ELSE 0 END) AS tp
  FROM m CROSS JOIN {fx.domain_values_sql(_DOM)} GROUP BY m.split, d.class_idx, d.class),
r AS (
  SELECT k.*, CASE WHEN predicted_total = 0 THEN 0.0 ELSE tp / predicted_total END AS precision,
         CASE WHEN support = 0 THEN NULL ELSE tp / support END AS recall,
         support / sum(support) OVER (PARTITION BY split) AS class_ratio
  FROM k)
SELECT split, class_idx, class, CAST(support AS BIGINT) AS support, CAST(predicted_total AS BIGINT) AS predicted_total,
       CAST(tp AS BIGINT) AS tp, {_sql_round('precision')} AS precision, {_sql_round('recall')} AS recall,
       {_sql_round('CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END')}
         AS f1,
       {_sql_round('class_ratio')} AS class_ratio
FROM r
""")
def q_per_class_metrics_by_split(spark, sf_dir):
    return surface(ev.per_class_metrics(_rule_matrix(spark, sf_dir, keys=["split"]), keys=["split"]))


_X3_PRED_SQL = f"""
SELECT CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS actual,
       CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS predicted
FROM ({fx.FOREST_TEST_SQL}) te
"""


@register("forest_binary_matrix", "X3 E1", _dense_sql(_X3_PRED_SQL, fx.FOREST_BIN_DOMAIN))
def q_forest_binary_matrix(spark, sf_dir):
    """X3's matrix: binarized actual labels against the binary model's predictions."""
    r = _forest(spark, sf_dir, "x3")
    return ev.confusion_matrix(r.predictions, r.domain(), r.actual, "predicted_label")


# ---------------------------------------------------------------------------
# Labels that are NULL (R3-R6): parts add up to the row count
# ---------------------------------------------------------------------------

_NULL_TEST_SQL = f"""
SELECT CASE WHEN l_discount = 0.05 THEN NULL ELSE attack_type END AS attack_type,
       CASE WHEN l_tax = 0.03 THEN NULL WHEN l_tax = 0.04 THEN 'unsure' ELSE predicted_bin END AS predicted_bin
FROM (SELECT l_discount, l_tax, {fx.ATTACK_LABEL_SQL} AS attack_type,
             CASE WHEN l_discount = 0.0 THEN 'normal' ELSE 'anomaly' END AS predicted_bin FROM lineitem) x
"""


def _null_predictions(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    rule = F.when(F.col("l_discount") == 0.0, "normal").otherwise("anomaly")
    return li.select(F.when(F.col("l_discount") != 0.05, fx.attack_label()).alias("attack_type"),
                     F.when(F.col("l_tax") == 0.03, F.lit(None)).when(F.col("l_tax") == 0.04, "unsure").otherwise(rule).alias("predicted_bin"))


@register("attribution_with_nulls", "R3 R4 R5", f"""
WITH t AS ({_NULL_TEST_SQL})
SELECT attack_type, count(*) FILTER (WHERE predicted_bin = 'normal') AS labeled_normal,
       count(*) FILTER (WHERE predicted_bin = 'anomaly') AS labeled_anomaly,
       count(*) FILTER (WHERE predicted_bin IS NULL OR predicted_bin NOT IN ('normal', 'anomaly')) AS labeled_other,
       count(*) AS total, attack_type IS NULL OR attack_type LIKE 'r%' AS in_train
FROM t GROUP BY attack_type
""")
def q_attribution_with_nulls(spark, sf_dir):
    pred = _null_predictions(spark, sf_dir)
    train = pred.filter("attack_type IS NULL OR attack_type LIKE 'r%'")
    return reports.label_attribution(pred, "attack_type", "predicted_bin", train=train)


@register("unseen_class_rows_with_nulls", "R6", f"""
WITH t AS ({_NULL_TEST_SQL})
SELECT count(*) FILTER (WHERE attack_type IS NULL) AS unseen_rows, count(*) AS total_rows,
       CAST(max(CASE WHEN attack_type IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unseen_classes
FROM t
""")
def q_unseen_class_rows_with_nulls(spark, sf_dir):
    pred = _null_predictions(spark, sf_dir)
    return reports.unseen_class_rows(pred.filter("attack_type IS NOT NULL"), pred, "attack_type")


# ---------------------------------------------------------------------------
# Data sets written and read back (C3 split, C4), the binarizer by its SQL name
# ---------------------------------------------------------------------------

@register("quarantine_split", "C3", """
SELECT status, event_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT event_type, CASE WHEN event_type = 'error' AND value > 100 THEN 'rejected' ELSE 'kept' END AS status FROM events) e
GROUP BY ALL
""")
def q_quarantine_split(spark, sf_dir):
    """Kept and rejected rows written in one pass, both partitions read back."""
    rule = (F.col("event_type") == "error") & (F.col("value") > 100)
    path = clean.write_quarantined(fx.table(spark, sf_dir, "events"), rule, scratch_path(spark, "quarantine"))
    return spark.read.parquet(path).groupBy("status", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("binarizer_sql", "P1", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE 'anomaly' END AS event_type_bin FROM events
""")
def q_binarizer_sql(spark, sf_dir):
    from forestlens.functions.labels import register_binarizer
    name = register_binarizer(spark, normal="view")
    return fx.table(spark, sf_dir, "events").selectExpr("event_id", f"{name}(event_type) AS event_type_bin")


@register("binarized_dataset_roundtrip", "C4 S1", f"""
WITH tr AS ({fx.FOREST_TRAIN_SQL})
SELECT CASE WHEN attack_type = 'normal' THEN 'normal' ELSE 'anomaly' END AS attack_type, CAST(count(*) AS BIGINT) AS n
FROM tr GROUP BY ALL
""")
def q_binarized_dataset_roundtrip(spark, sf_dir):
    """The binarized training records written as headerless CSV and read back under the
    strict 42-field contract."""
    train, _ = fx.connection_records(fx.table(spark, sf_dir, "lineitem"))
    data = clean.binarize_dataset(clean.strip_label_suffix(train))
    path = sinks.write_records(data, scratch_path(spark, "binarized"))
    return src.read_connections_strict(spark, path).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# A random split of identified records, and X4's reports from the forest itself
# ---------------------------------------------------------------------------

@register("split_by_record", "U2 X1", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS total, CAST(0 AS BIGINT) AS miscounted
FROM lineitem GROUP BY l_returnflag
""")
def q_split_by_record(spark, sf_dir):
    """Per class: rows of both splits together, and by how many rows a record's count in
    them differs from its count in the table. Records are identified by table columns
    (which repeat); the frame is dealt by value, so both splits of the lazy plan see the same rows."""
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    train, test = sp.random_split(sp.fixed_partitions(rows, sp.partitions_for(rows)))
    tagged = train.union(test).withColumn("n", F.lit(1)).union(rows.withColumn("n", F.lit(-1)))
    per_record = tagged.groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("split_rows"), F.abs(F.sum("n")).alias("off"))
    return per_record.groupBy("l_returnflag").agg(F.sum("split_rows").alias("total"), F.sum("off").alias("miscounted"))


@register("x4_attribution_reports", "X4 R3 R4 R5", f"""
WITH te AS ({fx.FOREST_TEST_SQL}), c AS (SELECT attack_type, count(*) AS n FROM te WHERE attack_type <> 'normal' GROUP BY 1)
SELECT 'correct_anomaly' AS report, attack_type, CAST(0 AS BIGINT) AS labeled_normal, n AS labeled_anomaly,
       attack_type <> 'novel' AS in_train FROM c WHERE n >= 100
""")
def q_x4_attribution_reports(spark, sf_dir):
    """R3 and R4 from the forest's own predictions, through the job's report code."""
    from forestlens.plans import experiments as xp
    r = _forest(spark, sf_dir, "x4")
    tables = xp.attribution_reports(r, train_classes=sorted(fx.FOREST_DOMAIN.train_classes))
    cols = ["attack_type", "labeled_normal", "labeled_anomaly", "in_train"]
    parts = [tables[n].select(F.lit(n).alias("report"), *cols) for n in ("false_normal", "correct_anomaly")]
    return parts[0].union(parts[1])


@register("forest_noisy_invariants", "F8 F10 F11 E1 E6", """
SELECT l_returnflag AS class, CAST(count(*) AS BIGINT) AS support, TRUE AS recall_is_accuracy
FROM lineitem WHERE l_linenumber > 5 GROUP BY l_returnflag
""")
def q_forest_noisy_invariants(spark, sf_dir):
    """A forest on labels that its features don't determine, at the study's settings (50 trees,
    depth 20): the supports are the table's, and weighted recall equals accuracy."""
    from forestlens.plans import experiments as xp
    li = fx.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_linestatus", "l_quantity", "l_discount", "l_tax",
                                                    F.col("l_returnflag").alias("attack_type"))
    train, test = li.filter("l_linenumber <= 5").drop("l_linenumber"), li.filter("l_linenumber > 5").drop("l_linenumber")
    r = xp.run_experiment(train, test, xp.ExperimentConfig(
        50, 20, categorical=["l_linestatus"], features=["l_linestatus_vec", "l_quantity", "l_discount", "l_tax"],
        classes=["A", "N", "R"], cache_node_ids=True))
    e = r.evaluation(checkpoint=True)
    right = e.matrix.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))) / F.sum("n")).alias("accuracy"))
    both = e.overall.select("recall").join(right)
    return e.per_class.select("class", "support").join(both).select(
        "class", "support", (F.abs(F.col("recall") - F.col("accuracy")) < 1e-9).alias("recall_is_accuracy"))

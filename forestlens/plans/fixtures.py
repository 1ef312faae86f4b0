"""Labeled frames derived from the driver's tables, for the registered queries.

The study's own data is not available, so each query labels a whole given table
with a fixed rule. Every rule is written twice: once as DataFrame expressions
(what runs on Spark) and once as SQL text used only by the DuckDB oracle.
No rule filters rows away; train/test roles split a table, they never sample it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forestlens.operators.evaluate import ClassDomain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- noisy rule predictions on lineitem (evaluation queries) ----------------
# 'satan' is never predicted (precision 0); 'spy' is in the domain but unused
# (zero support: recall NaN, F1 NaN).
RULE_DOMAIN = ClassDomain.of(["normal", "neptune", "smurf", "satan", "spy"],
                             train_classes=["normal", "neptune", "smurf", "satan"])


def rule_predictions(lineitem: DataFrame) -> DataFrame:
    actual = (F.when(F.col("l_returnflag") == "A", "normal")
              .when(F.col("l_returnflag") == "R", "neptune")
              .when(F.col("l_linestatus") == "O", "smurf")
              .otherwise("satan"))
    predicted = (F.when(F.col("l_quantity") >= 48, "neptune")
                 .when(F.col("l_discount") == 0.0, "normal")
                 .when(F.col("l_returnflag") == "N", "smurf")
                 .otherwise(actual))
    return lineitem.select(F.col("l_linenumber").alias("split"), actual.alias("actual"), predicted.alias("predicted"))


RULE_PREDICTIONS_SQL = """
SELECT l_linenumber AS split, actual,
       CASE WHEN l_quantity >= 48 THEN 'neptune'
            WHEN l_discount = 0.0 THEN 'normal'
            WHEN l_returnflag = 'N' THEN 'smurf'
            ELSE actual END AS predicted
FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'normal'
                     WHEN l_returnflag = 'R' THEN 'neptune'
                     WHEN l_linestatus = 'O' THEN 'smurf'
                     ELSE 'satan' END AS actual
      FROM lineitem) s
"""


def domain_values_sql(domain: ClassDomain) -> str:
    rows = ", ".join(f"({i}, '{c}', {'TRUE' if domain.seen(c) else 'FALSE'})" for i, c in enumerate(domain.classes))
    return f"(VALUES {rows}) AS d(class_idx, class, in_train)"


# --- binary predictions of multi-class records (attribution reports) --------
# Train rows: lines 1-4; test rows: lines 5-7 (together the whole table). In the
# test rows only, quantities of 40 and more carry a "new_" class, so those
# classes never occur in training.
def attack_label():
    return (F.when(F.col("l_returnflag") == "A", F.lit("normal"))
            .otherwise(F.concat(F.lower("l_returnflag"), F.lower("l_linestatus"), F.lit("_"),
                                F.floor(F.col("l_quantity") / 10).cast("int").cast("string"))))


def binary_rule_predictions(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): train carries ``attack_type``; test also ``predicted_bin``."""
    pred = (F.when((F.col("l_discount") == 0.0) | ((F.col("l_returnflag") == "A") & (F.col("l_discount") < 0.09)),
                   F.lit("normal")).otherwise(F.lit("anomaly")))
    test_label = F.when((F.col("l_returnflag") != "A") & (F.col("l_quantity") >= 40),
                        F.concat(F.lit("new_"), attack_label())).otherwise(attack_label())
    test = lineitem.filter(F.col("l_linenumber") > 4).select(test_label.alias("attack_type"),
                                                            pred.alias("predicted_bin"))
    train = lineitem.filter(F.col("l_linenumber") <= 4).select(attack_label().alias("attack_type"))
    return train, test


ATTACK_LABEL_SQL = ("CASE WHEN l_returnflag = 'A' THEN 'normal' ELSE lower(l_returnflag) || lower(l_linestatus) "
                    "|| '_' || CAST(CAST(floor(l_quantity / 10) AS INTEGER) AS VARCHAR) END")
BINARY_TEST_SQL = f"""
SELECT CASE WHEN l_returnflag <> 'A' AND l_quantity >= 40 THEN 'new_' || ({ATTACK_LABEL_SQL})
            ELSE {ATTACK_LABEL_SQL} END AS attack_type,
       CASE WHEN l_discount = 0.0 OR (l_returnflag = 'A' AND l_discount < 0.09) THEN 'normal' ELSE 'anomaly' END
         AS predicted_bin
FROM lineitem WHERE l_linenumber > 4
"""
BINARY_TRAIN_SQL = f"SELECT {ATTACK_LABEL_SQL} AS attack_type FROM lineitem WHERE l_linenumber <= 4"


# --- separable labels for the forest (train lines 1-5, test lines 6-7) -------
# A -> normal, R -> neptune, N -> smurf; in test only, N on line 7 -> novel.
FOREST_CATEGORICAL = ["l_returnflag", "l_linestatus"]
FOREST_NUMERIC = ["l_quantity", "l_discount", "l_tax"]
FOREST_FEATURES = ["l_returnflag_vec", "l_linestatus_vec", "l_quantity", "l_discount", "l_tax"]
FOREST_DOMAIN = ClassDomain.of(["normal", "neptune", "smurf", "novel"],
                               train_classes=["normal", "neptune", "smurf"])
FOREST_BIN_DOMAIN = ClassDomain.of(["anomaly", "normal"])


def _base_label():
    return (F.when(F.col("l_returnflag") == "A", F.lit("normal"))
            .when(F.col("l_returnflag") == "R", F.lit("neptune"))
            .otherwise(F.lit("smurf")))


def forest_frames(lineitem: DataFrame, label: str = "attack_type") -> tuple[DataFrame, DataFrame]:
    cols = FOREST_CATEGORICAL + FOREST_NUMERIC
    train = lineitem.filter(F.col("l_linenumber") <= 5).select(*cols, _base_label().alias(label))
    test_label = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7), F.lit("novel")) \
        .otherwise(_base_label())
    test = lineitem.filter(F.col("l_linenumber") > 5).select(*cols, test_label.alias(label))
    return train, test


def forest_all_seen(lineitem: DataFrame, label: str = "attack_type") -> DataFrame:
    """One labeled file without the novel class (for the random-split job)."""
    return lineitem.select(*(FOREST_CATEGORICAL + FOREST_NUMERIC), _base_label().alias(label))


FOREST_TEST_SQL = """
SELECT CASE WHEN l_returnflag = 'A' THEN 'normal'
            WHEN l_returnflag = 'R' THEN 'neptune'
            WHEN l_linenumber = 7 THEN 'novel'
            ELSE 'smurf' END AS attack_type
FROM lineitem WHERE l_linenumber > 5
"""
FOREST_TRAIN_SQL = """
SELECT CASE WHEN l_returnflag = 'A' THEN 'normal' WHEN l_returnflag = 'R' THEN 'neptune' ELSE 'smurf' END
         AS attack_type
FROM lineitem WHERE l_linenumber <= 5
"""

# --- connection records derived from lineitem (the full 42-field job path) ----
# protocol_type and service carry the label (from l_returnflag); the other
# fields are lineitem values or constants (land, is_host_login, is_guest_login
# are single-valued, so the pipeline leaves them out). Labels end with the
# period of the raw files. Test rows (lines 6-7): N on line 7 -> mailbomb.
RECORD_DOMAIN = ClassDomain.of(["normal", "neptune", "smurf", "mailbomb"],
                               train_classes=["normal", "neptune", "smurf"])


def _connection_columns():
    from forestlens.schema import CONNECTION_FIELDS
    rf = F.col("l_returnflag")
    base = F.when(rf == "A", "normal").when(rf == "R", "neptune").otherwise("smurf")
    derived = {
        "duration": F.col("l_linenumber"),
        "protocol_type": F.when(rf == "A", "tcp").when(rf == "R", "udp").otherwise("icmp"),
        "service": F.when(rf == "A", "http").when(rf == "R", "private").otherwise("ecr_i"),
        "flag": F.when(F.col("l_linestatus") == "O", "SF").otherwise("S0"),
        "src_bytes": (F.col("l_quantity") * 100).cast("int"),
        "dst_bytes": F.col("l_extendedprice").cast("int"),
        "logged_in": F.when(F.col("l_tax") > 0.04, "1").otherwise("0"),
        "count": (F.col("l_discount") * 100).cast("int"),
        "srv_count": F.col("l_linenumber"),
        "serror_rate": F.col("l_discount"),
        "rerror_rate": F.col("l_tax"),
        "dst_host_count": (F.col("l_suppkey") % 256).cast("int"),
    }
    defaults = {"int": F.lit(0), "double": F.lit(0.0), "string": F.lit("0")}
    return [derived.get(n, defaults[t]).cast(t).alias(n) for n, t in CONNECTION_FIELDS[:-1]], base


def connection_fields(lineitem: DataFrame) -> DataFrame:
    """The table's columns and, for every row, the 42 fields (labels end with a period)."""
    cols, base = _connection_columns()
    return lineitem.select("*", *cols, F.concat(base, F.lit(".")).alias("attack_type"))


def connection_records(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols, base = _connection_columns()
    rf = F.col("l_returnflag")
    train = lineitem.filter(F.col("l_linenumber") <= 5).select(*cols, F.concat(base, F.lit(".")).alias("attack_type"))
    test_label = F.when((rf == "N") & (F.col("l_linenumber") == 7), F.lit("mailbomb")).otherwise(base)
    test = lineitem.filter(F.col("l_linenumber") > 5).select(*cols, F.concat(test_label, F.lit(".")).alias("attack_type"))
    return train, test


RECORD_TEST_SQL = """
SELECT CASE WHEN l_returnflag = 'A' THEN 'normal'
            WHEN l_returnflag = 'R' THEN 'neptune'
            WHEN l_linenumber = 7 THEN 'mailbomb'
            ELSE 'smurf' END AS attack_type
FROM lineitem WHERE l_linenumber > 5
"""

# --- events: label cleaning / distribution fixtures ------------------------
EVENT_CATEGORIES = {"normal": ["view", "click", "purchase"], "dos": ["error"]}  # 'signup' -> unknown

"""Connection-record schema, class domains and the class -> category map.

Everything that knows about the network-connection data set lives here; the
operators take column names and domains as parameters.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: must equal the study's for matching results -------------
# Connection-record fields in file order (headerless CSV), with their types.
CONNECTION_FIELDS = [
    ("duration", "int"),
    ("protocol_type", "string"),
    ("service", "string"),
    ("flag", "string"),
    ("src_bytes", "int"),
    ("dst_bytes", "int"),
    ("land", "string"),
    ("wrong_fragment", "int"),
    ("urgent", "int"),
    ("hot", "int"),
    ("num_failed_logins", "int"),
    ("logged_in", "string"),
    ("num_compromised", "int"),
    ("root_shell", "int"),
    ("su_attempted", "int"),
    ("num_root", "int"),
    ("num_file_creations", "int"),
    ("num_shells", "int"),
    ("num_access_files", "int"),
    ("num_outbound_cmds", "int"),
    ("is_host_login", "string"),
    ("is_guest_login", "string"),
    ("count", "int"),
    ("srv_count", "int"),
    ("serror_rate", "double"),
    ("srv_serror_rate", "double"),
    ("rerror_rate", "double"),
    ("srv_rerror_rate", "double"),
    ("same_srv_rate", "double"),
    ("diff_srv_rate", "double"),
    ("srv_diff_host_rate", "double"),
    ("dst_host_count", "int"),
    ("dst_host_srv_count", "int"),
    ("dst_host_same_srv_rate", "double"),
    ("dst_host_diff_srv_rate", "double"),
    ("dst_host_same_src_port_rate", "double"),
    ("dst_host_srv_diff_host_rate", "double"),
    ("dst_host_serror_rate", "double"),
    ("dst_host_srv_serror_rate", "double"),
    ("dst_host_rerror_rate", "double"),
    ("dst_host_srv_rerror_rate", "double"),
    ("attack_type", "string"),
]

# Categorical inputs that are one-hot encoded.
CATEGORICAL_COLUMNS = [
    "protocol_type", "service", "flag", "land", "logged_in", "is_host_login", "is_guest_login",
]

# Column the study leaves out of the feature vector (its assembler stops one short).
OMITTED_FEATURES = ["dst_host_srv_rerror_rate"]

LABEL_COLUMN = "attack_type"

# Classes seen in training, in matrix order.
TRAIN_CLASSES = [
    "back", "buffer_overflow", "ftp_write", "guess_passwd", "imap", "ipsweep", "land",
    "loadmodule", "multihop", "neptune", "nmap", "perl", "phf", "pod", "portsweep",
    "rootkit", "satan", "smurf", "spy", "teardrop", "warezclient", "warezmaster", "normal",
]
# All classes: the training classes first, then those only in the test set.
ALL_CLASSES = [
    "back", "buffer_overflow", "ftp_write", "guess_passwd", "imap", "ipsweep", "land",
    "loadmodule", "multihop", "neptune", "nmap", "perl", "phf", "pod", "portsweep",
    "rootkit", "satan", "smurf", "spy", "teardrop", "warezclient", "warezmaster", "normal",
    "apache2", "httptunnel", "mailbomb", "mscan", "named", "processtable", "ps", "saint",
    "sendmail", "snmpgetattack", "snmpguess", "sqlattack", "udpstorm", "worm", "xlock",
    "xsnoop", "xterm",
]
BIN_CLASSES = ["anomaly", "normal"]

NORMAL_LABEL = "normal"
ANOMALY_LABEL = "anomaly"

# Public attack-category grouping of the training classes.
CATEGORY_MAP = {
    "dos": ["back", "land", "neptune", "pod", "smurf", "teardrop"],
    "probe": ["ipsweep", "nmap", "portsweep", "satan"],
    "r2l": ["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster"],
    "u2r": ["buffer_overflow", "loadmodule", "perl", "rootkit"],
    "normal": ["normal"],
}
UNKNOWN_CATEGORY = "unknown"

# Heatmap cell shading: counts saturate at 1000, non-empty cells show at least 0.05.
HEATMAP_SATURATION = 1000.0
HEATMAP_MIN_OPACITY = 0.05
# --- end of fixed values ----------------------------------------------------

_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "long": T.LongType()}


def connection_schema(nullable: bool = True) -> T.StructType:
    """The 42-field record schema. File sources force nullable=True on read, so
    non-null is enforced by :func:`forestlens.sources.csv.require_not_null` instead."""
    return T.StructType([T.StructField(n, _TYPES[t], nullable) for n, t in CONNECTION_FIELDS])


def connection_feature_order(categorical=CATEGORICAL_COLUMNS, omitted=OMITTED_FEATURES,
                             label=LABEL_COLUMN, vec_suffix: str = "_vec") -> list[str]:
    """Assembler inputs in schema order: numeric columns as they are,
    categorical ones replaced by their one-hot vector column."""
    out = []
    for name, _ in CONNECTION_FIELDS:
        if name == label or name in omitted:
            continue
        out.append(name + vec_suffix if name in categorical else name)
    return out

"""Column expressions on labels. All are built-in Catalyst expressions, so they
stay inside whole-stage codegen; nothing here runs Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from forestlens.schema import (
    ANOMALY_LABEL, HEATMAP_MIN_OPACITY, HEATMAP_SATURATION, NORMAL_LABEL, UNKNOWN_CATEGORY,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_suffix(col, suffix: str = ".") -> Column:
    """Remove one trailing ``suffix`` (default the period that ends every record)."""
    return F.regexp_replace(_col(col), re.escape(suffix) + "$", "")


def binarize(col, normal: str = NORMAL_LABEL, anomaly: str = ANOMALY_LABEL) -> Column:
    """``normal`` stays ``normal``; every other label becomes ``anomaly``. NULL stays NULL."""
    c = _col(col)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c == normal, F.lit(normal)).otherwise(F.lit(anomaly))


def register_binarizer(spark: SparkSession, name: str = "binarizer",
                       normal: str = NORMAL_LABEL, anomaly: str = ANOMALY_LABEL) -> str:
    """Register the binarizer for SQL callers as a SQL function. Catalyst inlines
    its body, so ``binarizer(x)`` compiles to the same CASE as :func:`binarize`."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"invalid function name {name!r}")
    n = normal.replace("'", "''")
    a = anomaly.replace("'", "''")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(label STRING) RETURNS STRING "
        f"RETURN CASE WHEN label IS NULL THEN NULL WHEN label = '{n}' THEN '{n}' ELSE '{a}' END"
    )
    return name


def category_of(col, category_map: dict[str, list[str]], unknown: str = UNKNOWN_CATEGORY) -> Column:
    """Map a class label to its category; labels outside the map get ``unknown``."""
    from forestlens.operators.evaluate import sql_string
    c = _col(col)
    expr = None
    for category, members in category_map.items():
        # one literal array per category, parsed JVM-side in one call
        cond = F.array_contains(F.expr("array(" + ", ".join(sql_string(m) for m in members) + ")"), c)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return F.lit(unknown) if expr is None else expr.otherwise(F.lit(unknown))


def cell_opacity(n, saturation: float = HEATMAP_SATURATION, floor: float = HEATMAP_MIN_OPACITY) -> Column:
    """Shade of a heatmap cell: ``max(min(sat, n)/sat, floor)`` if n > 0, else 0."""
    c = _col(n).cast("double")
    scaled = F.least(c, F.lit(float(saturation))) / F.lit(float(saturation))
    return F.when(c > 0, F.greatest(scaled, F.lit(float(floor)))).otherwise(F.lit(0.0))

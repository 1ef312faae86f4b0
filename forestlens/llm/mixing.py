"""Mixing sources to target weights by hash-threshold histograms.

Every row has a size (words) and a 60-bit hash of its id and text. A source that should
yield ``target`` words takes all its rows ``floor(target / source_size)`` times and, for the
rest, the rows whose hash lies below a threshold. Thresholds come from histograms: words are
summed by (source, hash bucket), the bucket where the running sum crosses the rest is the
boundary, and only rows of boundary buckets are looked at again with the next hash bits. No
row is sorted; the last filter compares each hash with its source's threshold.

Nested: a row's hash is fixed, so the rows (and copies) taken at a smaller budget are among
those taken at a larger one.

Defined results: a null text has size 0; a null source is a source of its own, weighed last;
rows alike in id and text have one hash and are taken together (the boundary goes to the
nearer side); rows of size 0 are taken as their hash says and count nothing; an empty table
gives no rows. Other columns are kept and never read, whatever their names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forestlens.llm import textops
from forestlens.llm.common import materialize

LEVEL_BITS = 12
LEVELS = 5
HASH_BITS = LEVEL_BITS * LEVELS


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    out = []
    for lo, hi, data, offsets in textops.slices(text):
        _, _, doc = textops.words(data, offsets)
        out.append(textops.per_doc(doc, hi - lo))
    return pa.concat_arrays([pa.array(x) for x in out]) if out else pa.array([], pa.int64())


def row_hash(doc_id: str, text: str) -> Column:
    """The upper 60 bits of a 64-bit hash, as a non-negative long."""
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text)), 64 - HASH_BITS)


def targets(sizes: DataFrame, budget: float = 1.0, max_repeat: float = 3.0) -> DataFrame:
    """``(source, weight, source_size, target)`` from one row per source.

    Shares of ``budget`` x all words by weight, stopped at ``max_repeat`` x the source's size,
    the excess reshared by weight: sources are filled in order of size / weight, and the
    level is the one that those not stopped share. One row per source is a table as
    long as the list of hand-set weights, so one task orders it."""
    ratio = F.when(F.col("weight") > 0, F.col("source_size") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(budget) * F.sum("source_size").over(everything)
             - F.lit(max_repeat) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    fits = sizes.withColumn("_level", level).withColumn(
        "_level", F.when(F.col("_level") * F.col("weight") <= F.lit(max_repeat) * F.col("source_size"), F.col("_level")))
    first = fits.withColumn("_level", F.max("_level").over(everything))
    target = F.least(F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("weight"),
                     F.lit(max_repeat) * F.col("source_size"))
    return first.select("source", "weight", "source_size",
                        F.when(F.col("weight") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def weights_by_rank(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., ``cycle``, repeating, by code point order of the source, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((rank - 1) % cycle + 1).cast("double"))


def mix_plan(docs: DataFrame, weights=weights_by_rank, budget: float = 1.0, max_repeat: float = 3.0,
             doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per source: ``source, source_size, target, copies, threshold``. A row is taken
    ``copies`` times, and once more if its hash is at most ``threshold``.

    ``weights`` maps a frame with a ``source`` column to one with ``weight`` added."""
    rows = materialize(docs.select(F.col(source).alias("source"), row_hash(doc_id, text).alias("h"),
                                   word_count(F.col(text)).alias("size")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(weights(sizes), budget, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = materialize(goal.withColumn("copies", whole.cast("int")).select(
        "source", "source_size", "target", "copies",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), "mix-targets")

    settled = None
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("h", shift)
        if level:
            state_key = state.select(F.col("source").alias("s"), "prefix")
            rows = rows.join(state_key, F.col("source").eqNullSafe(F.col("s"))
                             & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))).select("source", "h", "size")
            if level == 1:
                rows = materialize(rows, "mix-boundary")
        counts = rows.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        joined = state.alias("a").join(counts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))
                                       & (F.col("a.below") + F.col("b.before") < F.col("a.rest"))
                                       & (F.col("a.below") + F.col("b.before") + F.col("b.words") >= F.col("a.rest")))
        step = materialize(joined.select(
            "a.source", "a.source_size", "a.target", "a.copies", "a.rest", F.col("b.bucket").alias("prefix"),
            (F.col("a.below") + F.col("b.before")).alias("below"), "b.words", "b.lo", "b.hi"), "mix-level")
        one = F.col("lo") == F.col("hi")
        if level == LEVELS - 1:
            one = F.lit(True)
        over = F.col("below") + F.col("words") - F.col("rest") <= F.col("rest") - F.col("below")
        found = step.filter(one).select("source", F.when(over, F.col("hi")).otherwise(F.col("lo") - 1).alias("threshold"))
        settled = found if settled is None else settled.union(found)
        state = step.filter(~one).select("source", "source_size", "target", "copies", "rest", "prefix", "below")
        if state.isEmpty():
            break
    start = goal.withColumn("copies", whole.cast("int"))
    none = F.lit(-1).cast("long")
    return materialize(start.alias("g").join(settled.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")), "left").select(
        "g.source", "g.source_size", "g.target", "g.copies", F.coalesce(F.col("t.threshold"), none).alias("threshold")), "mix-plan")


def mix(docs: DataFrame, weights=weights_by_rank, budget: float = 1.0, max_repeat: float = 3.0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``source_size``, ``target``, ``copies``
    (times the mix takes the row, 0 to ``max_repeat``). The plan has a row per source and is
    read from a written table, so Spark broadcasts it only when its size allows."""
    plan = mix_plan(docs, weights, budget, max_repeat, doc_id, text, source)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(source).alias("_s"), row_hash(doc_id, text).alias("_h"))
    return rows.join(plan, F.col("_s").eqNullSafe(F.col("source"))).select(
        "row", "source_size", "target",
        (F.col("copies") + (F.col("_h") <= F.col("threshold")).cast("int")).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mix(docs, **options).filter("copies > 0").select(
        F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")

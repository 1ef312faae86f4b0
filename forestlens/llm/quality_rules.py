"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose measure lies above a cutoff. Cutoffs are chosen per stratum
(language) and rule on labelled holdout documents: going from the laxest to the strictest
cutoff of a fixed grid, a cutoff is accepted while the exact binomial test (Clopper-Pearson)
shows that it rejects less than ``max_false_rejection`` of the good documents, at confidence
1 - ``delta`` / (tested strata x rules). Testing in a fixed order needs no further correction over
cutoffs, Bonferroni covers strata and rules, so with probability 1 - ``delta`` every rule in every
tested stratum keeps its limit.

Strata with too few good labels for a proof of their own are tested as one pool, with the smallest
larger strata as further evidence while the pool itself has too few. The number of good labels alone decides, not
what rules reject. The limit is then proved for the pool as a whole, not for each stratum in it.
Rules stay off where even that is too little evidence, and in strata without a labelled document.

A base gate (too few words, too many repeated words) comes first.

Defined results: a null or empty text has no words and fails the base gate; a null stratum is
a stratum of its own; labels that are null count nowhere, a document labelled both ways
counts as good; repeated rows are judged alike; no labels: no rule but the base gate; an
empty table gives no rows. Other columns are kept and never read."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forestlens.llm import textops
from forestlens.llm.common import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_letters n_marks".split()
MEASURE_TYPE = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "n_letters"),
    "marks": ("n_marks", "n_words"),
}
CUTOFFS = [round(i / 50, 2) for i in range(50)]      # 0.00, 0.02 .. 0.98: reject above

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("!"), ord("?")]] = True


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The measures of the texts of one slice, a column each (order of ``MEASURES``)."""
    n = len(offsets) - 1
    where = np.repeat(np.arange(n), np.diff(offsets))
    starts, ends, doc = textops.words(data, offsets)
    hashes = textops.span_hashes(data, starts, ends)
    space = textops.SPACE[data]

    def bytes_in(flags: np.ndarray) -> np.ndarray:
        return textops.per_doc(where[flags], n)

    # windows found twice or more; their words are marked by a difference array
    at, window = textops.window_hashes(hashes, doc, WINDOW)
    at = at[textops.repeated(doc[at], window)]
    mark = np.zeros(len(starts) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    covered = np.cumsum(mark)[:-1] > 0
    # lines with a word, equal to an earlier line of the text
    ls, le, ldoc = textops.lines(data, offsets)
    word_bytes = np.concatenate([[0], np.cumsum(~space)])
    full = word_bytes[le] > word_bytes[ls]
    ls, le, ldoc = ls[full], le[full], ldoc[full]
    again = textops.not_first(ldoc, textops.span_hashes(data, ls, le))
    return np.stack([
        textops.per_doc(doc, n), bytes_in(~space & ((data & 0xC0) != 0x80)), bytes_in(_SYMBOL[data]),
        textops.per_doc(ldoc[again], n), textops.per_doc(doc[covered], n), textops.per_doc(ldoc, n),
        bytes_in(_UPPER[data]), bytes_in(_LETTER[data]), bytes_in(_MARK[data])], 1)


@F.arrow_udf(MEASURE_TYPE)
def measures(text: pa.Array) -> pa.Array:
    parts = [measure_slice(data, offsets) for _, _, data, offsets in textops.slices(text)]
    table = np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), np.int64)
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(MEASURES))], MEASURES)


# Keeps the optimizer from copying the call into each filter and projection that reads its fields.
measures = measures.asNondeterministic()


def base_failed(m: str = "m") -> Column:
    """Fixed gate: under 20 words, or more than 30% of them in repeated windows."""
    return (F.col(f"{m}.n_words") < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * F.col(f"{m}.n_words"))


def ratio(rule: str, m: str = "m") -> Column:
    part, whole = RULES[rule]
    return F.when(F.col(f"{m}.{whole}") > 0, F.col(f"{m}.{part}") / F.col(f"{m}.{whole}")).otherwise(F.lit(0.0))


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), exactly summed in logs."""
    if x >= n:
        return 1.0
    k = np.arange(x + 1)
    log = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in k]) + k * np.log(p) + (n - k) * np.log1p(-p)
    top = log.max()
    return float(min(1.0, np.exp(top) * np.exp(log - top).sum()))


def largest_passing(n: int, p: float, delta: float) -> int:
    """Most rejections among ``n`` good documents that still prove a rate below ``p``; -1: none."""
    lo, hi = -1, int(n * p)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if mid < 0 or binomial_cdf(mid, n, p) <= delta:
            lo = mid
        else:
            hi = mid - 1
    return lo


def evidence(sizes: dict[int, int], max_false_rejection: float, delta: float) -> tuple[float, float, float]:
    """``least, reach, level``: strata of ``least`` good labels or more are tested by themselves, the others as a pool of
    all strata below ``reach``, each rule at ``level``. ``sizes``: number of strata by their number of good labels."""
    down, strata = sorted(sizes, reverse=True), sum(sizes.values())

    def level(tests: int) -> float:
        return delta / (max(1, tests) * len(RULES))

    least, tests, own = float("inf"), 1, 0
    for n in down:
        own += sizes[n]
        after = own + (own < strata)
        if largest_passing(n, max_false_rejection, level(after)) >= 0:
            least, tests = n, after
    pooled, reach = sum(n * k for n, k in sizes.items() if n < least), least
    for n in reversed(down):
        if down[-1] < least <= n and largest_passing(pooled, max_false_rejection, level(tests)) < 0:
            pooled, reach = pooled + n * sizes[n], n + 1
    return least, reach, level(tests)


def choose_cutoffs(labelled: DataFrame, max_false_rejection: float, delta: float) -> DataFrame:
    """``stratum, pooled, rule, cutoff, n_good, rejected_good, rejected_bad`` for every rule that passes;
    where ``pooled``, the counts are the pool's.

    ``labelled``: ``stratum``, ``good`` (boolean), ``m``. Rows are reduced to counts by
    (stratum, rule, grid cell) before a shuffle; a stratum's group has a fixed number of rows."""
    cells = labelled.select("stratum", "good", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.ceil(F.round(ratio(r) * len(CUTOFFS), 9)).cast("int").alias("cell")) for r in RULES])))
    counts = cells.groupBy("stratum", "rule", "cell").agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    strata = labelled.groupBy(F.col("stratum").alias("of")).agg(F.sum(F.col("good").cast("long")).alias("n"))
    # distinct sizes: at most the root of twice the labels
    least, reach, level = evidence({r["n"]: r["k"] for r in strata.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}, max_false_rejection, delta)
    sized = counts.join(strata, F.col("stratum").eqNullSafe(F.col("of")))
    pool = sized.filter(F.col("n") < reach).groupBy("rule", "cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = sized.filter(F.col("n") >= least).select("stratum", F.lit(False).alias("pooled"), "rule", "cell", "good", "bad").union(
        pool.select(F.lit(None).cast("string"), F.lit(True), "rule", "cell", "good", "bad"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        stratum, pooled = group["stratum"].iloc[0], group["pooled"].iloc[0]
        for rule, own in group.groupby("rule"):
            good = np.bincount(own["cell"], own["good"], len(CUTOFFS) + 1)
            bad = np.bincount(own["cell"], own["bad"], len(CUTOFFS) + 1)
            n = int(good.sum())
            allowed = largest_passing(n, max_false_rejection, level)
            best = None
            for i in reversed(range(len(CUTOFFS))):       # laxest first; stop at the first that fails
                if good[i + 1:].sum() > allowed:
                    break
                best = (stratum, pooled, rule, CUTOFFS[i], n, int(good[i + 1:].sum()), int(bad[i + 1:].sum()))
            if best is not None:
                out.append(best)
        return pd.DataFrame(out, columns=["stratum", "pooled", "rule", "cutoff", "n_good", "rejected_good", "rejected_bad"])

    chosen = materialize(counts.groupBy("stratum", "pooled").applyInPandas(
        choose, "stratum string, pooled boolean, rule string, cutoff double, n_good long, rejected_good long, rejected_bad long"), "quality-chosen")
    of_pool = strata.filter(F.col("n") < least).select(F.col("of").alias("stratum")).crossJoin(chosen.filter("pooled").drop("stratum"))
    return chosen.filter("not pooled").union(of_pool)


def judge(docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.005, delta: float = 0.05,
          doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", quality: str = "quality") -> DataFrame:
    """``row`` (a struct of all columns), ``m`` (the measures), ``base_failed``, ``failed_rules``
    (array) and ``kept``.

    Measures of labelled documents are taken in a first pass over the texts; the second adds
    the measures to every row and joins the cutoffs (a row per stratum, read from a written
    table, so that Spark broadcasts it only when its size allows)."""
    good = labels.select(F.col(doc_id).alias("label_id"), F.col(quality).alias("q")).filter(
        "label_id is not null and q is not null").groupBy("label_id").agg((F.max("q") > 0).alias("good"))
    measured = docs.select(F.col(doc_id).alias("id"), F.col(stratum).cast("string").alias("stratum"), measures(F.col(text)).alias("m"))
    labelled = materialize(measured.join(good, F.col("id") == F.col("label_id")).filter(~base_failed()).select("stratum", "good", "m"),
                           "quality-labelled")
    cutoffs = choose_cutoffs(labelled, max_false_rejection, delta)
    wide = materialize(cutoffs.groupBy(F.col("stratum").alias("of_stratum")).agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]), "quality-cutoffs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(stratum).cast("string").alias("stratum"), measures(F.col(text)).alias("m"))
    judged = rows.join(wide, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    failed = F.filter(F.array(*[F.when(ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return judged.select("row", "m", base_failed().alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that pass, unchanged."""
    return judge(docs, labels, **options).filter("kept").select("row.*")

"""Phrase collocations per language, counted by direct-address tiles of frequency-ranked ids.

Words are counted, and those found ``min_count`` times or more get ids: the ``HEAD`` most frequent their rank.
Texts are written once as sequences of ids. Pairs of neighbouring ids then fall into square tiles of the rank
plane: a tile that gets many pairs is counted with one dense ``bincount`` over its cells, the pairs of all other
tiles as sorted coordinates. Frequent pairs are ranked anew, and the pairs of neighbouring pair ids are the
phrases of three words, and so on: one step, applied to its own result. A phrase can only be frequent if
both its parts are, so nothing frequent is lost, and all counts are sums over all texts.

The rank table of a level is broadcast; it never has more than ``HEAD`` entries. Frequent words or phrases beyond
it keep a 64-bit hash as id, and a bitmap of fixed size tells which hashes may be frequent (a false hit costs a
count that the threshold removes later), so results are exact at any vocabulary.

Defined results: a null text has no words; a null language is ``und``; rows are counted one by one, so repeated rows count
again; equal scores rank by count, then phrase; an empty table gives no rows; other columns are never read.
Words are told apart by 64-bit hashes with their language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forestlens.llm import textops as T
from forestlens.llm.common import materialize
from forestlens.llm.periodic_runs import word_hashes

HEAD = 1 << 18
TILE_BITS = 10
DENSE_PAIRS = 1 << 15        # pairs in a tile from which its 2**20 cells are counted densely
CHUNK_PAIRS = 1 << 20
ROW_IDS = 1 << 10          # a row of a sequence ends at the first end of a piece after so many ids
ROWS = 512                 # rows taken at once
BITMAP_BITS = 1 << 27
SLICE = 2 << 20
NONE = -1                    # no id: an infrequent word, or the end of a piece
TOP_BIT = np.uint64(1 << 63)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
CUT = np.zeros(256, bool)    # what ends a piece
CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BREAK = CUT.copy()           # what ends a word
BREAK[[0x20, 0x09]] = True


@dataclass
class Ids:
    """The ids of one level: ranks of the most frequent keys, hashes for the rest that a bitmap lets through."""

    keys: np.ndarray         # sorted
    ranks: np.ndarray
    parts: np.ndarray | None = None      # the two ids that make each key's phrase
    bitmap: np.ndarray | None = None

    def find(self, keys: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(keys), NONE, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            if a is not None:
                hit &= (self.parts[0][at] == a) & (self.parts[1][at] == b)
            out[hit] = self.ranks[at[hit]]
        if self.bitmap is not None:
            slot = keys >> np.uint64(64 - (len(self.bitmap) * 64).bit_length() + 1)
            maybe = (out == NONE) & ((self.bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) == 1)
            out[maybe] = hashed_id(keys[maybe])
        return out


def hashed_id(keys: np.ndarray) -> np.ndarray:
    ids = (keys | TOP_BIT).view(np.int64)
    return np.where(ids == NONE, NONE - 1, ids)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(a.view(np.uint64)) * np.uint64(T.BASE) + b.view(np.uint64))


def split_words(langs: pa.Array, texts: pa.Array) -> Iterator[tuple]:
    """Per slice of texts: lower-cased bytes, word starts and ends, keys (of word and language), and whether each word's
    successor stands in the same piece."""
    names = langs.to_pylist()
    salt = {x: xxhash.xxh3_64_intdigest(x) for x in set(names)}
    salts = np.array([salt[x] for x in names], np.uint64)
    for lo, hi, data, offsets in T.slices(texts, SLICE):
        data = LOWER[data]
        starts, ends = T.runs(~BREAK[data], offsets)
        doc = np.searchsorted(offsets, starts, "right") - 1
        cuts = np.concatenate(([0], np.cumsum(CUT[data], dtype=np.int32)))
        same = np.zeros(len(starts), bool)
        same[:-1] = (doc[1:] == doc[:-1]) & (cuts[starts[1:]] == cuts[ends[:-1]])
        yield lo + doc, data, starts, ends, T.mix(word_hashes(data, starts, ends) + T.mix(salts[lo + doc])), same


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, key, n)`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for doc, data, starts, ends, keys, _ in split_words(langs, batch.column(1)):
                if not len(keys):
                    continue
                own, first, n = np.unique(keys, return_index=True, return_counts=True)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(doc[first])).cast(pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                     pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "key", "n"])

    found = docs.mapInArrow(count, "lang string, word string, key long, n long")
    return found.groupBy("lang", "word").agg(F.min("key").alias("key"), F.sum("n").alias("n"))


def with_keys(pairs: DataFrame) -> DataFrame:
    """Frequent pairs ``(a, b, n)`` with the key that tasks find them by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            key = pair_keys(x.column("a").to_numpy(zero_copy_only=False).astype(np.int64), x.column("b").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(key.view(np.int64))], [*x.schema.names, "key"])

    return pairs.mapInArrow(add, "a long, b long, n long, key long")


def rank(level: DataFrame, head: int) -> tuple[DataFrame, Ids]:
    """Ids of a level's rows, unique by ``key``: the ``head`` largest ``n`` by rank (ties by key), the others by hash."""
    spark = level.sparkSession
    parts = [c for c in ("a", "b") if c in level.columns]
    top = level.orderBy(F.desc("n"), "key").select("key", *parts).limit(head).toArrow()
    keys = top["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    ids = Ids(keys[order], order, np.stack([top[c].to_numpy().astype(np.int64)[order] for c in parts]) if parts else None)
    ranks = spark.createDataFrame(pa.table({"key": top["key"], "rank": pa.array(np.arange(len(keys)), pa.int64())}))
    named = level.join(ranks, "key", "left")
    if len(keys) == head:            # there may be more
        shift = 64 - (BITMAP_BITS - 1).bit_length()
        rest = named.filter("rank IS NULL").select(F.shiftrightunsigned("key", shift).alias("slot"))
        words = rest.groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).toArrow()
        if words.num_rows:
            ids.bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
            ids.bitmap[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    hashed = F.col("key").bitwiseOR(F.lit(-2**63))
    return named.withColumn("id", F.coalesce("rank", F.when(hashed == NONE, NONE - 1).otherwise(hashed))).drop("rank"), ids


def id_sequences(docs: DataFrame, ids) -> DataFrame:
    """``ids``: a slice of texts in rows of about ``ROW_IDS``, ``NONE`` after each stretch of neighbouring frequent words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ids.value
        for batch in batches:
            for _, _, _, _, keys, same in split_words(batch.column(0), batch.column(1)):
                own, at = np.unique(keys, return_inverse=True)
                seq = table.find(own)[at]
                linked = np.zeros(len(seq), bool)        # to the next word
                linked[:-1] = same[:-1] & (seq[:-1] != NONE) & (seq[1:] != NONE)
                keep = linked.copy()
                keep[1:] |= linked[:-1]
                ends = np.flatnonzero(keep & ~linked)
                closed = np.insert(seq[keep], np.cumsum(keep)[ends], NONE)
                gaps = np.flatnonzero(closed == NONE) + 1
                rows = np.unique(gaps[np.searchsorted(gaps, np.arange(0, len(closed), ROW_IDS), "right")]) if len(gaps) else gaps
                rows = np.unique(np.concatenate(([0], rows, [len(closed)])))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(closed))], ["ids"])

    return docs.mapInArrow(encode, "ids array<long>")


def climbed(seq: np.ndarray, levels: list[Ids]) -> np.ndarray:
    """The sequence of word ids as one of phrase ids, level by level; ``NONE`` where no frequent phrase starts."""
    for level in levels:
        a, b = seq[:-1], seq[1:]
        at = np.flatnonzero((a != NONE) & (b != NONE))
        seq = np.full(max(len(seq) - 1, 0), NONE, np.int64)
        seq[at] = level.find(pair_keys(a[at], b[at]), a[at], b[at])
    return seq


def tile_counts(a: np.ndarray, b: np.ndarray, dense_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct pairs and their numbers: dense tiles by ``bincount``, the others by sorted coordinates."""
    ranked = (a >= 0) & (b >= 0)
    if not ranked.all():
        order = np.lexsort((b[~ranked], a[~ranked]))
        x, y = a[~ranked][order], b[~ranked][order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        yield x[first], y[first], np.diff(np.append(first, len(x)))
        a, b = a[ranked], b[ranked]
    side = 1 << TILE_BITS
    tile = (a >> TILE_BITS << 32) | (b >> TILE_BITS)
    tiles, at, size = np.unique(tile, return_inverse=True, return_counts=True)
    cell = ((a & (side - 1)) << TILE_BITS) | (b & (side - 1))
    for t in np.flatnonzero(size >= dense_pairs):
        n = np.bincount(cell[at == t], minlength=side * side)
        full = np.flatnonzero(n)
        yield ((tiles[t] >> 32 << TILE_BITS) | (full >> TILE_BITS), ((tiles[t] & 0xFFFFFFFF) << TILE_BITS) | (full & (side - 1)), n[full])
    rest = (size < dense_pairs)[at]
    code, n = np.unique((a[rest] << 32) | b[rest], return_counts=True)
    yield code >> 32, code & 0xFFFFFFFF, n


def pair_counts(sequences: DataFrame, levels, min_count: int, dense_pairs: int) -> DataFrame:
    """``(a, b, n)``: pairs of neighbouring ids of the top level found ``min_count`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = levels.value, [], 0

        def counted():
            a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            for x, y, n in tile_counts(a, b, dense_pairs):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):        # each row ends with NONE, so rows can stand side by side
                seq = climbed(batch.column(0).slice(lo, ROWS).flatten().to_numpy(zero_copy_only=False), tables)
                both = (seq[:-1] != NONE) & (seq[1:] != NONE)
                held.append((seq[:-1][both], seq[1:][both]))
                size += len(held[-1][0])
                if size >= CHUNK_PAIRS:
                    yield from counted()
                    held, size = [], 0
        if size:
            yield from counted()

    found = sequences.mapInArrow(count, "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def frequent_phrases(docs: DataFrame, min_count: int = 30, max_words: int = 4, lang: str = "lang", text: str = "text",
                     head: int = HEAD, dense_pairs: int = DENSE_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: ``lang, phrase, words, n`` of every phrase of up to ``max_words`` words within a piece that
    is found ``min_count`` times or more, and ``lang, n`` of all words."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = materialize(word_counts(docs), "collocation-words")
    named, ids = rank(words.filter(F.col("n") >= min_count), head)
    form = named.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.lit(1).alias("words"), "n")
    forms, levels = [materialize(form, "collocation-forms")], []
    sequences = materialize(id_sequences(docs, spark.sparkContext.broadcast(ids)), "collocation-ids")
    for size in range(2, max_words + 1):
        pairs = materialize(pair_counts(sequences, spark.sparkContext.broadcast(list(levels)), min_count, dense_pairs), "collocation-pairs")
        named, ids = rank(materialize(with_keys(pairs), "collocation-keys"), head)
        levels.append(ids)
        left = forms[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("start"))
        right = forms[-1].select(F.col("id").alias("b"), "last")
        form = named.join(left, "a").join(right, "b").select(
            "id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", F.lit(size).alias("words"), "n")
        forms.append(materialize(form, "collocation-forms"))
    out = forms[0]
    for f in forms[1:]:
        out = out.union(f)
    return out.select("lang", "phrase", "words", "n"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, inside_percent: int = 80, scale: int = 2_000_000,
                 limit: int = 2000, **options) -> DataFrame:
    """Each language's ``limit`` best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase's score is ``floor(scale * a / (l + r))`` at its worst cut in two; a phrase that stands inside a longer one with
    at least ``inside_percent`` of its count is left out. Arithmetic is in decimals of 38 digits."""
    phrases, totals = frequent_phrases(docs, min_count, max_words, **options)
    many = phrases.filter("words > 1").withColumn("w", F.split("phrase", " "))

    def part(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    k = F.col("k")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), k).alias("start"), part(k + 1, F.col("words") - k).alias("rest"))
    count = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("start"), F.col("n").alias("l")), ["lang", "start"]).join(
        count.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    exact = F.expr(f"(CAST({scale} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    longer = many.filter("words > 2").select("lang", "n", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(5,0)) * longer < CAST({inside_percent} AS DECIMAL(5,0)) * a"))
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    best = best.filter(F.col("rank") <= limit)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

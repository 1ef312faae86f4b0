"""The ``opN_*`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forestlens.llm import (chat, collocations, crf_quality, licenses, line_dedup, mixing, neardup, packing, periodic_runs,
                            quality_rules, sharding, suffix_dedup, topk)
from forestlens.llm.common import WORD_PATTERN, cell, materialize, table

SHARD_BYTES = 16 << 20
SEQUENCE = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = docs.withColumn("size", mixing.word_count("text"))
    mixed = mixing.mix(docs)
    return mixed.select("row.doc_id", "row.size", "source_size", "target",
                        (F.col("row.size") * F.col("copies")).alias("taken"), "copies")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neardup.near_duplicates(docs).select(F.col("doc").alias("doc_id"), F.col("class").alias("class_id"),
                                                (F.col("doc") == F.col("class")).alias("representative"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                      "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = crf_quality.fit(docs, table(spark, sf_dir, "labels"))
    out = crf_quality.score(docs, chain)
    return out.select("doc_id", (crf_quality.fold("doc_id") == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])

    def joined(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")

    doubt = F.aggregate("detections", F.lit(1.0), lambda p, d: p * (1 - d["confidence"]))
    starts = F.transform(base, lambda d: d["first_word"])
    return out.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                      F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
                      joined(F.col("detections")).alias("labels"), (1 - doubt).alias("score"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM "
                      "(SELECT explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS t)")
    formatted = materialize(chat.format_conversations(turns.union(probe)).select("conv_id", "formatted", "turns"), "chat-formatted")
    pieces = chat.read_turns(F.col("formatted"))
    lines = F.transform(pieces, lambda p: F.concat(chat.turn_role(p), F.lit("\n"), chat.turn_text(p), F.lit("\n")))
    loss = chat.masked_text(F.col("formatted"), F.col("turns"))
    return formatted.select(
        "conv_id", F.size(pieces).cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``documents`` with the tail of every tenth text (by crc32 of its id) made periodic, as op12 asks;
    a text without words, or without an id, stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all(cell("text"), F.lit(WORD_PATTERN), F.lit(0))))
    n = F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return words.withColumn("text", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text"))).drop("words")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = out.withColumn("top", periodic_runs.longest_power("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_near_duplicates, op3_quality_rules, op4_line_dedup, op5_pack_sequences, op6_line_quality,
        op7_top_inner_products, op8_extendible_shards, op9_license_rules, op10_chat_format, op11_collocations, op12_periodic_runs,
        op13_suffix_dedup)}


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos, lower_key.key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) u,
  LATERAL (SELECT translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key) lower_key),
shared AS (SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.line, l.pos, s.key IS NOT NULL AND l.doc_id <> s.first_doc AS gone FROM lines l LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q, good c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) sizes),
f AS (SELECT lang, k, phrase, count(*) AS n, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.n AS a, j, x.n AS l, y.n AS r,
         CAST(2000000 * CAST(c.n AS HUGEINT) // (x.n + y.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, j + 1, c.k), ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i:
         array_to_string(list_slice(w, i, i + m - 1), ' '))))) AS phrase, n FROM f WHERE k > 2),
longer AS (SELECT lang, phrase, max(n) AS n FROM inside GROUP BY lang, phrase),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer USING (lang, phrase)
  WHERE longer.n IS NULL OR 100 * CAST(longer.n AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


OP13_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (SELECT r, doc_id, i, b[i:i + 49] AS s FROM (SELECT *, unnest(range(1, octet_length(b) - 48)) AS i FROM texts) t),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
starts AS (SELECT r, i FROM strings JOIN firsts USING (s) WHERE doc_id > first),
marks AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM starts),
runs AS (
  SELECT r, min(i) AS a, max(i) + 49 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM marks) m GROUP BY r, run),
kept AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM runs
  UNION ALL SELECT t.r, coalesce(max(z), 0) + 1, octet_length(any_value(b)) FROM texts t LEFT JOIN runs ON runs.r = t.r GROUP BY t.r),
rest AS (SELECT k.r, unhex(string_agg(CASE WHEN y >= x THEN hex(b[x:y]) ELSE '' END, '' ORDER BY x)) AS bytes FROM kept k JOIN texts ON texts.r = k.r GROUP BY k.r),
sums AS (SELECT r, count(*) AS n, sum(z - a + 1) AS size FROM runs GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(size, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(bytes) AS kept_sha256
FROM texts JOIN rest ON rest.r = texts.r LEFT JOIN sums ON sums.r = texts.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op7_top_inner_products": OP7_SQL, "op11_collocations": OP11_SQL, "op13_suffix_dedup": OP13_SQL}

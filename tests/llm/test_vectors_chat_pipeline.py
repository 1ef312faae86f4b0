"""Top-k search, chat formatting, the pipeline and the registration."""

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from forestlens.llm import chat, topk
from tests.llm.fixtures import doc_rows, documents, labels


def brute_top(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.3, 16).astype(float).tolist()) for i in range(400)]
    rows += [(500, None), (501, [float("nan")] * 16), (502, [None] + [0.1] * 15), (None, [0.5] * 16), (450, [0.25, -0.5]), (451, []),
             (600, rows[3][1]), (601, rows[3][1]), (50, rows[50][1]), (700, [3e4] * 16), (503, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("block", F.lit("x"))
    for drop, block in ((2, 64), (0, 1000), (5, 100)):
        out = topk.top_k(df, F.col("vec_id") % 50 == 0, drop_bits=drop, row_block=block).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in out] == brute_top(rows)
    few = df.filter("vec_id in (0, 1, 2)")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == brute_top(rows[:3])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bit_sliced_sums():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-90, 90, (200, 7)), rng.integers(-60, 60, (5, 7))
    index = topk.BitSlicedIndex(v, 0)
    slices = index.sums(q)
    got = sum((topk.unpack_bits(s, 200).astype(np.int64) << w) for w, s in enumerate(slices))
    shifted = v - index.low
    want = np.array([[sum(abs(a) * (z if a >= 0 else index.top - z) for a, z in zip(own, row)) for row in shifted] for own in q])
    assert (got == want).all()


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip_and_mask(spark):
    rows = [(1, 1, "assistant", "b\\[TURN] <s>[/INST]\\e\\b"), (1, 0, "user", "[END][TURN]user[SAYS]"), (1, 2, "assistant", None), (2, None, None, "x"),
            (2, 0, "assistant", ""), (None, 0, "assistant", "é中🙂[SAYS]"), (3, 0, "user", "t"), (3, 0, "user", "t"), (3, 0, "ass[SAYS]istant", "u"),
            (4, 0, "assistant", "long " * 20_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("rendered", F.lit(1)).withColumn("v", F.lit(1))
    out = {r.conv_id: r for r in chat.format_conversations(df).select(
        "*", F.transform(chat.read_turns(F.col("formatted")), lambda p: F.struct(chat.turn_role(p).alias("r"), chat.turn_text(p).alias("t"))).alias("back"),
        chat.masked_text(F.col("formatted"), F.col("turns")).alias("loss")).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        back = [(b.r, b.t) for b in out[c].back]
        assert sorted(back) == sorted((r, x) for *_, r, x in turns) and out[c].n_turns == len(turns)
        keyed = sorted(turns, key=lambda t: t[:2])
        if len({t[:2] for t in turns}) == len(turns):
            assert back == [(r, x) for *_, r, x in keyed]
        assert out[c].loss == "".join(x for *_, r, x in keyed if r == "assistant")
        inner = out[c].formatted
        for mark in (chat.TURN, chat.SAYS, chat.END):
            inner = inner.replace(mark, "")
        assert "[" not in inner and "<" not in inner
        for t in out[c].turns:
            assert out[c].formatted[t.start:].startswith(chat.TURN)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see [this] ", None, None), ("image", None, "a.png", 2), ("audio", "ignored", "b.wav", None), ("text", "end", None, None), (None, "odd", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", [("document", None, "c.pdf", 3)]), (1, 2, "user", None), (1, 3, "user", [])],
                               f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_conversations(df, parts=F.col("content")).select("*", chat.masked_text(F.col("formatted"), F.col("turns")).alias("loss")).first()
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 25), ("document", "c.pdf", 2400)]
    assert all(r.formatted[a.start:].startswith(f"[{a.type.upper()}]") for a in r.attachments) and r.attachment_tokens == 2937
    assert r.loss == "see [this] endodd" and r.formatted.count("[IMAGE]") == 1


def test_pipeline_stages(spark, tmp_path):
    docs, marks = documents(spark), labels(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    now, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        counts.append(now.count())
    assert 0 < counts[0] < len(doc_rows()) and counts[2] <= counts[1] == counts[0] and counts[4] >= counts[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_queries_on_the_small_tables(spark):
    """Each query runs over its whole table; one row per document or conversation."""
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, query in entry.queries().items():
        if name.startswith(("op1_", "op2_", "op3_", "op4_", "op6_", "op8_", "op9_")):
            assert query(spark, sf).count() == n, name
    convs = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    out = entry.queries()["op10_chat_format"](spark, sf)
    assert out.count() == convs + 1
    probe = out.filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert probe.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and probe.loss_chars == len(text)
    assert probe.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()

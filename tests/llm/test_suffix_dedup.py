"""Repeated strings against a dictionary of all strings; suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest

from forestlens.llm import queries, suffix_dedup as sd
from tests.llm.fixtures import clashing, doc_rows, documents, sentence

LAST = 2**63 - 1


def brute(rows):
    firsts = {}
    texts = [(LAST if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for d, b in texts:
        for i in range(len(b) - 49):
            s = b[i:i + 50]
            firsts[s] = min(firsts.get(s, d), d)
    out = []
    for (d, b), r in zip(texts, rows):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 49):
            if firsts[b[i:i + 50]] < d:
                gone[i] += 1
                gone[i + 50 if i + 50 <= len(b) else len(b)] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((r[0], len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def order(r):
    return tuple((x is None, x or 0) if not isinstance(x, (list, bytes)) else (False, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [r for r in doc_rows() if len(r[1] or "") < 20_000]
    shared = [sentence(rng, 40) for _ in range(4)]
    out += [(3000 + i, sentence(rng, 5) + " " + rng.choice(shared)[rng.randint(0, 60):] + " " + sentence(rng, 5), "en", "a", 0) for i in range(60)]
    out += [(4000 - i, "x" * (40 + 7 * i), "en", "a", 0) for i in range(20)]
    out += [(4100 + i, "ab" * 40 + "é中\x00" * (10 + i), "en", "a", 0) for i in range(6)]
    out += [(4200, "q" * 49, "en", "a", 0), (4201, "q" * 49, "en", "a", 0), (4202, "p" * 50, None, None, 0), (4203, "p" * 50, None, None, 0),
            (4203, "p" * 50, None, None, 0), (4204, "r" * 50, None, None, 0), (4204, "r" * 51, None, None, 0), (-5, shared[0], "en", "a", 0)]
    return out


def test_suffix_array_sorts():
    rng = np.random.default_rng(5)
    for trial in range(60):
        letters = [2, 3, 30, 256][trial % 4]
        base = [rng.integers(0, letters, 84) for _ in range(4)]
        segs = []
        for _ in range(rng.integers(1, 12)):
            s = base[rng.integers(0, 4)].copy()[rng.integers(0, 20):]
            if rng.random() < 0.5:
                s[rng.integers(0, len(s))] = rng.integers(0, letters)
            segs.append(s if rng.random() < 0.9 else np.zeros(60, int))
        sym = np.concatenate([np.append(s + 1, 0) for s in segs]).astype(np.uint16)
        sa = sd.suffix_array(sym, sd.packed(sym))
        assert sorted(sa.tolist()) == list(range(len(sym)))
        ends = np.flatnonzero(sym == 0)
        own = [tuple(sym[i:ends[np.searchsorted(ends, i)] + 1]) for i in sa]
        assert own == sorted(own)
        wanted = rng.random(len(sym)) < 0.3
        some = sd.suffix_array(sym, sd.packed(sym), wanted, 20)
        assert set(np.flatnonzero(wanted)) <= set(some.tolist()) and len(set(some.tolist())) == len(some)
        own = [tuple(sym[i:ends[np.searchsorted(ends, i)] + 1])[:20] for i in some]
        assert own == sorted(own)
        size, doc = np.array([len(s) for s in segs]), rng.integers(0, 9, len(segs))
        firsts = {}
        for s, d in zip(segs, doc):
            for i in range(len(s) - 49):
                firsts[tuple(s[i:i + 50])] = min(firsts.get(tuple(s[i:i + 50]), 9), d)
        got = {(k, i): f for k, lo, hi, f in zip(*(x.tolist() for x in sd.first_documents(np.concatenate(segs).astype(np.uint8), size, doc))) for i in range(lo, hi + 1)}
        assert got == {(k, i): firsts[tuple(s[i:i + 50])] for k, s in enumerate(segs) for i in range(len(s) - 49)}


def test_segments_hold_every_string_once():
    rng = random.Random(6)
    texts = [sentence(rng, rng.randint(0, 60)).encode() for _ in range(30)] + [b"", b"z" * 49, b"z" * 50, b"z" * 500, b"ab" * 90]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    anchor, start, size, doc = sd.segments(data, offsets)
    held, by = [], {}
    for a, s, n, d in zip(anchor.tolist(), start.tolist(), size.tolist(), doc.tolist()):
        assert 0 < n <= sd.SPAN and offsets[d] <= s and s + n + 49 <= offsets[d + 1]
        held += range(s, s + n)
        for i in range(s, s + n):
            assert by.setdefault(bytes(data[i:i + 50]), a) == a
    assert held == [int(o) + i for o, t in zip(offsets, texts) for i in range(len(t) - 49)]


@pytest.mark.parametrize("hot,wide,bitmap", [(sd.HOT, sd.WIDE, sd.BITMAP_ANCHORS), (3, 2, sd.BITMAP_ANCHORS), (4, sd.WIDE, sd.BITMAP_ANCHORS), (2, 1, 0)])
def test_operator(spark, rows, hot, wide, bitmap, monkeypatch):
    """Also where anchors are hot, where they are wide, and where they are joined instead of kept as a bitmap."""
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "WIDE", wide)
    monkeypatch.setattr(sd, "BITMAP_ANCHORS", bitmap)
    out = sd.dedup_strings(clashing(documents(spark, rows)).repartition(5)).select("row.doc_id", "n_bytes", "n_removed", "spans", "kept").collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in out]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_chunks_end_where_an_anchor_does(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(sd, "CHUNK_ROWS", 7)
    rng = random.Random(2)
    anchor = sorted(rng.randint(0, 30) for _ in range(200))
    batches, lo = [], 0
    while lo < 200:
        hi = min(200, lo + rng.randint(0, 25))
        batches.append(pa.RecordBatch.from_arrays([pa.array(anchor[lo:hi], pa.int64()), pa.array([b"x"] * (hi - lo))], ["anchor", "seg"]))
        lo = hi
    parts = [t["anchor"].to_pylist() for t in sd.chunks(iter(batches))]
    assert sum(parts, []) == anchor and all(a[-1] != b[0] and len(a) >= 7 for a, b in zip(parts, parts[1:])) and len(parts) > 4


def test_small_chunks_and_pieces(rows, monkeypatch):
    """Texts cut into overlapping pieces hold the same strings under the same anchors."""
    monkeypatch.setattr(sd.T, "SLICE_BYTES", 100)
    import pyarrow as pa
    text = "".join(r[1] or "" for r in rows[:20])
    seen = {}
    for _, data, offsets, base in sd.pieces(pa.array([text])):
        for a, s, n, _ in zip(*(x.tolist() for x in sd.segments(data, offsets))):
            seen |= {base + i: a for i in range(s, s + n)}
    whole = sd.segments(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert seen == {i: a for a, s, n, _ in zip(*(x.tolist() for x in whole)) for i in range(s, s + n)}


def test_query_and_empty(spark, rows, tmp_path):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_suffix_dedup(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = [(d, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute(rows)]
    assert sorted(map(tuple, out.collect()), key=order) == sorted(want, key=order)
    assert sd.dedup_strings(documents(spark, [])).count() == 0
    assert sd.dedup_strings(documents(spark, [(1, None, None, None, None)])).select("n_bytes", "n_removed").first() == (0, 0)


def test_unshared_segments_do_not_travel(spark, monkeypatch):
    """Where the anchors of two documents are too many for one bitmap, texts that share nothing cost no segments on the way: the bytes that all
    steps hand on stay near those of the texts."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2_500)) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, texts[3][100:400]), (901, texts[5])], "doc_id long, text string").repartition(3).localCheckpoint()
    handed, plain = spark.sparkContext.accumulator(0), DataFrame.mapInArrow

    def counted(self, f, schema, *a, **b):
        def sizes(batches):
            for batch in f(batches):
                handed.add(sum(batch.column(c).drop_null().nbytes for c in batch.schema.names))
                yield batch

        return plain(self, sizes, schema, *a, **b)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    monkeypatch.setattr(sd, "BITMAP_ANCHORS", 0)
    out = {r.doc_id: r.n_removed for r in sd.dedup_strings(docs).select("row.doc_id", "n_removed").collect()}
    assert {d: n for d, n in out.items() if n} == {900: 300, 901: 2_500} and len(out) == 802
    assert 0 < handed.value < 4 * sum(map(len, texts))


@pytest.mark.parametrize("hot,wide,bitmap", [(sd.HOT, sd.WIDE, 0), (sd.HOT, sd.WIDE, sd.BITMAP_ANCHORS), (3, 2, 0)])
def test_many_small_buckets(spark, rows, hot, wide, bitmap, monkeypatch):
    """Texts in many buckets, anchors in many ranges, blocks and flushes of a few rows, and copies of texts under smaller, larger, equal and null ids."""
    for name, value in (("HOT", hot), ("WIDE", wide), ("BITMAP_ANCHORS", bitmap), ("PART_BYTES", 3_000), ("HELD_BYTES", 5_000), ("HELD_KEYS", 500),
                        ("HELD_ROWS", 100), ("BLOCK_BYTES", 700), ("ROWS_EACH", 300)):
        monkeypatch.setattr(sd, name, value)
    some = [r for r in rows if len(r[1] or "") < 3_000][:120]
    some += [(i, *r[1:]) for r in some[::3] for i in (-7 - r[0] if r[0] is not None else 7, None, 9000)] + some[:9] + [(9001, "z" * 49, "en", "a", 0)]
    out = sd.dedup_strings(documents(spark, some).repartition(5)).select("row.doc_id", "n_bytes", "n_removed", "spans", "kept").collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in out]
    assert sorted(got, key=order) == sorted(brute(some), key=order)


def test_blocks_hold_what_was_put_in():
    rng = np.random.default_rng(3)
    numbers = rng.integers(-2**63, 2**63 - 1, (3, 50))
    n, size, block = sd.to_block(numbers, b"bytes behind")
    back, data = sd.from_block(n, size, block, 3)
    assert (back == numbers).all() and data.tobytes() == b"bytes behind"
    slots = np.unique(rng.integers(0, sd.BITMAP_BITS, 5_000))
    bitmap = np.zeros(sd.BITMAP_BITS // 64, np.uint64)
    sd.add_slots(bitmap, slots)
    assert (sd.words(slots, 0, len(bitmap) - 1) == bitmap).all() and sd.marked(bitmap, slots.astype(np.uint64) + np.uint64(1 << 40)).all()
    assert np.unpackbits(bitmap.view(np.uint8)).sum() == len(slots)
    edges = sd.key_edges(37)
    assert edges[0] == 0 and edges[-1] == 1 << sd.KEY_BITS and (edges[:-1] * 37 >> sd.KEY_BITS == np.arange(37)).all()
    assert ((edges[1:] - 1) * 37 >> sd.KEY_BITS == np.arange(37)).all()


def test_a_string_in_every_text_has_few_entries(spark):
    """Entries of an anchor are put together by bucket, and still count its segments and texts."""
    rng = random.Random(4)
    common = sentence(rng, 30)
    docs = spark.createDataFrame([(i, 0, f"{sentence(rng, 8)} {common} {sentence(rng, 8)}") for i in range(400)], "doc long, rk long, text string")
    texts = sd.distinct_texts(docs.repartition(2), 8).localCheckpoint()
    entries = {}
    for r in sd.anchor_blocks(texts, 5).collect():
        (key, bucket, n, of_texts), _ = sd.from_block(r.n, r.size, r.block, 4)
        for k, b, x, t in zip(np.cumsum(key).tolist(), bucket.tolist(), n.tolist(), of_texts.tolist()):
            assert k * 5 >> sd.KEY_BITS == r["at"]
            entries.setdefault(k, []).append((b, x, t))
    everywhere = [e for e in entries.values() if sum(t for _, _, t in e) == 400]
    assert everywhere and all(len(e) == len({b for b, _, _ in e}) <= 8 and sum(x for _, x, _ in e) >= 400 for e in everywhere)
    out = sd.shared_anchors(texts, 5, 8).agg({"anchors": "sum", "most": "max"}).first()
    assert out["sum(anchors)"] == sum(sum(t for _, _, t in e) > 1 for e in entries.values()) and out["max(most)"] >= 400

"""Periodic runs against a direct scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forestlens.llm import periodic_runs, queries, textops
from tests.llm.fixtures import clashing, doc_rows, documents

WORD = re.compile("[^\x20\x09-\x0D]+")


def scan(w):
    """Every maximal stretch of every period up to a quarter of the words; one row a stretch, with its smallest period."""
    x = np.array([hash(v) for v in w])
    found = {}
    for q in range(1, len(w) // 4 + 1):
        edge = np.diff(np.concatenate(([0], (x[q:] == x[:-q]).astype(int), [0])))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest_row(doc_id, text):
    w = planted(doc_id, text)
    runs = scan(w)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = None
    for s, q, n in runs:
        if top is None or n * top[1] > top[2] * q:
            top = (s, q, n)
    cells = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (doc_id, len(runs), *cells, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_words(rng):
    words = []
    for _ in range(rng.randint(0, 7)):
        letters, p = rng.choice([1, 2, 3, 6, 60]), rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40])
        base = [rng.randint(0, letters) for _ in range(p)]
        if rng.random() < 0.4:      # a power inside a power
            base = (base[:rng.randint(1, 3)] * 40)[:p] + [rng.randint(0, letters)]
        words += [base[i % len(base)] for i in range(rng.choice([rng.randint(0, 9), 4 * p - 1, 4 * p, 4 * p + 1, rng.randint(0, 7 * p)]))]
    return words


def test_runs_of_random_powers():
    rng = random.Random(3)
    for _ in range(150):
        docs = [periodic_words(rng) for _ in range(rng.randint(1, 5))]
        h = textops.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(7))
        bounds = np.cumsum([0] + [len(d) for d in docs])
        got = periodic_runs.runs(h, bounds)
        for k, d in enumerate(docs):
            assert [(s - bounds[k], q, n) for j, s, n, q in got.tolist() if j == k] == scan(d)


def test_long_period_and_long_words(monkeypatch):
    rng = random.Random(4)
    base = [rng.randint(0, 900) for _ in range(5000)]
    got = periodic_runs.runs(textops.mix(np.array([901, *base * 5, 902], np.uint64)), np.array([0, 25_002]))
    assert got.tolist() == [[0, 1, 25_000, 5000]]
    text = (" ".join(["a" * 50, "b", "c" * 70]) + " ") * 40
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = textops.words(data, np.array([0, len(data)]))
    for name, value in (("LONG_WORD", 60), ("LONG_WORD", 10)):
        monkeypatch.setattr(periodic_runs, name, value)
        monkeypatch.setattr(textops, "SLICE_BYTES", 100)
        h = periodic_runs.word_hashes(data, starts, ends)
        assert len(set(h.tolist())) == 3 and (h[:-3] == h[3:]).all()
        assert periodic_runs.joined(data, starts, ends, np.zeros(len(starts), int), 1).to_pylist() == [text.strip()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = doc_rows()
    out += [(1000 + i, rng.choice([" ", "\n", "\t\x0b "]).join(f"w{x}" for x in periodic_words(rng)), "en", "a", 0) for i in range(150)]
    return out + [(2000, "x " * 3000, "en", "a", 0), (2001, "é 中文\x00 " * 9, None, None, 0), (2002, "a a a a a", "en", "a", 0)]


def test_operator_and_query(spark, rows, tmp_path):
    df = documents(spark, rows)
    got = periodic_runs.find_runs(clashing(df)).select("row.doc_id", "row.text", "n_words", "runs", "collapsed").collect()
    assert len(got) == len(rows)
    for r in got:
        w = WORD.findall(r.text or "")
        want = scan(w)
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        assert r.n_words == len(w) and [(x.start, x.period, x.length) for x in r.runs] == want
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    clashing(df).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert [c for c, _ in out.dtypes] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in out.dtypes if not c.endswith("sha256")} == {"bigint"}
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=order) == sorted((digest_row(r[0], r[1]) for r in rows), key=order)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, sf).collect()))
    assert got == sorted(digest_row(*d) for d in docs) and any(r[1] for r in got)


def test_empty_table(spark):
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0
    assert periodic_runs.find_runs(documents(spark, [(1, None, None, None, None)])).select(
        "n_words", "collapsed", periodic_runs.longest_power(F.col("runs")).alias("top")).first() == (0, "", None)

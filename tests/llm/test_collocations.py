"""Phrase collocations against counting by hand, with whole and with tiny rank tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from forestlens.llm import collocations as col, queries
from tests.llm.fixtures import clashing, doc_rows, documents

PIECE, WORD = re.compile("[.,;:!?\x0A-\x0D]"), re.compile("[^\x20\x09]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def counted(rows, most=4):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, total


def brute(rows, min_count, limit=2000):
    f, total = counted(rows)
    out = []
    for lang in f:
        many = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        ranked = []
        for p, a in many.items():
            if 100 * longer[p] < 80 * a or not longer[p]:
                s, _, left, right = min((2_000_000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:limit]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    phrases = ["new york city", "in vitro", "of the", "ad hoc basis now", "É é ü", "state of the art work", "a a a a a"]
    out = doc_rows()
    for i in range(300):
        bits = [rng.choice(phrases + [f"w{rng.randint(0, 40)}"] * 8) for _ in range(rng.randint(0, 60))]
        text = "".join(b + rng.choice([" ", "  ", "\t", ", ", ".\n", "\x0b"]) for b in bits)
        out.append((5000 + i, text.title() if i % 3 else text, rng.choice(["en", "de", None, "und", "x" if i < 3 else "en"]), "a", 0))
    return out + [(9000, "same words here " * 4000, "de", "a", 0), (9001, "\x00 nul \x00", "en", "a", 0)]


@pytest.mark.parametrize("head,dense", [(col.HEAD, 50), (7, 10**9), (40, 1)])
def test_against_counting(spark, rows, head, dense):
    df = clashing(documents(spark, rows)).repartition(5)
    got = col.collocations(df, min_count=5, limit=40, head=head, dense_pairs=dense).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 40)


def test_all_frequent_phrases(spark, rows):
    f, total = counted(rows)
    phrases, totals = col.frequent_phrases(documents(spark, rows), min_count=4)
    assert {(r.lang, r.phrase, r.words, r.n) for r in phrases.collect()} == {
        (lang, " ".join(p), len(p), n) for lang in f for p, n in f[lang].items() if n >= 4}
    assert {r.lang: r.n for r in totals.collect()} == {k: n for k, n in total.items() if n}


def test_tiles_count_alike():
    rng = np.random.default_rng(3)
    a, b = (np.minimum(rng.zipf(1.3, 20_000), 5000) for _ in range(2))
    a[:50] = -5
    want = Counter(zip(a.tolist(), b.tolist()))
    for dense in (1, 30, 10**9):
        got = [t for x, y, n in col.tile_counts(a, b, dense) for t in zip(x.tolist(), y.tolist(), n.tolist())]
        assert len(got) == len(want) and all(want[x, y] == n for x, y, n in got)


def test_exact_at_large_counts(spark, monkeypatch):
    """Products beyond 64 bits, ties and the limit, on counts given outright."""
    big = 6 * 10**18
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "c", 1, 3), ("en", "a b", 2, big - 2), ("en", "b c", 2, 3),
                                     ("en", "a b c", 3, 3)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    monkeypatch.setattr(col, "frequent_phrases", lambda *_, **__: (phrases, totals))
    out = {r.phrase: r for r in col.collocations(documents(spark, [])).collect()}
    assert set(out) == {"a b", "a b c"}
    assert out["a b"].score == 2_000_000 * (big - 2) // (2 * big - 1) and out["a b c"].score == 0 and out["a b c"].l == big


def test_empty_and_registered(spark):
    assert col.collocations(documents(spark, [])).count() == 0
    assert col.collocations(documents(spark, [(1, None, None, None, None), (2, " . ", "en", None, 0)])).count() == 0
    sf = "/root/testdata/sf0.001"
    rows = [(0, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    got = queries.op11_collocations(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase")) and sorted(map(tuple, got.collect())) == brute(rows, 30)


def test_small_rows_and_chunks(spark, rows, monkeypatch):
    """Sequences in many rows, pairs in many chunks: the same counts (the numbers reach the tasks with the functions)."""
    want = sorted(map(tuple, col.frequent_phrases(documents(spark, rows), min_count=4)[0].collect()))
    seq = np.array([3, 4, col.NONE, 5, 6, 7, col.NONE])
    assert col.climbed(seq, []).tolist() == seq.tolist()
    few = documents(spark, rows).repartition(9)
    assert sorted(map(tuple, col.frequent_phrases(few, min_count=4, dense_pairs=2)[0].collect())) == want

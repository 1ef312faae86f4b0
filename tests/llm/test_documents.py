"""Operators over documents against brute force, on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from forestlens.llm import crf_quality, licenses, line_dedup, mixing, neardup, packing, quality_rules, sharding
from tests.llm.fixtures import clashing, doc_rows, documents, labels

WORD = re.compile("[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(documents(spark))


# --- mixing -------------------------------------------------------------------------

def brute_targets(sizes, weights, total, most=3.0):
    capped = {}
    while True:
        rest, weight = total - sum(capped.values()), sum(weights[k] for k in sizes if k not in capped)
        over = [k for k in sizes if k not in capped and rest * weights[k] / weight > most * sizes[k]]
        if not over:
            return {k: capped.get(k, rest * weights[k] / weight if weight else 0) for k in sizes}
        capped |= {k: most * sizes[k] for k in over}
        if len(capped) == len(sizes):
            return capped


def test_mixing_targets_and_near_budgets(spark, docs):
    rows = doc_rows()
    sizes, largest = Counter(), Counter()
    for _, t, _, s, _ in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()))
    out = mixing.mix(docs.withColumn("n", mixing.word_count("text"))).select("row.source", "row.n", "target", "copies").collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.n * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_mixing_is_nested_and_repeats(spark):
    docs = documents(spark)

    def take(budget):
        return Counter({(r.doc_id, r.text): r.copies for r in mixing.mix(docs, budget=budget).select("row.doc_id", "row.text", "copies").collect()})

    small, large = take(0.3), take(0.7)
    assert take(0.3) == small and all(large[k] >= c for k, c in small.items())


def test_mixing_boundary_of_equal_hashes(spark):
    """One row repeated many times has one hash: taken or left as a whole, near the budget's side."""
    docs = documents(spark, [(1, "a b c d", "en", "s", 7)] * 40 + [(i, "a b", "en", "t", 3) for i in range(2, 90)])
    out = mixing.mix(docs).groupBy("row.source").agg(F.collect_set("copies").alias("c")).collect()
    assert all(len(r.c) == 1 for r in out if r.source == "s")


# --- quality rules --------------------------------------------------------------------

def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_measures_and_base_gate(spark, docs):
    extra = ["x y z\nx y z\n\nx y z ", " ".join(["a b c d e f g h i"] * 4), "w " * 19, "\n\n", "é€😀 " * 25]
    rows = doc_rows() + [(900 + i, t, "en", "a", 0) for i, t in enumerate(extra)]
    out = quality_rules.judge(clashing(documents(spark, rows)), labels(spark)).select("row.text", "m.*", "base_failed", "kept").collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_binomial_bound_is_exact():
    for n, p, d in ((100, 0.05, 0.01), (1000, 0.01, 0.001), (10, 0.5, 0.05)):
        x = quality_rules.largest_passing(n, p, d)
        assert (x < 0 or quality_rules.binomial_cdf(x, n, p) <= d) and quality_rules.binomial_cdf(x + 1, n, p) > d
    assert quality_rules.largest_passing(5, 0.01, 0.05) == -1


def test_quality_rules_keep_the_limit_and_reject_junk(spark):
    rows, marks = [], []
    for i in range(3000):
        lang = "en" if i % 3 else "de"
        bad = i % 5 == 0
        text = " ".join(f"word{i}x{j}" + ("%%%" if bad else "") for j in range(25))
        rows.append((i, text, lang, "a", 0))
        marks.append((i, 0 if bad else 1, 0))
    docs, marks = documents(spark, rows), labels(spark, marks)
    out = {r.doc_id: r.kept for r in quality_rules.judge(docs, marks, max_false_rejection=0.02).select("row.doc_id", "kept").collect()}
    assert all(out[i] == (i % 5 != 0) for i in out)
    none = quality_rules.judge(docs, marks.filter("doc_id < 50")).filter("not kept").count()
    assert none == 0                          # too little evidence: the rules stay off
    assert quality_rules.judge(docs, marks.limit(0)).filter("not kept").count() == 0
    assert quality_rules.kept_documents(docs, marks, max_false_rejection=0.02).columns == docs.columns


def test_quality_rules_pool_languages_too_small_for_a_proof(spark):
    rows, marks = [], []
    for i in range(2000 + 6 * 60 + 9):
        lang = "en" if i < 2000 else f"rare{(i - 2000) % 6}" if i < 2360 else "unlabelled"
        bad = i % 5 == 0
        rows.append((i, " ".join(f"word{i}x{j}" + ("%%%" if bad else "") for j in range(25)), lang, "a", 0))
        marks += [(i, 0 if bad else 1, 0)] if i < 2360 else []
    docs, marks = documents(spark, rows), labels(spark, marks)
    out = quality_rules.judge(docs, marks, max_false_rejection=0.02).select("row.doc_id", "kept").collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in out if r.doc_id < 2360)
    assert all(r.kept for r in out if r.doc_id >= 2360)


def test_quality_evidence_goes_by_good_labels():
    level = 0.05 / len(quality_rules.RULES)
    inf = float("inf")
    assert quality_rules.evidence({}, 0.005, 0.05) == (inf, inf, level)
    assert quality_rules.evidence({400: 2, 100: 3}, 0.005, 0.05) == (inf, inf, level)          # one pool of all
    assert quality_rules.evidence({3000: 1, 2000: 1}, 0.005, 0.05) == (2000, 2000, level / 2)  # no pool needed
    assert quality_rules.evidence({3000: 1, 400: 3}, 0.005, 0.05) == (3000, 3000, level / 2)
    assert quality_rules.evidence({5000: 1, 3000: 1, 40: 2}, 0.005, 0.05) == (3000, 3001, level / 3)   # the pool needs the smaller


# --- line de-duplication ------------------------------------------------------------------

def test_line_dedup(spark, docs):
    rows = doc_rows()
    top = 2**63 - 1
    where = defaultdict(set)
    key = lambda x: lower(x.strip(SPACE))
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            where[key(x)].add(top if i is None else i)
    shared = {k for k, ids in where.items() if len(k) >= 10 and len(ids) >= 2}
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in shared or min(where[key(x)]) == (top if i is None else i)]
        want[i, "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    out = line_dedup.dedup_lines(docs).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, out)) == want and shared
    back = line_dedup.deduplicated_documents(docs)
    assert back.columns == docs.columns and back.filter("n_chars <> length(text)").isEmpty()


# --- near duplicates -------------------------------------------------------------------------

def brute_classes(rows, threshold=0.8):
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({(): 1})

    top = 2**63 - 1
    sets = [shingles(r[1]) for r in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a.keys() & b.keys() and sum((a & b).values()) >= threshold * sum((a | b).values()):
                part[find(i)] = find(j)
    ids = [top if r[0] is None else r[0] for r in rows]
    smallest = {}
    for i in range(len(rows)):
        smallest[find(i)] = min(smallest.get(find(i), top), ids[i])
    return Counter((ids[i], smallest[find(i)]) for i in range(len(rows)))


def test_near_duplicates(spark, docs):
    rows = doc_rows()
    out = neardup.near_duplicates(docs).select("doc", "class").collect()
    assert Counter(map(tuple, out)) == brute_classes(rows)
    kept = neardup.distinct_documents(docs)
    assert kept.columns == docs.columns
    classes = {c for _, c in brute_classes(rows)}
    assert Counter(2**63 - 1 if r.doc_id is None else r.doc_id for r in kept.collect()).keys() == classes


def test_near_duplicates_large_group(spark):
    """A group of near copies larger than all else: idf must not push its members apart."""
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[(7 * i) % 120] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    rows += [(1000 + i, " ".join(f"other{i}x{j}" for j in range(60)), "en", "a", 0) for i in range(200)]
    out = {r.doc: r["class"] for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert all(out[i] == 0 for i in range(300)) and all(out[1000 + i] == 1000 + i for i in range(200))


def test_settled_links_connect_what_all_pairs_connect(spark):
    """Sets that span Arrow batches; members like some, not all, of the others."""
    rng = np.random.default_rng(3)
    lists = {}
    for n in range(60):
        h = np.unique(np.concatenate([np.arange(40) + 4 * (n % 20), rng.integers(1000, 2000, 3)])).astype("<u8")
        lists[n] = (h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), rng.choice([0.8, 1.0, 2.0], len(h)).astype("<f4").tobytes())
    sets = [list(range(lo, lo + 12)) for lo in range(0, 48, 6)] + [list(range(12))]
    table = spark.createDataFrame([(n, h, w) for n, (h, w) in lists.items()], "node long, hashes binary, weights binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = neardup.settled_links(spark.createDataFrame([(s,) for s in sets], "nodes array<long>"), table, 0.4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def alike(i, j):
        parts = [(neardup._hashes(lists[n][0]), np.frombuffer(lists[n][1], "<f4").astype(float)) for n in (i, j)]
        return neardup.weighted_jaccard(*parts[0], *parts[1]) >= 0.4

    def classes(pairs):
        of = list(range(60))
        for a, b in pairs:
            of = [of[a] if o == of[b] else o for o in of]
        return [of.index(o) for o in of]

    every = [(i, j) for s in sets for i in s for j in s if i < j and alike(i, j)]
    assert every and classes(map(tuple, out)) == classes(every)
    assert set(map(tuple, out)) <= set(every)


def linked_classes(spark, texts, alike=neardup.ROWS):
    """Classes by ``links`` where all texts share the first ``alike`` samples (by default the bucket of the first band only), and by brute force."""
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    none = np.zeros(0, np.uint64)
    weights = spark.sparkContext.broadcast(neardup.Weights(none, none, 2, len(texts), 0.25))
    own = F.unhex(F.concat(*[F.sha2(F.concat_ws(" ", F.lit(k), "doc"), 256) for k in range(6)]))
    sig = F.concat(F.lit(bytes(4 * alike)), F.substr(own, F.lit(1), F.lit(4 * (neardup.SAMPLES - alike))))
    nodes = neardup.signatures(docs, weights, "doc_id", "text").select(F.xxhash64("words").alias("node"), F.col("doc").alias("rep"), sig.alias("sig"), "size")
    nodes = neardup.materialize(nodes, "test-nodes")
    of = {r.node: r.rep for r in nodes.collect()}
    found = [(of[r.a], of[r.b]) for r in neardup.links(nodes, docs.select(F.col("doc_id").alias("doc"), "text"), weights, 0.8).collect()]
    part = list(range(len(rows)))
    for a, b in found:
        part = [part[a] if o == part[b] else o for o in part]
    return Counter((i, part.index(part[i])) for i in range(len(rows))), brute_classes(rows)


def test_large_bucket_links_through_matched_members(spark):
    """Pairs B-C in a bucket of over 32 nodes: B is like the core, C like B but not like the core."""
    texts, core = [], [f"core{j}" for j in range(100)]
    for i in range(60):
        texts.append(" ".join(core + [f"own{i}"]))
    for i in range(12):
        texts.append(" ".join(core + [f"b{i}x{j}" for j in range(18)]))
        texts.append(" ".join(core + [f"b{i}x{j}" for j in range(36)]))
    got, want = linked_classes(spark, texts)
    assert got == want and len({c for _, c in want}) == 1


def test_large_bucket_of_strangers_keeps_its_pairs(spark):
    """Pairs on one template in one bucket: strangers are alike below the threshold, further samples differ."""
    core, texts = [f"core{j}" for j in range(100)], []
    for i in range(150):
        own = [f"p{i}x{j}" for j in range(20)]
        texts += [" ".join(core + own), " ".join(core + own[:-3] + [f"q{i}x{j}" for j in range(3)])]
    got, want = linked_classes(spark, texts)
    assert got == want and Counter(Counter(c for _, c in want).values()) == {2: 150}


def test_large_buckets_that_no_sample_splits(spark):
    """Strangers that share all samples: more of them than leaders, and none is dropped."""
    core, texts = [f"core{j}" for j in range(100)], []
    for i in range(150):
        own = [f"p{i}x{j}" for j in range(20)]
        texts += [" ".join(core + own), " ".join(core + own[:-3] + [f"q{i}x{j}" for j in range(3)])]
    got, want = linked_classes(spark, texts, neardup.SAMPLES)
    assert got == want and Counter(Counter(c for _, c in want).values()) == {2: 150}


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64))
    w1, w2 = rng.choice([0.8, 1.0, 2.0, 3.0], 400), rng.choice([0.8, 1.0, 2.0, 3.0], 400)
    exact = neardup.weighted_jaccard(h, w1, h, w2)
    assert abs(exact - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 1e-9
    same = []
    for k in range(60):
        own = neardup.textops.mix(h + np.uint64(k))
        a, b = (neardup.sample(own, w, np.array([0])) for w in (w1, w2))
        same.append((a == b).mean())
    assert abs(np.mean(same) - exact) < 0.03


def test_packed_hashes_round_trip():
    h = np.sort(np.random.default_rng(2).integers(0, 2**48, 1000, dtype=np.uint64))
    assert (neardup.unpack_sorted(neardup.pack_sorted(h)) == h).all()


# --- packing -----------------------------------------------------------------------------------

def test_packing(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rows = Tokenizer.from_file(path), doc_rows()
    for size, grain in ((256, 16), (64, 8)):
        out = packing.pack(docs, path, size, grain=grain).collect()
        want = Counter()
        for i, t, *_ in rows:
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            want.update((i, s, ids[s:s + size].tobytes(), len(ids)) for s in range(0, len(ids), size))
        assert Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in out) == want
        seqs = defaultdict(list)
        for r in out:
            seqs[r.sequence_id].append((r.offset, r.length))
        used = 0
        for pieces in seqs.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= size
            used += at
        assert used > 0.9 * size * len(seqs)


def test_column_generation_fills_sequences():
    slots = packing.plan({3: 300, 5: 300, 8: 10, 2: 40}, 8)
    assert slots.sequences == 310 + 10       # (3, 5) x 300, 8 x 10, (2, 2, 2, 2) x 10


def test_token_ids_of_awkward_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import random

    from forestlens.llm.tokens import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, rng = Encoder(path), random.Random(3)
    alphabet = list("abcXYZéÉñß×÷İiıſ'’` \t\n\x85\xa0 ́中字Кк½²_-.,!?<|>0129\x00\x1c\x7f🙂K") + ["<|endoftext|>", "'s", "'LL", "don't"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(800)]
    raw = [t.encode() for t in texts]
    got = encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [g.tolist() for g in got] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class CountingTokenizer:
    """Counts the texts handed to a tokenizer, by method."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, {"encode_batch": 0, "encode_batch_fast": 0}

    def encode_batch(self, texts, **how):
        self.texts["encode_batch"] += len(texts)
        return self.tokenizer.encode_batch(texts, **how)

    def encode_batch_fast(self, texts, **how):
        self.texts["encode_batch_fast"] += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def encoder_and_counts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from forestlens.llm.tokens import Encoder

    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encode.tokenizer = CountingTokenizer(encode.tokenizer)
    return encode, encode.tokenizer.texts


def encoded(encode, texts: list[str]) -> list[list[int]]:
    raw = [t.encode() for t in texts]
    return [g.tolist() for g in encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))]


def expected_ids(encode, texts: list[str]) -> list[list[int]]:
    return [encode.tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def letters(i: int) -> str:
    return "".join(chr(97 + int(d)) for d in str(i))


def test_units_reach_the_tokenizer_once_and_without_offsets():
    encode, counts = encoder_and_counts()
    slices = [[" ".join(map(letters, range(lo, lo + 15_000)))] for lo in range(0, 270_000, 15_000)]
    first = [encoded(encode, s) for s in slices]
    assert counts["encode_batch"] == 0 and 0 < counts["encode_batch_fast"] < 270_000 / 32
    had = dict(counts)
    assert [encoded(encode, s) for s in slices] == first and counts == had
    assert first[3] == expected_ids(encode, slices[3])


def test_kept_units_are_bounded_and_ids_stay_right(monkeypatch):
    from forestlens.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 50)
    encode, _ = encoder_and_counts()
    for lo in (0, 20, 10, 60, 0, 300, 40):
        texts = ["", " ".join(map(letters, range(lo, lo + 30))) + " don't Été 4x7!", "", "字 " + letters(lo), " "]
        assert encoded(encode, texts) == expected_ids(encode, texts)
        assert len(encode.keys) <= 50 and (np.diff(encode.keys) > 0).all()
    assert encoded(encode, [""]) == [[]]


def test_ids_without_a_word_suffix_or_of_units_that_are_several_words():
    texts = ["one two, 34 éa --", "three Two"]
    encode, counts = encoder_and_counts()
    encode.ends_word = None                  # a vocabulary that doesn't tell where words end
    assert encoded(encode, texts) == expected_ids(encode, texts) and counts["encode_batch"] > 0
    encode, counts = encoder_and_counts()
    encode.ends_word[:] = False              # cuts that don't fit the units
    assert encoded(encode, texts) == expected_ids(encode, texts) and counts["encode_batch"] == 0


# --- line classifier -------------------------------------------------------------------------------

def test_forward_backward_is_exact():
    from itertools import product

    rng = np.random.default_rng(4)
    chain = crf_quality.Chain(rng.normal(size=3), np.array([0.7, -0.4]))
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    x = rng.normal(size=(7, 3))
    got = crf_quality.marginals(chain, x, doc, 3)
    for d in range(3):
        e = x[doc == d] @ chain.weights
        total, good = 0.0, np.zeros(len(e))
        for y in product((0, 1), repeat=len(e)):
            s = sum(e[i] for i in range(len(e)) if y[i]) + sum(chain.stay[0] if a and b else chain.stay[1] if not a and not b else 0 for a, b in zip(y, y[1:]))
            total += np.exp(s)
            good += np.exp(s) * np.array(y)
        assert np.allclose(good / total, got[doc == d])


def test_line_quality_separates_held_out_junk(spark, docs):
    chain = crf_quality.fit(docs, labels(spark))
    out = {r.doc_id: r.score for r in crf_quality.score(docs, chain).collect() if r.doc_id is not None and r.doc_id < 120}
    held = [i for i in out if i < 50 and zlib.crc32(str(i).encode()) % 5 == 0]      # later ids hold copies under other labels
    assert all((out[i] > 0.5) == (i % 11 != 0) for i in held) and all(0 <= s <= 1 for s in out.values())
    every = crf_quality.score(docs, None)
    assert every.count() == len(doc_rows()) and every.filter("score <> 0.5").isEmpty()
    assert crf_quality.fit(docs, labels(spark).limit(0)) is None


# --- sharding ----------------------------------------------------------------------------------------

def test_sharding(spark, docs):
    rows = doc_rows() + [(50, "same row", "en", "a", 0)] * 64 + [(None, "x" * 500, "en", "a", 0)] * 40
    limit = 2000
    out = sharding.shard(clashing(documents(spark, rows)), limit).collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r.bytes) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    shards = defaultdict(list)
    for r in out:
        assert r.depth == len(r.shard)
        shards[r.shard].append(r)
    for prefix, own in shards.items():
        total = sum(r.bytes for r in own)
        assert all(r.shard_bytes == total and r.shard_docs == len(own) for r in own) and (total <= limit or len(own) == 1)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for prefix in {p[:i] for p in shards for i in range(len(p))}:        # only oversized buckets were split
        assert sum(r.bytes for p, own in shards.items() if p.startswith(prefix) for r in own) > limit
    for r in out:                                                        # the first bits are the id's digest
        bits = bin(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert (r.shard[:60] == bits[:len(r.shard)]) if len(r.shard) <= 60 else r.shard.startswith(bits)


# --- licenses -----------------------------------------------------------------------------------------

def test_license_base_places_and_labels(spark, docs):
    texts = ["Released under the GNU General\nPublic License, version 3.0. CC-BY 4.0; cc by", "MIT LICENSE mit license", None, "",
             "SPDX-License-Identifier: Apache-2.0", "emit license, accc by", "Licensed under the Apache License, Version 2.0 (the \"License\")"]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in licenses.scan(clashing(documents(spark, rows))).collect()}

    def base(i):
        return sorted((d.label, d.first_word) for d in out[i].detections if d.base)

    assert base(0) == [("cc-by", 10), ("cc-by", 14), ("gpl", 3)]
    assert base(1) == [("mit", 0), ("mit", 2)] and base(2) == base(3) == base(5) == []
    assert out[2].n_words == 0 and out[0].n_words == 16
    assert {d.label for d in out[0].detections} >= {"gpl-3.0", "cc-by-4.0"}
    assert {d.label for d in out[4].detections} == {"apache-2.0"}
    assert {d.label for d in out[6].detections} == {"apache", "apache-2.0"}
    assert all(not r.detections for r in licenses.scan(docs).collect())


def test_license_suppression_against_pairwise():
    rules = [licenses.Rule(str(i), str(i), "x", "x", p, 0.5, base=p == 9) for i, p in enumerate([9, 5, 5, 3])]
    scanner = licenses.Scanner(rules)
    rng = np.random.default_rng(3)
    for _ in range(300):
        found = [(int(rng.integers(4)), int(a), int(a + rng.integers(1, 6))) for a in rng.integers(0, 12, 8)]

        def rank(f):
            return -rules[f[0]].priority, f[1] - f[2], f[0], f[1]

        kept = []
        for f in sorted(set(found), key=rank):
            if rules[f[0]].base or not any(k[1] <= f[1] and f[2] <= k[2] for k in kept):
                kept.append(f)
        assert scanner.suppress(found) == sorted(kept, key=lambda f: (f[1], f[2], f[0]))


def test_rules_are_hundreds_and_compile():
    rules = licenses.build_rules()
    assert len(rules) > 300 and len({r.name for r in rules}) == len(rules)
    licenses.Scanner(rules)


# --- all on empty tables ---------------------------------------------------------------------------------

def test_empty_tables(spark):
    docs, marks = documents(spark, []), labels(spark, [])
    assert mixing.mix(docs).count() == 0 and neardup.near_duplicates(docs).count() == 0
    assert quality_rules.judge(docs, marks).count() == 0 and line_dedup.dedup_lines(docs).count() == 0
    assert crf_quality.fit(docs, marks) is None and crf_quality.score(docs, None).count() == 0
    assert sharding.shard(docs, 100).count() == 0 and licenses.scan(docs).count() == 0
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0

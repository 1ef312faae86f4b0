"""Signature rules: every alternative passes its own gate; the query against a scan without gates."""

import itertools
import re
from re import _constants as K
from re import _parser as parser

import pytest

from forestlens.llm import licenses
from forestlens.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm.fixtures import doc_rows, documents


def samples(pattern: str) -> list[bytes]:
    """A match for each choice of alternatives in ``pattern``, optional parts left out and put in."""

    def each(parsed):
        parts = []
        for op, arg in parsed:
            if op is K.LITERAL:
                parts.append([bytes([arg])])
            elif op is K.ANY:
                parts.append([b"x"])
            elif op is K.IN:
                parts.append([b"7" if kind is K.CATEGORY else bytes([value]) for kind, value in arg])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                least, most, inner = arg
                own = each(inner)
                parts.append(own if least else [b"", *own])
            elif op is K.SUBPATTERN:
                parts.append(each(arg[-1]))
            elif op is K.BRANCH:
                parts.append([x for branch in arg[1] for x in each(branch)])
            else:
                raise AssertionError(f"unexpected {op} in {pattern}")
        return [b"".join(x) for x in itertools.product(*parts)]

    return each(parser.parse(pattern.encode("latin-1")))


def test_every_alternative_passes_its_own_gate():
    rules = licenses.build_rules()
    for rule in rules:
        alone = licenses.Scanner([rule])
        for text in samples(rule.pattern):
            assert re.fullmatch(rule.pattern.encode("latin-1"), text)
            n = len(text.split(b" "))
            assert (0, 1, 1 + n) in alone.scan(b"see " + text + b" here"), (rule.name, text)


@pytest.fixture(scope="module")
def rules():
    own = licenses.build_rules()
    return own, [re.compile(rb"(?:^|(?<= ))" + r.pattern.encode("latin-1") + rb"(?= |$)") for r in own]


def plain_scan(text, rules):
    """Words and detections of a text by all rules, without gates; suppression by pairs."""
    rules, patterns = rules
    lowered = (text or "").encode().lower()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", lowered)
    joined = b" ".join(words)
    begin = {at: i for i, at in enumerate(itertools.accumulate([0, *[len(w) + 1 for w in words]]))}
    found = []
    for i, p in enumerate(patterns):
        for m in p.finditer(joined):
            found.append((i, begin[m.start()], begin[m.end() + 1]))
    kept = []
    for f in sorted(found, key=lambda f: (-rules[f[0]].priority, f[1] - f[2], f[0], f[1])):
        if rules[f[0]].base or not any(k[1] <= f[1] and f[2] <= k[2] for k in kept):
            kept.append(f)
    return len(words), [(rules[i], a, b) for i, a, b in kept]


def expected(text, rules):
    n, kept = plain_scan(text, rules)
    base = [f for f in kept if f[0].base]
    doubt = 1.0
    for rule, _, _ in sorted(kept, key=lambda f: (f[1], f[2])):
        doubt *= 1 - rule.confidence
    starts = [f[1] for f in base]
    return (n, len(base), min(starts, default=None), max(starts, default=None),
            *(",".join(sorted({f[0].label for f in some})) for some in (base, kept)), pytest.approx(1 - doubt))


def digest(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def test_query_against_plain_scan_of_the_table(spark, rules):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = Q.op9_license_rules(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert digest(r) == expected(texts[r.doc_id], rules), r.doc_id
    assert any(r.labels for r in out)


BODIES = [
    ("this is under the psf license", "python"),
    ("© the authors", "copyright"),
    ("Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.", "bsd"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even", "gpl"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation", "boost"),
    ("3. All advertising materials mentioning features or use of this software must display the following", "bsd-4-clause"),
    ("a text of no licence at all", ""),
]


def test_bodies_and_gates_of_more_than_one_word(spark, rules, tmp_path):
    rows = [(i, t, "en", "a", 0) for i, (t, _) in enumerate(BODIES)] + [(100 + i, *r[1:]) for i, r in enumerate(doc_rows())]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    out = Q.op9_license_rules(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert digest(r) == expected(texts[r.doc_id], rules)
        if r.doc_id < len(BODIES):
            assert r.labels == ",".join(sorted(BODIES[r.doc_id][1].split(","))), r.doc_id

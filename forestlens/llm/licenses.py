"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and read as words. Rules are regular expressions over the words
joined by one space, each gated by keywords, one for each way to match it: a rule runs only on texts
whose bytes hold one of them. A detection is the rule's word interval; a detection inside the interval of one with higher
priority (or of equal priority and longer, or equal and listed earlier) is suppressed. Base rules
have the highest priority and are never suppressed.

Rules are made from a table of licenses (name forms, versions, identifiers) by phrase templates
(grant, name, version, identifier tag, address), plus rules written singly.

Defined results: a null or empty text has no words and no detections; repeated rows are scanned
alike; an empty table gives no rows. Other columns are never read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forestlens.llm import textops

BASE_PRIORITY = 1000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str            # parts of words, separated by "|"; every match's text holds one of them
    pattern: str            # over words joined by single spaces
    priority: int
    confidence: float
    base: bool = False


# Phrases and labels of the base rules.
BASE = [
    ("gnu general public license", "gpl", "gnu"),
    ("apache license", "apache", "apache"),
    ("cc by", "cc-by", "cc"),
    ("mit license", "mit", "license"),
]

V = r"(?:(?:version|v) ?)?"
# label; keywords; name forms; versions (label suffix: pattern); identifier forms; address forms
LICENSES = [
    ("gpl", "gnu", "gnu (?:general public licen[cs]e|gpl)", {"2.0": "2(?: 0)?", "3.0": "3(?: 0)?"}, "gpl", "gnu org licenses gpl"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e", {"2.0": "2 0", "2.1": "2 1", "3.0": "3(?: 0)?"}, "lgpl", "gnu org licenses lgpl"),
    ("agpl", "gnu", "gnu affero general public licen[cs]e", {"1.0": "1(?: 0)?", "3.0": "3(?: 0)?"}, "agpl", "gnu org licenses agpl"),
    ("gfdl", "gnu", "gnu free documentation licen[cs]e", {"1.1": "1 1", "1.2": "1 2", "1.3": "1 3"}, "gfdl", "gnu org licenses fdl"),
    ("apache", "apache", "apache(?: software)? licen[cs]e", {"1.0": "1 0", "1.1": "1 1", "2.0": "2(?: 0)?"}, "apache", "apache org licenses license"),
    ("mit", "mit", "mit licen[cs]e", {}, "mit", "opensource org licenses mit"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|simplified bsd|two clause bsd) licen[cs]e", {}, "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|new bsd|modified bsd|three clause bsd) licen[cs]e", {}, "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", {}, "bsd", "opensource org licenses bsd license"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause) licen[cs]e", {}, "0bsd", "opensource org licenses 0bsd"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", {"1.0": "1 0", "1.1": "1 1", "2.0": "2(?: 0)?"}, "mpl", "mozilla org mpl"),
    ("epl", "eclipse", "eclipse public licen[cs]e", {"1.0": "1(?: 0)?", "2.0": "2(?: 0)?"}, "epl", "eclipse org legal epl"),
    ("cddl", "distribution", "common development and distribution licen[cs]e", {"1.0": "1(?: 0)?", "1.1": "1 1"}, "cddl", "opensource org licenses cddl"),
    ("cpl", "common", "common public licen[cs]e", {"1.0": "1(?: 0)?"}, "cpl", "opensource org licenses cpl"),
    ("isc", "isc", "isc licen[cs]e", {}, "isc", "opensource org licenses isc"),
    ("artistic", "artistic", "artistic licen[cs]e", {"1.0": "1(?: 0)?", "2.0": "2(?: 0)?"}, "artistic", "opensource org licenses artistic license"),
    ("boost", "boost", "boost software licen[cs]e", {"1.0": "1(?: 0)?"}, "bsl", "boost org license"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", {}, "zlib", "opensource org licenses zlib"),
    ("unlicense", "unlicense", "the unlicense", {}, "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl", {"2.0": "2(?: 0)?"}, "wtfpl", "wtfpl net"),
    ("python", "python|psf", "(?:python software foundation|psf) licen[cs]e", {"2.0": "2(?: 0)?"}, "psf", "python org psf license"),
    ("ruby", "ruby", "ruby licen[cs]e", {}, "ruby", "ruby lang org license"),
    ("php", "php", "php licen[cs]e", {"3.0": "3 0", "3.01": "3 01"}, "php", "php net license"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", {}, "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", "openssl licen[cs]e", {}, "openssl", "openssl org source license"),
    ("eupl", "european", "european union public licen[cs]e", {"1.0": "1 0", "1.1": "1 1", "1.2": "1 2"}, "eupl", "joinup ec europa eu eupl"),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", {"1.0": "1 0", "1.1": "1 1"}, "ofl", "scripts sil org ofl"),
    ("odbl", "database", "open database licen[cs]e", {"1.0": "1(?: 0)?"}, "odbl", "opendatacommons org licenses odbl"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", {"1.0": "1(?: 0)?"}, "odc by", "opendatacommons org licenses by"),
    ("pddl", "public", "public domain dedication and licen[cs]e", {"1.0": "1(?: 0)?"}, "pddl", "opendatacommons org licenses pddl"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", {}, "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", {}, "ms rl", "opensource org licenses ms rl"),
    ("osl", "open", "open software licen[cs]e", {"2.0": "2 0", "2.1": "2 1", "3.0": "3(?: 0)?"}, "osl", "opensource org licenses osl"),
    ("afl", "academic", "academic free licen[cs]e", {"2.0": "2 0", "2.1": "2 1", "3.0": "3(?: 0)?"}, "afl", "opensource org licenses afl"),
    ("qpl", "public", "q public licen[cs]e", {"1.0": "1(?: 0)?"}, "qpl", "opensource org licenses qtpl"),
    ("lppl", "latex", "latex project public licen[cs]e", {"1.0": "1 0", "1.2": "1 2", "1.3c": "1 3c?"}, "lppl", "latex project org lppl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", {}, "ncsa", "opensource org licenses ncsa"),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", {"1.0": "1 0", "2.0": "2 0", "2.1": "2 1"}, "cecill", "cecill info licences"),
    ("upl", "universal", "universal permissive licen[cs]e", {"1.0": "1(?: 0)?"}, "upl", "oss oracle com licenses upl"),
    ("sspl", "server", "server side public licen[cs]e", {"1.0": "1(?: 0)?"}, "sspl", "mongodb com licensing server side public license"),
    ("busl", "business", "business source licen[cs]e", {"1.1": "1 1"}, "busl", "mariadb com bsl11"),
    ("rail", "responsible", "(?:big science |creative ml )?open responsible ai licen[cs]e", {}, "openrail", "licenses ai"),
    ("llama", "community", "llama (?:\\d+ )*community licen[cs]e(?: agreement)?", {}, "llama", "ai meta com llama license"),
    ("cc0", "cc0", "cc0", {"1.0": "1(?: 0)?(?: universal)?"}, "cc0", "creativecommons org publicdomain zero"),
    ("cc-by-sa", "cc", "cc by sa", {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}, "cc by sa", "creativecommons org licenses by sa"),
    ("cc-by-nc", "cc", "cc by nc", {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}, "cc by nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "cc", "cc by nd", {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}, "cc by nd", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "cc", "cc by nc sa", {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}, "cc by nc sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc", "cc by nc nd", {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}, "cc by nc nd", "creativecommons org licenses by nc nd"),
    ("cc-by", "cc", "cc by", {"2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}, "cc by", "creativecommons org licenses by"),
]
# label; keywords; pattern; confidence
SINGLE = [
    ("all-rights-reserved", "reserved", r"all rights reserved", 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 0.5),
    ("copyright", "copyright|©", r"(?:copyright|\xc2\xa9)(?: c)? (?:by )?the (?:authors?|contributors?)", 0.5),
    ("public-domain", "public", r"(?:in|into|to) the public domain", 0.7),
    ("public-domain", "dedicated", r"(?:has been )?dedicated to the public domain", 0.8),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software", 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 0.95),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products", 0.8),
    ("apache", "apache", r"licensed under the apache license version 2 0", 0.98),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 0.98),
    ("gpl", "gpl", r"gpl ?v?[23](?: 0)?(?: only| or later)?", 0.8),
    ("lgpl", "lgpl", r"lgpl ?v?(?:2 1|2|3)(?: 0)?(?: only| or later)?", 0.8),
    ("agpl", "agpl", r"agpl ?v?3(?: 0)?(?: only| or later)?", 0.8),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.8),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution) .{0,60}?(?:prohibited|forbidden)", 0.8),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial use only", 0.7),
    ("cc-by", "commons", r"creative commons attribution(?: international)?(?: public)? licen[cs]e", 0.9),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike", 0.9),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial", 0.9),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?", 0.9),
    # sentences of the licences' bodies, for texts that give a body without its name
    ("mit", "software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.7),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software", 0.8),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "holders", r"this software is provided by the copyright holders and contributors as is", 0.8),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("apache", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e", 0.9),
    ("apache", "writing", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 0.9),
    ("gpl", "licenses", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change", 0.9),
    ("gpl", "distributed", r"this program is distributed in the hope that it will be useful but without any warranty", 0.8),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 0.95),
    ("agpl", "remotely", r"all users interacting with it remotely through a computer network", 0.8),
    ("gfdl", "invariant", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", 0.95),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e", 0.98),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 0.98),
    ("cddl", "compliance", r"you may not use this file except in compliance with the common development and distribution licen[cs]e", 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.9),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0.9),
    ("boost", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.98),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("wtfpl", "fuck", r"(?:you just )?do what the fuck you want to(?: public licen[cs]e)?", 0.9),
    ("artistic", "package", r"you may make and give away verbatim copies of the (?:source form of the standard version|standard version) of this package", 0.9),
    ("ofl", "font", r"the font software may be modified altered or added to", 0.9),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", 0.85),
    ("cc0", "waives", r"(?:affirmer )?hereby overtly fully permanently irrevocably and unconditionally waives", 0.9),
    ("creative-commons", "exercising", r"by exercising the licensed rights defined below you accept and agree to be bound", 0.6),
]


def build_rules() -> list[Rule]:
    """Base rules, then templates over the license table, then single rules, in priority order."""
    rules = [Rule(f"base:{label}", label, keyword, re.escape(phrase).replace(r"\ ", " "), BASE_PRIORITY, 0.9, True)
             for phrase, label, keyword in BASE]
    for label, keyword, name, versions, tag, address in LICENSES:
        for suffix, pattern in versions.items():
            rules += [
                Rule(f"version:{label}-{suffix}", f"{label}-{suffix}", keyword, f"{name} {V}{pattern}", 80, 0.95),
                Rule(f"tag:{label}-{suffix}", f"{label}-{suffix}", "spdx", f"spdx license identifier {tag} {pattern}(?: only| or later)?", 90, 0.99),
                Rule(f"grant:{label}-{suffix}", f"{label}-{suffix}", keyword, f"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{name} {V}{pattern}", 85, 0.97),
            ]
        rules += [
            Rule(f"tag:{label}", label, "spdx", f"spdx license identifier {tag}", 70, 0.95),
            Rule(f"grant:{label}", label, keyword, f"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{name}", 65, 0.95),
            Rule(f"address:{label}", label, address.split()[0], address, 60, 0.9),
            Rule(f"name:{label}", label, keyword, name, 50, 0.85),
        ]
    rules += [Rule(f"single:{i}:{label}", label, keyword, pattern, 40, confidence)
              for i, (label, keyword, pattern, confidence) in enumerate(SINGLE)]
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    """Compiled rules, grouped by keywords."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_keywords: dict[tuple[bytes, ...], list[tuple[int, re.Pattern]]] = {}
        for i, r in enumerate(rules):
            p = re.compile(rb"(?<![^ ])" + r.pattern.encode("latin-1") + rb"(?![^ ])")
            self.by_keywords.setdefault(tuple(r.keyword.encode().split(b"|")), []).append((i, p))

    def scan(self, lowered: bytes) -> list[tuple[int, int, int]]:
        """``(rule, first word, word after the last)``, suppression applied, in text order."""
        gated = [g for gates, g in self.by_keywords.items() if any(k in lowered for k in gates)]
        if not gated:
            return []
        joined = b" ".join(WORD.findall(lowered))
        found = []
        for group in gated:
            for i, p in group:
                for m in p.finditer(joined):
                    found.append((i, m.start(), m.end()))
        if not found:
            return []
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        found = [(i, int(np.searchsorted(spaces, a)), int(np.searchsorted(spaces, b)) + 1) for i, a, b in found]
        return self.suppress(found)

    def suppress(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Drop what lies inside a stronger detection (sweep in order of strength)."""
        strength = sorted(set(found), key=lambda f: (-self.rules[f[0]].priority, f[1] - f[2], f[0], f[1]))
        kept: list[tuple[int, int, int]] = []
        # For a start, the furthest end among kept intervals that begin there or before.
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for f in strength:
            if not self.rules[f[0]].base and len(starts):
                at = int(np.searchsorted(starts, f[1], "right"))
                if at and ends[at - 1] >= f[2]:
                    continue
            kept.append(f)
            at = int(np.searchsorted(starts, f[1], "right"))
            far = max(f[2], int(ends[at - 1]) if at else 0)
            starts = np.insert(starts, at, f[1])
            ends = np.insert(ends, at, far)
            ends[at:] = np.maximum(ends[at:], f[2])
        return sorted(kept, key=lambda f: (f[1], f[2], f[0]))


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(list(rules))
    return _scanners[rules]


DETECTION = "struct<label:string,rule:string,first_word:long,end_word:long,confidence:double,base:boolean>"


def scan(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, detections`` (array of label, rule, word interval, confidence, base) per row."""
    fixed = tuple(build_rules() if rules is None else rules)

    @F.arrow_udf(f"struct<n_words:long,detections:array<{DETECTION}>>")
    def detect(texts: pa.Array) -> pa.Array:
        own = scanner(fixed)
        words, found = [], []
        for _, _, data, offsets in textops.slices(texts):
            starts, _ = textops.runs(_IN_WORD[data], offsets)
            words.append(textops.per_doc(np.searchsorted(offsets, starts, "right") - 1, len(offsets) - 1))
            raw = data.tobytes()
            for a, b in zip(offsets[:-1], offsets[1:]):
                found.append([{"label": own.rules[i].label, "rule": own.rules[i].name, "first_word": x, "end_word": y,
                               "confidence": own.rules[i].confidence, "base": own.rules[i].base}
                              for i, x, y in own.scan(raw[a:b].lower())])
        kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()),
                                   ("end_word", pa.int64()), ("confidence", pa.float64()), ("base", pa.bool_())]))
        n = np.concatenate(words) if words else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(found, kind)], ["n_words", "detections"])

    return docs.select(F.col(doc_id).alias("doc_id"), detect(F.col(text)).alias("d")).select("doc_id", "d.*")

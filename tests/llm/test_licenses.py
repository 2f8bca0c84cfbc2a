import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from netshield.llm import licenses
from netshield.llm.license_rules import rules
from netshield.llm.queries import op12_licenses

RULES = rules()
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\")")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def detections(text):
    """Every rule on every text, and each detection against every other one."""
    spaced = " " + " ".join(words(text)) + " "
    found = []
    for k, (label, priority, _, pattern) in enumerate(RULES):
        for m in re.finditer(" (?:" + pattern.decode().replace(r"\S", "[^ ]") + ")(?= )", spaced):
            found.append((spaced.count(" ", 0, m.start()), spaced.count(" ", 0, m.end()), k))

    def above(a, b):
        key = lambda d: (RULES[d[2]][1], d[0] - d[1], d[2])
        return a != b and a[0] <= b[0] and b[1] <= a[1] and key(a) < key(b)

    return sorted(d for d in found if not any(above(other, d) for other in found))


def expected(text):
    found = words(text)
    base = sorted((k, label) for phrase, label in PHRASES.items() for k in range(len(found))
                  if found[k:k + len(phrase.split())] == phrase.split())
    kept = detections(text)
    surest = {}
    for label, priority in [(label, 2) for _, label in base] + [(RULES[k][0], RULES[k][1]) for _, _, k in kept]:
        surest[label] = min(priority, surest.get(label, 9))
    left = 1.0
    for label in sorted(surest):
        left *= 1 - {1: 0.95, 2: 0.9, 3: 0.7, 4: 0.3}[surest[label]]
    starts = [k for k, _ in base]
    return (len(found), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in base})), ",".join(sorted(surest)), 1 - left)


TEXTS = [
    None, "", " ", "no signature here", "Licensed UNDER the MIT-License, under the mit license",
    MIT + " and " + "Licensed under the Apache License, Version 2.0 (the 'License')", "CC BY-NC 4.0, cc by nc", "cc by nc nd 4.0",
    "GPLv3 or later; gpl-2.0-only. LGPL v2.1 AGPL-3.0", "This file is in the public domain. All rights reserved.",
    "Copyright (c) 2020 Some Body. All rights reserved.", "apache license version 2" * 3, "under the mit license " * 500,
    "SPDX-License-Identifier: MIT", "naïve mit licence ü under the mit license", "under the mit licenseé", "Régi par la licence CeCILL B",
    "word " * 50_000 + "cc by nc", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software", "under\x00the mit license", "under the MIT\u0085license", "1under the mit license",
]


def test_rules_are_hundreds():
    assert len(RULES) > 200 and all(priority in licenses.SURE for _, priority, _, _ in RULES)


@pytest.mark.parametrize("k", range(0, len(RULES), 1))
def test_needed_words_are_needed(k):
    label, _, needs, pattern = RULES[k]

    @settings(max_examples=15, database=None, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
    @given(st.from_regex(re.compile(pattern.decode().replace(r"\S", "[a-z0-9]"), re.A), fullmatch=True))
    def every_match_passes(text):
        held = set(text.encode().split())
        assert k in licenses._signatures().candidates(held)
        assert any(d[2] == k or licenses._signatures().rank(d)[0] <= RULES[k][1]
                   for d in licenses.scan_text(text, [], licenses._signatures())[2])

    every_match_passes()


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.integers(0, len(RULES) - 1)), max_size=25, unique=True))
def test_suppression(found):
    signatures = licenses._signatures()
    found = [(start, start + size, k) for start, size, k in found]

    def above(a, b):
        return a != b and a[0] <= b[0] and b[1] <= a[1] and signatures.rank(a) < signatures.rank(b)

    assert signatures.unsuppressed(found) == sorted(d for d in found if not any(above(o, d) for o in found))


def test_table(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS)] * 2 + [(None, MIT, "clash", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Base string, n_words int")
    out = licenses.scan(df).select(
        "doc_id", "text", "n_words", "base", "detections", licenses.labels("base").alias("base_labels"),
        licenses.labels("base", "detections").alias("labels"), licenses.score().alias("score")).collect()
    assert len(out) == len(rows)
    for r in out:
        n, n_base, first, last, base_labels, labels, score = expected(r.text)
        starts = [d.start for d in r.base]
        assert (r.n_words, len(r.base), min(starts, default=None), max(starts, default=None)) == (n, n_base, first, last)
        assert (r.base_labels, r.labels) == (base_labels, labels) and r.score == pytest.approx(score, abs=1e-12)
        assert [(d.label, d.priority, d.start, d.end) for d in r.detections] == [
            (RULES[k][0], RULES[k][1], start, end) for start, end, k in detections(r.text)]
    assert licenses.scan(df.limit(0)).collect() == []


def test_more_specific_ones_win():
    labels = lambda text: sorted({RULES[k][0] for _, _, k in detections(text)})
    assert labels("CC BY-NC-ND 4.0") == ["cc-by-nc-nd"]
    assert labels("Licensed under the GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"]
    assert labels("the GNU Affero General Public License") == ["agpl-unspecified"]
    assert labels("Apache License 2.0 with LLVM exceptions") == ["llvm-exception"]
    assert labels("You may not use this. All rights reserved.") == ["proprietary"]
    assert labels("He is under the weather, with a license to sing by the sea") == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_licenses(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.base_labels for r in rows)
    for r in rows:
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        want = expected(texts[r.doc_id])
        assert got == want[:-1] and r.score == pytest.approx(want[-1], abs=1e-12)

import random
import re

import numpy as np
import pytest

from netshield.llm import divergence
from netshield.llm.queries import op11_divergence


def terms_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def expected(rows, least=30, top=50):
    """From the definitions, term by term and pair by pair."""
    docs = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = {}
        for _, _, terms in mine:
            for t in set(terms):
                held[t] = held.get(t, 0) + 1
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: {t: 0 for t in kept} for _, s, _ in mine}
        for _, s, terms in mine:
            for t in terms:
                if t in count[s]:
                    count[s][t] += 1
        whole = {t: sum(c[t] for c in count.values()) for t in kept}
        shares = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, place int, p string")
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


def texts(seed, n, sources, size=12, width=40):
    rng = random.Random(seed)
    names = [f"w{'abcdefghij'[k % 10] * (k // 10 + 1)}" for k in range(width)]
    out = []
    for _ in range(n):
        source = rng.choice(sources)
        own = names[len(source or "") % 7:]
        words = [rng.choice(own[: rng.randint(1, len(own))]) for _ in range(rng.randint(0, size))]
        out.append((" ".join(words).title(), rng.choice(["en", "de", None]), source))
    return out


@pytest.mark.parametrize("seed, least, top", [(1, 1, 5), (2, 3, 2), (3, 8, 50)])
def test_against_definitions(spark, seed, least, top):
    rows = texts(seed, 150, ["a", "bb", "ccc", "dddd", None, "é", "A"])
    rows += [(None, "xx", "only"), ("", "yy", "one"), ("rare words", "yy", "two"), ("ÀB cd", "en", "a")] * 2
    assert audited(spark, rows, least=least, top=top) == expected(rows, least, top)


def test_one_hot_source_and_shared_paths(spark):
    rows = [("same words everywhere", "en", "hot")] * 300 + [("same words", "en", f"s{k % 9}") for k in range(90)]
    rows += [("everywhere else", "en", "s1")] * 40
    assert audited(spark, rows) == expected(rows)


def test_many_corrections_are_summed_in_parts(spark, monkeypatch):
    rows = [(lang, np.array([[1, 2, 5], [p, p + 3, 40], [7, 9, 2]]), times) for lang in ("a", "b") for p, times in ((3, 2), (5, 1), (9, 4))]
    plain = {}
    for lang, path, times in rows:
        for i in range(3):
            for j in range(i):
                pi, pj, zi, zj = path[1][i], path[1][j], path[2][i], path[2][j]
                value = abs(pi - pj) - abs(pj - zi) - abs(pi - zj) + abs(zi - zj)
                key = (lang, int(path[0][j]), int(path[0][i]))
                plain[key] = plain.get(key, 0) + times * int(value)
    for most in (1, 4, 1 << 20):
        monkeypatch.setattr(divergence, "_HELD_PAIRS", most)
        found = {}
        for lang, a, b, value in divergence.walk(iter(rows)):
            for key in zip([lang] * len(a), a.tolist(), b.tolist(), value.tolist()):
                found[key[:3]] = found.get(key[:3], 0) + key[3]
        assert found == plain


def test_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**17 + 3, 3 * 10**17 + 1, 10**6)], "n long, total long, terms long")
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (10**17 + 8) // (3 * 10**17 + 1 + 5 * 10**6)


def test_blocks_change_nothing(monkeypatch):
    text = "Some Words, é and ünder_scores 12x " * 50
    for size in (1, 7, 1 << 22):
        monkeypatch.setattr(divergence, "_BLOCK", size)
        assert [t.decode() for block in divergence._term_blocks(text) for t in block] == terms_of(text)


def test_empty_table(spark):
    assert audited(spark, []) == []


@pytest.mark.parametrize("held_terms", [0, 3, 10**6])
def test_terms_are_handed_on_in_parts(spark, held_terms):
    df = spark.createDataFrame(texts(5, 60, ["a", "b"]), "text string, lang string, source string").coalesce(1)
    parts = divergence.term_counts(df, held_terms=held_terms)
    assert parts.count() >= (60 if held_terms == 0 else 1)
    found = divergence.vocabulary(parts, 2).selectExpr("lang", "term", "n", "array_sort(cells) AS cells")
    whole = divergence.vocabulary(divergence.term_counts(df), 2).selectExpr("lang", "term", "n", "array_sort(cells) AS cells")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()
    assert sorted(map(tuple, op11_divergence(spark, sf_dir).collect())) == expected([tuple(r) for r in docs])

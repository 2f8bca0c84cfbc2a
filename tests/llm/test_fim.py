import hashlib
import re

import pytest

from netshield.llm import fim
from netshield.llm.queries import op13_fim

TEXTS = [None, "", " ", "a", "a b", "  lead and trail \n\n", "naïve 東京 ١٢٣ 🙂\u0085x　y", "holds <P> inside", "<S>", "a<M>",
         "one two three four five " * 3000, "x" * 100_000, "\n" * 5000 + "x", "<P", "P> S> <"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, seed=42, rate=50, spm=80):
    """By plain string work: n, form, prefix and middle length, output."""
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    hashed = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    a, b, c, d = (int(hashed[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    low, high = min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if text == "" or re.search("<[PSM]>", text) or c % 100 >= rate:
        return n, "plain", None, None, text
    if d % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output",
                                               "output_sha256", "restored").collect()), key=repr)


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (100, 0), (0, 80)])
def test_against_plain_strings(spark, rate, spm):
    ids = [None, *range(12)]
    rows = [(i, t) for t in TEXTS for i in ids] * 2
    df = spark.createDataFrame([(*r, "clash", 1.5, "keep") for r in rows],
                               "doc_id long, text string, Pieces string, n double, other string")
    found = fim.restore(fim.render(fim.arrange(df, rate=rate, spm=spm)))
    want = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = expected(doc_id, text, rate=rate, spm=spm)
        want.append((doc_id, text, n, form, prefix, middle, output, sha(output), text or ""))
    assert rows_of(found) == sorted(want, key=repr)
    assert "other" in found.columns and found.filter("other = 'keep'").count() == len(rows)


def test_all_forms_occur():
    forms = {expected(k, "some words to cut")[1] for k in range(60)}
    assert forms == {"plain", "psm", "spm"}


def test_inverse_permutation():
    for order in fim.ARRANGEMENTS.values():
        pieces = list("abcdef")
        assert fim.permute(fim.permute(pieces, order), fim.inverse(order)) == pieces


def test_long_text_streams():
    text = "word " * 800_000
    n, form, pieces = fim.plan(text, (123_457, 700_001, 0, 99), 50, 80)
    assert (n, form) == (800_001, "psm") and len(pieces) == 6
    output = "".join(fim.slices((text, "<P><S><M>"), pieces))
    assert fim.digest((text, "<P><S><M>"), pieces) == sha(output)
    assert "".join(fim.slices((output,), fim.found_pieces(output, form))) == text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.render(fim.arrange(df))).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_fim(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, output = expected(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == sha(output) and r.restored_sha256 == sha(texts[r.doc_id] or "")

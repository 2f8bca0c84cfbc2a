import hashlib
import struct

import pytest

from netshield.llm import bpe
from netshield.llm.queries import op8_bpe

RANKS, PATTERN = bpe.public_files()
TEXTS = [None, "", " ", "a", "Hello  world\n\n it's  ", "  \n x", "naïve 東京 ١٢٣ 🙂", "a" * 3000,
         "word " * 500, "\n" * 2000 + "x", "x" + " " * 2000]


def expected(text):
    return bpe._encoding(RANKS, PATTERN).encode_ordinary(text or "")


def test_round_trip_and_digests(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "c", 2), (1, "", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, decoded int")
    out = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    got = sorted(((r.doc_id, r.text, r.n_tokens, bytes(r.tokens), bytes(r.decoded)) for r in out.collect()),
                 key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids = expected(text)
        want.append((doc_id, text, len(ids), struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()))
    assert got == sorted(want, key=repr)
    one = bpe.digests(out).filter("doc_id = 4").first()
    ids = expected(TEXTS[4])
    assert one.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert one.decoded_sha256 == hashlib.sha256(TEXTS[4].encode()).hexdigest()


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_blocks_change_nothing(limit):
    encoding = bpe._encoding(RANKS, PATTERN)
    for text in TEXTS[1:] + ["  ab  c'll d\t\n  e  ", "don't 'll x  y"]:
        assert "".join(bpe.blocks(text, limit)) == text
        assert bpe.encode_text(encoding, PATTERN, text, limit).tolist() == expected(text)


def test_huge_runs():
    encoding = bpe._encoding(RANKS, PATTERN)
    for text in (" " * 1_000_000 + "x", "a" * 300_000, "\n" * 1_000_000):
        ids = bpe.encode_text(encoding, PATTERN, text)
        assert encoding.decode_bytes(ids.tolist()).decode() == text


def test_one_pass_is_both(spark):
    df = spark.createDataFrame([(i, t, "clash", [1.5], None) for i, t in enumerate(TEXTS)] * 2,
                               "doc_id long, text string, Tokens string, more array<double>, nothing int")
    both = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    one = bpe.round_trip(df, RANKS, PATTERN)
    assert one.columns == both.columns == ["doc_id", "text", "more", "nothing", "tokens", "n_tokens", "decoded"]
    assert sorted(map(repr, one.collect())) == sorted(map(repr, both.collect()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)).count() == 0


def test_query(spark, sf_dir):
    rows = op8_bpe(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(expected(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()

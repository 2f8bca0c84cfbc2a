import hashlib
import re

from pyspark.sql import functions as F

from netshield.llm import pii
from netshield.llm.queries import op9_pii

# The base patterns.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "no data", "a@b.com_x@c.de", "x@y..z.com a@b.c. 🙂 é.q@x-y.z1.w, @b.c a@b", "..a@b.c..d@e.f",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0255 1.2.3 256.1.1.1 0.0.0.0", "1.2.3.4@x.y 4041894974608795",
    "4041-8949 7460-8795 4041 8949 7460 8796 12345678901234567890", "4041894974608795 +1 (988) 555-2485 +1234567890123456",
    "+1.2.3.4567890 +44 20 7946 0958x ++12 345 678 9012", "\u0001a@b.co\u0002 \u0001\u0002 1.1.1.1", "é" * 300 + "a@b.co",
    "password=b7db7aa4a5fcc78305 token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"", "1" * 20000, "a" * 50000,
    "a@b" + ".c" * 20000, "1.1.1.1 " * 3000, "x.1@y.zz " * 700, "00000000000000 0-0-0-0",
    "call (555) 123-4567 now; total 5551234567", "/path/to/abc123def456/file0000000000000001"]


def spans_of(df):
    return {r.doc_id: r for r in pii.summary(pii.find(df)).collect()}


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, spans string, kept string")
    rows = spans_of(df)
    for i, text in enumerate(TEXTS):
        want = base(text)
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text or "")[:60]
        for kind in pii.KINDS:
            assert rows[i][f"n_{kind}"] == sum(s.startswith(kind + ":") for s in want.split(","))
        have = rows[i].spans.split(",")
        assert all(s in have for s in want.split(",")) or not want


def test_added_spans(spark):
    texts = [f"words and password={h} more" for h in (hashlib.md5(str(i).encode()).hexdigest() for i in range(40))]
    texts += [f"see section{i}-of-the-long-text-{i} here" for i in range(60)] + ["plain text"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spans_of(df)
    assert all(rows[i].spans == "secret:19:51" for i in range(40))
    assert all(rows[i].spans == "" for i in range(40, 120))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.com, 1.2.3.4@x.yy and 4041894974608795."), (2, None), (3, "clean")],
                               "doc_id long, text string")
    got = {r.doc_id: r.t for r in pii.find(df).withColumn("t", pii.redact(df)).collect()}
    assert got == {1: "é [EMAIL], [EMAIL] and [CARD].", 2: None, 3: "clean"}


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = pii.summary(pii.find(df))
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().toString()


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest()
    secrets = sum(r.spans.count("secret:") for r in rows)
    planted = sum(len(re.findall(r"password=\w+|token = \"\w+\"", t or "")) for t in texts.values())
    assert secrets >= 0.9 * planted

import hashlib
import random
import re

import pytest
from test_decontaminate import norm
from test_minhash import brute as brute_groups
from test_pii import PATTERNS

import corpus_pipeline
from netshield.llm import bpe, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with planted toxic texts, copies, benchmark passages and personal data."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "re", "st"]) for _ in range(rng.randint(1, 4)))
    words = lambda n: [word() for _ in range(n)]
    texts, labels = {}, []
    for i in range(300):
        own = words(60)
        toxic = i % 5 == 1
        if toxic:
            own[rng.randrange(60)] = rng.choice(["grumpot", "grumpling", "vilewort"])
        if i < 250:
            labels.append((i, 1, int(toxic)))
        texts[i] = " ".join(own)
    bench = [(k, " ".join(words(25))) for k in range(10)]
    for k, (_, passage) in enumerate(bench):
        texts[400 + k] = " ".join(words(30)) + " " + passage.upper() + " " + " ".join(words(30))
    for k in range(20):  # copies of clean documents, with and without an edit
        texts[500 + k] = texts[5 * k] + (" tail" if k % 2 else "")
    for k in range(10):
        texts[600 + k] = " ".join(words(30)) + f" me.{k}@mail.example.com 10.0.0.{k} " + " ".join(words(5))
    texts[700], texts[701] = "", None
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, bench


def test_stages(spark, tables):
    folder, texts, bench = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        if name != "bpe":
            assert docs.columns == before.columns
            got.append({r.doc_id: r.text for r in docs.collect()})
    bad = re.compile("grumpot|grumpling|vilewort")
    assert set(texts) - set(got[0]) == {i for i, t in texts.items() if t and bad.search(t)}
    groups = brute_groups(list(got[0].items()), 5)
    assert set(got[1]) == {r[0] for r in groups if r[3]}
    assert set(got[2]) == {i for i, t in got[1].items() if not any(norm(b) in norm(t) for _, b in bench)}
    assert set(got[3]) == set(got[2])
    for i, t in got[3].items():
        assert t is None or not any(re.search(PATTERNS[k], t) for k in ("email", "ip"))
        if i < 600:
            assert t == got[2][i]
    ranks, pattern = bpe.public_files()
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(got[3])
    for r in rows:
        text = got[3][r.doc_id] or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.n_tokens == len(bpe._encoding(ranks, pattern).encode_ordinary(text))


def test_columns_with_clashing_names(spark, tables):
    """Columns named like the operators' results stay as they are; rows without an id stay."""
    folder, texts, _ = tables
    names = {"score": 0.25, "leaks": "mine", "spans": "s", "base_spans": None, "whole_row": 7, "tokens": "t", "id_key": 1, "Text_Hash": "h"}
    rows = [(i, t, "en", "s", None if t is None else len(t), *names.values()) for i, t in texts.items() if i < 60 or i >= 500]
    rows += [(None, t, "en", "s", 5, *names.values()) for t in ("no id here", "no id here", "", None, None)]
    schema = SCHEMA + ", score double, leaks string, spans string, base_spans string, whole_row int, tokens string, id_key int, Text_Hash string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.schema.simpleString() == before.schema.simpleString(), name
        found = docs.collect()
        assert all(tuple(r[5:]) == tuple(names.values()) for r in found), name
        assert sum(r.doc_id is None for r in found) == 5, name
    assert corpus_pipeline.encode(spark, docs, folder).count() == docs.count()


def test_empty_and_repeated_rows(spark, tables):
    folder, texts, _ = tables
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    rows = [(1, texts[0], "en", None, 3)] * 3 + [(1, texts[5], None, "s", None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
    assert sorted((r.doc_id, r.text or "") for r in docs.collect()) == sorted([(1, texts[0]), (1, texts[5]), (2, "")])


def test_run(spark, tables):
    folder, texts, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() < len(texts) and out.columns[0] == "doc_id"


def test_scores(spark, tables):
    folder, texts, _ = tables
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.withColumn("score", docs.doc_id).union(docs.withColumn("score", docs.doc_id).limit(3)), model).collect()
    assert len(rows) == len(texts) + 3 and all(0 <= r.score <= 1 for r in rows)
    unseen = spark.createDataFrame([(1, "so you are a grumpster th an er " * 3, None), (2, "th an er on " * 5000, None), (None, "", None)],
                                   "doc_id long, text string, other string")
    scores = {r.doc_id: r.score for r in toxicity.score(unseen, model).collect()}
    assert scores[1] > 0.5 > scores[2] and 0 <= scores[None] < 0.5
    long = "th an er on " * 40000 + " vilewort " + "st re an " * 100
    assert toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first().score > 0.5


def test_windows_of_long_texts():
    """The windows that hold the words of the highest odds are passed on, in order, within the bound."""
    import numpy as np

    odds = np.full(toxicity.WORD_BUCKETS, -0.1)
    odds[toxicity.hashes_of(["vilewort"])[0]] = 5
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(20_000)]
    for place in (3, 9_999, 19_999):
        words[place] = "vilewort"
    short = toxicity._best_windows(" ".join(words), odds, 2_000)
    assert len(short) <= 2_000 and short.split().count("vilewort") == 3
    starts = [short.split().index("vilewort"), len(short.split()) - 1]
    assert starts[0] == 3 and short.split()[-1] == "vilewort"
    assert toxicity._best_windows("... 123", odds, 100) == "" and toxicity._best_windows("one two", odds, 100) == "one two"


def test_long_labelled_texts_train(spark):
    """Toxic words that only texts above the bound hold are learned."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "re", "st"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(160):
        own = [word() for _ in range(900)]
        if i % 4 == 0:
            own[rng.randrange(900)] = "vilewort"
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known, chars=1_000)
    asked = spark.createDataFrame([(1, "th an er on vilewort re st an"), (2, "th an er on re st an")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert scores[1] > 0.5 > scores[2]


def brute_score(model, text):
    """The network's formulas word by word and step by step, over every window."""
    import math

    import numpy as np

    w, size = model.weights, toxicity.STATE
    words = toxicity.words_of(text)
    if not words:
        return model.rate
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(one):
        word, grams, _ = toxicity.hashes_of([one])
        v = w["ew"][word[0]] + sum(w["ec"][g] for g in grams) / len(grams)
        v = np.array(v, np.float64)
        v[1] += max(w["odds"][g] for g in grams)
        return v @ w["wx"] + w["bx"]

    def layer(inputs, u):
        h, out = np.zeros(size), []
        for x in inputs:
            g = h @ u
            z, r = sigmoid(x[:size] + g[:size]), sigmoid(x[size:2 * size] + g[size:2 * size])
            n = np.tanh(x[2 * size:] + r * g[2 * size:])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    best, start = -math.inf, 0
    while True:
        x = [vector(one) for one in words[start:start + toxicity.WINDOW]]
        ahead = layer([v[:3 * size] for v in x], w["u_f"])
        back = layer([v[3 * size:] for v in reversed(x)], w["u_b"])[::-1]
        states = [np.concatenate(pair) for pair in zip(ahead, back)]
        e = np.array([np.tanh(s @ w["wa"] + w["ba"]) @ w["va"] for s in states])
        alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        best = max(best, float((sum(a * s for a, s in zip(alpha, states)) @ w["wo"] + w["bo"])[0]))
        if start + toxicity.WINDOW >= len(words):
            return float(sigmoid(best))
        start += toxicity.STEP


def test_scores_by_plain_loops(spark, tables):
    folder, texts, _ = tables
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    asked = [(i, t) for i, t in texts.items() if i % 7 == 0] + [(900, "one"), (901, "a b " * 8), (902, "th an " * 100 + "vilewort")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        assert abs(got[i] - brute_score(model, text or "")) < 1e-4, i


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == 2 and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).collect() == []


def test_gradients():
    """Analytic gradients of the recurrent layer against finite differences."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 3, 3 * toxicity.STATE)).astype(np.float64)
    u = rng.normal(size=(toxicity.STATE, 3 * toxicity.STATE)) * 0.5
    mask = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 1], [1, 1, 1]], float)
    weight = rng.normal(size=(4, 3, toxicity.STATE))
    loss = lambda x, u: float((toxicity._recurrent(x, mask, u, False)[0] * weight).sum())
    _, seen = toxicity._recurrent(x, mask, u, True)
    dx, du = toxicity._recurrent_slope(weight, mask, u, seen)
    for array, slope in ((x, dx), (u, du)):
        for _ in range(12):
            k = tuple(rng.integers(0, n) for n in array.shape)
            old = array[k]
            array[k] = old + 1e-2
            high = loss(x, u)
            array[k] = old - 1e-2
            low = loss(x, u)
            array[k] = old
            assert abs((high - low) / 2e-2 - slope[k]) < 2e-2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    asked = docs.join(labels.filter(toxicity.held_out()).select("doc_id", "toxic"), "doc_id")
    rows = toxicity.score(asked, model).select("toxic", "score").collect()
    said = [r.toxic for r in rows if r.score >= 0.5]
    assert len(rows) > 500 and sum(said) >= 0.9 * len(said)
    assert sum(said) >= 0.75 * sum(r.toxic for r in rows)

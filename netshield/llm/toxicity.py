"""Toxicity scores by a bidirectional gated recurrent network, written and trained in numpy.

A word's input is a learned vector of its hash plus the mean of learned vectors of its character
n-grams, with the largest log odds of its n-grams in one place. Two gated recurrent layers read a window of words in both directions, attention pools
their states, and a logistic unit scores the window. A text's score is that of its highest
window; windows of ``WINDOW`` words overlap by half and cover the whole text.

Training sees a text's label only, so each step uses the window that scores highest so far. The
vectors start from smoothed log odds of the labels, and whole words are dropped at random so that
the network also learns from characters. One task trains, over a bounded sample of labelled texts; of
very long ones the tasks before it pass on those windows whose words have the highest log odds. Scoring runs in all tasks over Arrow batches, in blocks of bounded size.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import quoted, text_or_empty
from netshield.llm.minhash import mix
from netshield.session import settle

WINDOW, STEP = 32, 16
WORD_BUCKETS = CHAR_BUCKETS = 1 << 15
SIZE, STATE, POOL = 12, 8, 8
#: Bounds of the training sample: texts of each label, and characters about which a longer text gives in windows.
POSITIVES, NEGATIVES, TRAINING_CHARS = 3000, 5000, 20_000
#: Windows of one text that training keeps: those of the highest log odds.
CANDIDATES = 4
#: Words remembered by a Python worker, and words scored at once.
WORD_MEMORY, BLOCK_WORDS = 60_000, 60_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, those of their character n-grams word after word, and the n-grams' number.

    N-grams have three or five characters of the word between two markers.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    at = np.arange(len(codes))
    whole = np.add.reduceat(mix(codes + (at - (ends - sizes)[owner]).astype(np.uint64) * _BASE), ends - sizes)
    found, owners = [], []
    for n in (3, 5):
        first = np.flatnonzero(at + n <= ends[owner])
        value = np.full(len(first), n, np.uint64)
        for k in range(n):
            value = value * _BASE + codes[first + k]
        found.append((mix(value) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        owners.append(owner[first])
    owners = np.concatenate(owners)
    return ((mix(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64),
            np.concatenate(found)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words)))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word and length of every window of texts with ``counts`` words each."""
    number = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STEP)) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), number)
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    start = np.repeat(np.cumsum(counts) - counts, number) + place * STEP
    return owner, start, np.minimum(WINDOW, counts[owner] - place * STEP)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _recurrent(x: np.ndarray, mask: np.ndarray, weights: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of a gated recurrent layer over inputs ``x`` (steps, rows, 3 * STATE)."""
    steps, rows, _ = x.shape
    h, states, seen = np.zeros((rows, STATE), np.float32), np.empty((steps, rows, STATE), np.float32), []
    for t in range(steps):
        g = h @ weights
        zr = _sigmoid(x[t, :, :2 * STATE] + g[:, :2 * STATE])
        z, r = zr[:, :STATE], zr[:, STATE:]
        n = np.tanh(x[t, :, 2 * STATE:] + r * g[:, 2 * STATE:])
        new = n + z * (h - n)
        if keep:
            seen.append((h, z, r, n, g[:, 2 * STATE:]))
        h = h + mask[t][:, None] * (new - h)
        states[t] = h
    return states, seen


def _recurrent_slope(slope: np.ndarray, mask: np.ndarray, weights: np.ndarray, seen: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and weights from those of the states."""
    dx, dw = np.empty((*slope.shape[:2], 3 * STATE), np.float32), np.zeros_like(weights)
    carry = np.zeros_like(slope[0])
    for t in reversed(range(len(slope))):
        h, z, r, n, gn = seen[t]
        total, m = slope[t] + carry, mask[t][:, None]
        new = m * total
        dn = new * (1 - z) * (1 - n * n)
        dz, dr = new * (h - n) * z * (1 - z), dn * gn * r * (1 - r)
        dg = np.concatenate([dz, dr, dn * r], 1)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        dw += h.T @ dg
        carry = (1 - m) * total + new * z + dg @ weights.T
    return dx, dw


@dataclass
class Model:
    """Network weights by name, and the share of label 1, which texts without words get."""

    weights: dict[str, np.ndarray]
    rate: float

    def pooled(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray, keep: bool = False):
        w = self.weights
        ahead, seen_f = _recurrent(forward, mask, w["u_f"], keep)
        back, seen_b = _recurrent(backward[::-1], mask[::-1], w["u_b"], keep)
        states = np.concatenate([ahead, back[::-1]], 2)
        a = np.tanh(states @ w["wa"] + w["ba"])
        e = np.where(mask > 0, a @ w["va"], -1e9)
        alpha = np.exp(e - e.max(0))
        alpha /= alpha.sum(0)
        p = (alpha[:, :, None] * states).sum(0)
        return p @ w["wo"] + w["bo"], (states, a, alpha, p, seen_f, seen_b)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def drawn(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return {"ew": drawn(WORD_BUCKETS, SIZE, scale=0.02), "ec": drawn(CHAR_BUCKETS, SIZE, scale=0.02),
            "wx": drawn(SIZE, 6 * STATE, scale=0.5), "bx": np.zeros(6 * STATE, np.float32),
            "u_f": drawn(STATE, 3 * STATE, scale=0.3), "u_b": drawn(STATE, 3 * STATE, scale=0.3),
            "wa": drawn(2 * STATE, POOL, scale=0.3), "ba": np.zeros(POOL, np.float32),
            "va": drawn(POOL, scale=0.3), "wo": drawn(2 * STATE, scale=0.3), "bo": np.zeros(1, np.float32)}


def _log_odds(of_text: Iterable[np.ndarray], labels: np.ndarray, buckets: int, rate: float) -> np.ndarray:
    """Smoothed log odds of label 1 among the texts that have each bucket, less the overall ones.

    Zero for buckets of fewer than three texts, which would only name those texts.
    """
    seen, bad = _counts(of_text, labels, buckets)
    return _odds_of(seen, bad, rate)


def _counts(of_text: Iterable[np.ndarray], labels: Iterable[float], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have each bucket, and those of label 1 among them."""
    seen, bad = np.zeros(buckets), np.zeros(buckets)
    for found, label in zip(of_text, labels):
        found = np.unique(found)
        seen[found] += 1
        bad[found] += label
    return seen, bad


def _odds_of(seen: np.ndarray, bad: np.ndarray, rate: float) -> np.ndarray:
    share = (bad + 3 * rate) / (seen + 3)
    return (seen >= 3) * np.clip(np.log(share / (1 - share)) - np.log(rate / (1 - rate)), -3, 6).astype(np.float32)


def train(texts: list[str], labels: list[int], rate: float, steps: int = 160, batch: int = 96, seed: int = 1,
          rate_of_steps: float = 0.01) -> Model:
    """Fit the network in about ``steps`` steps; without texts of both labels, every text scores ``rate``."""
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, rate)
    rng = np.random.default_rng(seed)
    numbers, parts, sizes = {}, [], []
    for text in texts:
        found = words_of(text)
        parts.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in found), np.int64, len(found)))
        sizes.append(len(found))
    known = list(numbers)
    word, grams, lengths = (np.concatenate(x) for x in zip(
        *(hashes_of(known[k:k + 4096]) for k in range(0, len(known) or 1, 4096))))
    gram_at = np.concatenate([[0], np.cumsum(lengths)])
    w = _start(rng)
    sample_rate = float(np.clip(y.mean(), 0.01, 0.99))
    odds_w = _log_odds((word[p] for p in parts), y, WORD_BUCKETS, sample_rate)
    odds_c = _log_odds((np.concatenate([grams[gram_at[k]:gram_at[k + 1]] for k in np.unique(p)]) if len(p)
                        else np.empty(0, int) for p in parts), y, CHAR_BUCKETS, sample_rate)
    w["ew"][:, 0], w["odds"] = odds_w / 3, odds_c / 3
    hint = odds_w[word] + np.maximum.reduceat(odds_c[grams], gram_at[:-1]) if len(word) else np.empty(0)

    # the windows with the highest hints of every text, padded
    hint, offset, pads = np.append(hint, 0), np.arange(WINDOW), len(numbers)
    chosen_windows, owners = [], []
    for k, part in enumerate(parts):
        _, start, length = windows_of(np.array([len(part)], np.int64))
        if len(start):
            windows = np.where(offset < length[:, None], part[np.minimum(start[:, None] + offset, len(part) - 1)], pads)
            best = np.argsort(-np.sort(hint[windows], 1)[:, -3:].sum(1), kind="stable")[:CANDIDATES]
            chosen_windows.append(windows[best])
            owners += [k] * len(best)
    if not owners:
        return Model({}, rate)
    index, owner = np.concatenate(chosen_windows), np.array(owners)
    first, number = np.unique(owner, return_index=True)[1], np.bincount(owner, minlength=len(y))
    usable = np.flatnonzero(number)
    begin = np.zeros(len(y), np.int64)
    begin[usable] = first

    model = Model(w, rate)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items() if k != "odds"}

    def inputs(rows: np.ndarray, drop: float):
        """Vectors of the words of windows; pads are zero."""
        used, back = np.unique(rows, return_inverse=True)
        used_words = used[used < len(numbers)]
        spread = np.concatenate([grams[gram_at[k]:gram_at[k + 1]] for k in used_words])
        sizes = lengths[used_words]
        chars = np.add.reduceat(w["ec"][spread], np.cumsum(sizes) - sizes) / sizes[:, None]
        on = (rng.random(len(used_words)) >= drop).astype(np.float32)
        v = np.zeros((len(used), SIZE), np.float32)
        v[:len(used_words)] = w["ew"][word[used_words]] * on[:, None] + chars
        v[:len(used_words), 1] += np.maximum.reduceat(w["odds"][spread], np.cumsum(sizes) - sizes)
        return v, back.reshape(rows.shape), used_words, spread, sizes, on

    def run(rows: np.ndarray, drop: float = 0.0, keep: bool = False):
        made = inputs(rows, drop)
        x = (made[0] @ w["wx"] + w["bx"])[made[1].T]
        mask = (rows.T < len(numbers)).astype(np.float32)
        logits, cache = model.pooled(x[:, :, :3 * STATE], x[:, :, 3 * STATE:], mask, keep)
        return logits, cache, made, mask

    count = 0
    for epoch in range(max(2, -(-steps * batch // max(1, len(usable))))):
        if epoch == 0:
            chosen = begin[usable]
        else:
            scores = np.concatenate([run(index[k:k + 4096])[0] for k in range(0, len(index), 4096)])
            ranked = np.lexsort((-scores, owner))
            chosen = ranked[np.searchsorted(owner[ranked], usable)]
        shuffled = rng.permutation(len(usable))
        for k in range(0, len(shuffled), batch):
            pick = shuffled[k:k + batch]
            rows, target = index[chosen[pick]], y[usable[pick]]
            logits, (states, a, alpha, p, seen_f, seen_b), made, mask = run(rows, 0.4, True)
            d = (_sigmoid(logits) - target) / len(target)
            g = {"wo": p.T @ d, "bo": d.sum(keepdims=True)}
            dp = d[:, None] * w["wo"]
            dalpha = (states * dp).sum(2)
            de = alpha * (dalpha - (alpha * dalpha).sum(0))
            da = de[:, :, None] * w["va"] * (1 - a * a)
            ds = alpha[:, :, None] * dp + da @ w["wa"].T
            g["va"], g["ba"] = (de[:, :, None] * a).sum((0, 1)), da.sum((0, 1))
            g["wa"] = np.einsum("tbi,tbj->ij", states, da)
            dxf, g["u_f"] = _recurrent_slope(ds[:, :, :STATE], mask, w["u_f"], seen_f)
            dxb, g["u_b"] = _recurrent_slope(ds[::-1, :, STATE:], mask[::-1], w["u_b"], seen_b)
            dx = np.concatenate([dxf, dxb[::-1]], 2).transpose(1, 0, 2).reshape(-1, 6 * STATE)
            v, back, used_words, spread, sizes, on = made
            summed = np.zeros((len(v), 6 * STATE), np.float32)
            np.add.at(summed, back.ravel(), dx)
            g["bx"], g["wx"] = summed.sum(0), v.T @ summed
            dv = (summed @ w["wx"].T)[:len(used_words)]
            g["ew"], g["ec"] = np.zeros_like(w["ew"]), np.zeros_like(w["ec"])
            np.add.at(g["ew"], word[used_words], dv * on[:, None])
            np.add.at(g["ec"], spread, np.repeat(dv / sizes[:, None], sizes, 0))
            count += 1
            for name, value in g.items():
                m, s = moments[name]
                m += 0.1 * (value - m)
                s += 0.01 * (value * value - s)
                w[name] -= rate_of_steps * (m / (1 - 0.9 ** count)) / (np.sqrt(s / (1 - 0.99 ** count)) + 1e-6)
    return model


class _Inputs:
    """Recurrent inputs of words as a growing table; forgotten when it holds too many words."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * STATE), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Table rows of ``words``, of which a call may have any number."""
        if len(self.numbers) > WORD_MEMORY:
            self.numbers.clear()
        known = len(self.numbers)
        numbers = self.numbers
        out = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
        if len(numbers) > known:
            while len(self.table) < len(numbers):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            w, new = self.weights, list(numbers)[known:]
            for k in range(0, len(new), 8192):
                word, grams, sizes = hashes_of(new[k:k + 8192])
                start = np.cumsum(sizes) - sizes
                v = w["ew"][word] + np.add.reduceat(w["ec"][grams], start) / sizes[:, None].astype(np.float32)
                v[:, 1] += np.maximum.reduceat(w["odds"][grams], start)
                self.table[known + k:known + k + len(v)] = v @ w["wx"] + w["bx"]
        return out


def score_texts(model: Model, memory: _Inputs | None, texts: list[str]) -> np.ndarray:
    """Scores of whole texts: that of the highest window, or the label's rate without words."""
    out = np.full(len(texts), model.rate)
    if memory is None:
        return out
    found = [words_of(t) for t in texts]
    counts = np.array([len(f) for f in found], np.int64)
    rows = memory.rows([x for f in found for x in f])
    owner, start, length = windows_of(counts)
    highest = np.full(len(texts), -np.inf)
    offset = np.arange(WINDOW)
    for k in range(0, len(owner), 1024):
        part = slice(k, k + 1024)
        inside = (offset < length[part, None]).T
        index = rows[np.minimum(start[part, None] + offset, len(rows) - 1)].T
        x = memory.table[index]
        logits, _ = model.pooled(x[:, :, :3 * STATE], x[:, :, 3 * STATE:], inside.astype(np.float32))
        np.maximum.at(highest, owner[part], logits)
    some = counts > 0
    out[some] = _sigmoid(highest[some])
    return out


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.col(quoted(id)).cast("string").cast("binary")) % 5 == 0


def _shortened(sample: DataFrame, chars: int) -> DataFrame:
    """``id, label, text`` with the best windows only of texts above ``chars`` characters, whatever their label.

    Word counts of the bounded sample are summed by bucket, so what reaches the driver is bounded, too.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = np.zeros(WORD_BUCKETS), np.zeros(WORD_BUCKETS)
        for batch in batches:
            for label, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                more = _counts([hashes_of(list(set(words_of(value.as_py()))))[0]], [label], WORD_BUCKETS)
                seen += more[0]
                bad += more[1]
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held]), pa.array(bad[held])], ["bucket", "seen", "bad"])

    if sample.filter(F.length("text") > chars).limit(1).count() == 0:
        return sample
    seen, bad = np.zeros(WORD_BUCKETS), np.zeros(WORD_BUCKETS)
    for row in sample.mapInArrow(counted, "bucket long, seen double, bad double").groupBy("bucket").agg(
            F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).collect():
        seen[row["bucket"]], bad[row["bucket"]] = row["seen"], row["bad"]
    share = sample.agg(F.avg("label").alias("share")).first()["share"]
    odds = _odds_of(seen, bad, float(np.clip(share, 0.01, 0.99)))

    @F.arrow_udf("string")
    def best_windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_best_windows(value.as_py(), odds, chars) for value in batch], pa.string())

    long = F.length("text") > chars
    return sample.filter(~long).union(sample.filter(long).select("id", "label", best_windows("text").alias("text")))


def _best_windows(text: str, odds: np.ndarray, chars: int) -> str:
    """Windows of ``WINDOW`` words with the largest sums of their three highest odds, in order."""
    words = words_of(text)
    if not words:
        return ""
    size = -(-len(words) // WINDOW)
    value = np.zeros(size * WINDOW)
    for k in range(0, len(words), 8192):
        value[k:k + 8192][:len(words) - k] = odds[hashes_of(words[k:k + 8192])[0]]
    best = np.argsort(-np.sort(value.reshape(size, WINDOW), 1)[:, -3:].sum(1), kind="stable")
    kept, left = [], chars
    for k in best.tolist():
        window = " ".join(words[k * WINDOW:(k + 1) * WINDOW])
        left -= len(window) + 1
        if left < 0:
            break
        kept.append((k, window))
    return " ".join(window for _, window in sorted(kept))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        positives: int = POSITIVES, negatives: int = NEGATIVES, chars: int = TRAINING_CHARS) -> Model:
    """Train on labelled rows whose id isn't held out.

    The sample is bounded: at most ``positives`` and ``negatives`` ids, in the order of a hash of
    the id. Of texts above ``chars`` characters the windows with the highest log odds train, about
    ``chars`` characters of them. Rows without an id, text or label of 0 or 1 are left out; an id
    with both labels counts as 1, one with several texts gives one.
    """
    known = (labels.select(F.col(id).alias("id"), F.col(label).alias("label")).filter("id is not null and label in (0, 1)")
             .filter(~held_out("id")).groupBy("id").agg(F.max("label").alias("label")))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rate = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 10)
    picked = known.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(positives).union(
        known.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(negatives))
    sample = (docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
              .join(F.broadcast(picked), "id")  # a bounded number of rows
              .groupBy("id", "label").agg(F.min("text").alias("text")))
    sample = _shortened(settle(sample.select("id", F.col("label").cast("int").alias("label"), "text"), "labelled"), chars)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
        model = train([r["text"] for r in rows], [r["label"] for r in rows], rate)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = sample.repartition(1).mapInArrow(trained, "model binary").first()
    return pickle.loads(found["model"]) if found else Model({}, rate)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score``, from 0 to 1, to every row.

    Null and empty texts and texts without letters score the share of label 1 among the labels.
    Repeated rows score alike. An input column named ``score`` is replaced, others pass through.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _Inputs(model) if model.weights else None
        for batch in batches:
            out, block, size = [], [], 0
            for value in batch:
                block.append(value.as_py())
                size += len(block[-1]) // 6 + 1
                if size > BLOCK_WORDS:
                    out.append(score_texts(model, memory, block))
                    block, size = [], 0
            out.append(score_texts(model, memory, block))
            yield pa.array(np.concatenate(out), pa.float64())
            del batch, block
            pa.default_memory_pool().release_unused()

    return df.withColumn("score", scored(text_or_empty(text)))

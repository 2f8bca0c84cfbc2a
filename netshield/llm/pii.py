"""Personal data by fixed patterns and weak supervision, with Spark SQL functions only.

Four base kinds come from their patterns. Further candidates (credential values and phone numbers
in local notation) get votes of labelers: their shape, a gazetteer of words before them, the
characters around them, and their length. Expectation-maximisation over the counts of distinct
vote combinations estimates how reliable each labeler is, and its posteriors train a logistic
classifier on span features that decides alone which candidates become spans. The combinations
are a fixed set of small integers, so what reaches the driver doesn't grow with the table.

Spans are found by wrapping every match in two control characters and splitting there; the text's
own such characters are first swapped for another one, so lengths stay. Possessive quantifiers
and guards before a match keep the time linear in the text and don't change what is found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import fresh, text_or_empty
from netshield.session import compute_once, settle

# The base patterns, kept as given but for possessive quantifiers and guards.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Kinds that the method adds; they sort after the base kinds.
ADDED = ("secret", "local_phone")
CANDIDATE = (r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{12,}+"
             r"|(?<![0-9+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
#: Words that announce a candidate, by kind.
GAZETTEER = {
    "secret": "password passwd pwd token secret key apikey credential bearer auth kennwort clave contraseña jeton",
    "local_phone": "phone tel telephone mobile cell call fax telefon handy anruf teléfono móvil téléphone portable",
}
_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"
_CHUNK = 256
LABELERS = ("shape", "gazetteer", "context", "size")
FEATURES = ("length", "digits", "announced", "assigned", "quoted", "hex", "grouped")


def _running(values: Column) -> Column:
    """Sums of all earlier elements; in chunks, so that long arrays aren't copied each time."""
    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("seen")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"),
                                    F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))["seen"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")),
                         lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)))
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    starts = sums(F.transform(chunks, total), F.lit(0))
    return F.flatten(F.zip_with(chunks, starts, sums))


def _pieces(text: Column, pattern: str, needs: str | None) -> Column:
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    if needs:
        marked = F.when(F.contains(text, F.lit(needs)), marked).otherwise(text)
    return F.split(marked, _OPEN, -1)


def _matches(pieces: Column, starts: Column) -> Column:
    """Every match with its start, its value, and the text around it since other matches."""
    def one(i: Column) -> Column:
        return F.struct(
            F.get(starts, i).alias("start"),
            F.substring_index(F.get(pieces, i), _CLOSE, 1).alias("value"),
            F.lower(F.right(F.substring_index(F.get(pieces, i - 1), _CLOSE, -1), F.lit(24))).alias("before"),
            F.left(F.substring_index(F.get(pieces, i), _CLOSE, -1), F.lit(1)).alias("after"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.size(pieces)), F.lit(2), F.size(pieces) - 1), one)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(bare(x)) < 3)
                        | ((F.length(bare(x)) == 3) & (bare(x) <= F.lit("255"))))
    count = F.length(_digits(value))
    if kind == "card":
        return count.between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return count.between(10, 15)
    return F.lit(True)


def _span(kind: Column, match: Column) -> Column:
    return F.struct(match["start"].cast("bigint").alias("start"),
                    (match["start"] + F.length(match["value"])).cast("bigint").alias("end"), kind.alias("kind"))


def _base(kind: str) -> Column:
    return F.transform(F.filter(f"m_{kind}", lambda m: _valid(kind, m["value"])), lambda m: _span(F.lit(kind), m))


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _vote(*cases: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out.cast("tinyint")


def _candidate(match: Column) -> Column:
    """Kind, place, votes and features of a candidate; votes are -1, 0 or 1."""
    value, before, after = match["value"], match["before"], match["after"]
    secret = F.regexp_like(value, F.lit("[A-Za-z]"))
    kind = F.when(secret, ADDED[0]).otherwise(ADDED[1])
    size, count = F.length(value), F.length(_digits(value))
    words = {k: "(" + "|".join(GAZETTEER[k].split()) + r")[^\p{L}]{0,6}$" for k in ADDED}
    announced = F.when(secret, F.regexp_like(before, F.lit(words["secret"]))).otherwise(
        F.regexp_like(before, F.lit(words["local_phone"])))
    assigned = F.regexp_like(before, F.lit(r"[=:]\s*[\"']?$"))
    quoted = F.regexp_like(before, F.lit("[\"']$")) & F.regexp_like(after, F.lit("[\"']"))
    hexadecimal = F.regexp_like(value, F.lit("^([0-9a-f]+|[0-9A-F]+)$"))
    grouped = F.regexp_like(value, F.lit(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"))
    mixed = (count * 8 >= size) & (count * 8 <= size * 7)
    joined = F.regexp_like(before, F.lit(r"[/.#$€%@\w]$")) | F.regexp_like(after, F.lit(r"[/@%\w]"))
    shape = F.when(secret, _vote((hexadecimal, 1), (F.contains(value, F.lit("/")), -1), (mixed, 1),
                                 (F.lit(True), -1))).otherwise(_vote((grouped, 1), (size == count, -1)))
    context = F.when(assigned | quoted, 1).when(joined, -1).otherwise(0).cast("tinyint")
    length = F.when(secret, _vote((size.between(16, 128), 1), (F.lit(True), -1))).otherwise(
        _vote((count.between(9, 11), 1), (count > 13, -1)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("tinyint")
    return F.struct(
        match["start"].cast("bigint").alias("start"), (match["start"] + size).cast("bigint").alias("end"),
        kind.alias("kind"),
        F.struct(shape.alias("shape"), _vote((announced, 1)).alias("gazetteer"), context.alias("context"),
                 length.alias("size")).alias("votes"),
        F.struct(F.when(size < 14, 0).when(size < 20, 1).when(size < 48, 2).otherwise(3).cast("tinyint")
                 .alias("length"),
                 F.floor(count * 4 / (size + 1)).cast("tinyint").alias("digits"), flag(announced).alias("announced"),
                 flag(assigned).alias("assigned"), flag(quoted).alias("quoted"), flag(hexadecimal).alias("hex"),
                 flag(grouped).alias("grouped")).alias("features"))


def reliabilities(counts: list[tuple[tuple, float]], rounds: int = 40) -> list[float]:
    """Posterior of each vote combination, by expectation-maximisation.

    ``counts`` holds (votes, number of candidates). Labelers are independent given the truth; the
    first posteriors follow the sum of votes, and probabilities are smoothed by one candidate.
    """
    posterior = [0.9 if sum(v) > 1 else 0.4 if sum(v) == 1 else 0.1 for v, _ in counts]
    total = sum(n for _, n in counts)
    for _ in range(rounds):
        mass = sum(n * p for (_, n), p in zip(counts, posterior))
        prior = (mass + 0.5) / (total + 1)
        tables = []
        for j in range(len(counts[0][0])):
            seen = {(y, v): 1.0 for y in (0, 1) for v in (-1, 0, 1)}
            for (votes, n), p in zip(counts, posterior):
                seen[1, votes[j]] += n * p
                seen[0, votes[j]] += n * (1 - p)
            tables.append({(y, v): x / (3 + (mass if y else total - mass)) for (y, v), x in seen.items()})
        posterior = []
        for votes, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(t[1, v] / t[0, v]) for t, v in zip(tables, votes))
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return posterior


def _indicators(features: tuple) -> list[float]:
    length, digits, *flags = features
    return [1.0, *(float(length == k) for k in (1, 2, 3)), *(float(digits == k) for k in (1, 2, 3)), *map(float, flags)]


def fit(rows: list[tuple[tuple, float, float]], steps: int = 400, rate: float = 1.0,
        decay: float = 1e-3) -> list[float]:
    """Logistic weights from (features, count, posterior), by full gradient steps."""
    total = sum(n for _, n, _ in rows)
    inputs = [(_indicators(f), n / total, p) for f, n, p in rows]
    weights = [0.0] * len(inputs[0][0])
    for _ in range(steps):
        slope = [decay * w for w in weights]
        for x, n, p in inputs:
            error = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(map(float.__mul__, x, weights)))))) - p)
            for k, value in enumerate(x):
                slope[k] += error * value
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def _score(features: Column, weights: list[float]) -> Column:
    flags = [features[name].cast("double") for name in FEATURES[2:]]
    is_one = lambda name, k: (features[name] == k).cast("double")
    inputs = [F.lit(1.0), *(is_one("length", k) for k in (1, 2, 3)), *(is_one("digits", k) for k in (1, 2, 3)), *flags]
    return sum((F.lit(w) * x for w, x in zip(weights, inputs)), F.lit(0.0))


def learn(found: DataFrame, candidates: str) -> dict[str, list[float]]:
    """Weights of the span classifier for each added kind that has candidates."""
    combinations = (found.select(F.explode(candidates).alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
                    .orderBy("kind", "votes", "features").collect())
    out = {}
    for kind in ADDED:
        own = [(tuple(r["votes"]), tuple(r["features"]), float(r["count"])) for r in combinations if r["kind"] == kind]
        if own:
            posterior = reliabilities([(votes, n) for votes, _, n in own])
            out[kind] = fit([(features, n, p) for (_, features, n), p in zip(own, posterior)])
    return out


def find(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``base_spans`` and ``spans``: arrays of ``start, end, kind`` in code points.

    ``base_spans`` holds the four base kinds; ``spans`` also holds accepted candidates that overlap
    no base span. Both are sorted by start, then kind in the order of ``KINDS`` and ``ADDED``; ends
    are exclusive. One output row per input row; a null or empty text has empty arrays. Repeated
    rows and ids are treated alike. Input columns named ``base_spans`` or ``spans`` are replaced,
    those named in ``drop`` are left out, all others pass through. The matches are written to the
    shared folder, as they are read for training and for the result.
    """
    kept = [c for c in df.columns if c not in drop and c.lower() not in ("base_spans", "spans")]
    row, names = fresh(df, "kept"), (*KINDS, "extra")
    whole = F.translate(text_or_empty(text), _OPEN + _CLOSE, _OTHER * 2)
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias(fresh(df, "one"))).alias(row),
                   whole.alias("whole"))
    patterns = {**PATTERNS, "extra": CANDIDATE}
    df = compute_once(df, **{k: _pieces(F.col("whole"), patterns[k], _NEEDS.get(k)) for k in names}).drop("whole")
    df = compute_once(df, **{f"at_{k}": _running(
        F.transform(k, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))) for k in names})
    df = compute_once(df, **{f"m_{k}": _matches(F.col(k), F.col(f"at_{k}")) for k in names})
    order = F.map_from_arrays(*[F.array(*map(F.lit, x)) for x in (KINDS + ADDED, range(len(KINDS + ADDED)))])
    ordered = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), order[s["kind"]].alias("n"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    df = compute_once(df, base_spans=ordered(F.concat(*map(_base, KINDS))))
    apart = lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = settle(df.select(row, "base_spans", F.filter(
        F.transform("m_extra", _candidate), apart).alias("extra")), "spans")
    weights = learn(found, "extra")
    if weights:
        accepted = lambda c: sum(
            (F.when(c["kind"] == k, _score(c["features"], w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0)) > 0
        extra = F.transform(F.filter("extra", accepted), lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
        spans = ordered(F.concat("base_spans", extra))
    else:
        spans = F.col("base_spans")
    return found.select(*[F.col(row)[c].alias(c) for c in kept], "base_spans", spans.alias("spans"))


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    whole = text_or_empty(text)
    parts = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.array(
                    F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))))
    done = F.concat(F.array_join(parts["out"], ""), F.substring(whole, (parts["at"] + 1).cast("int"), F.length(whole)))
    return F.when(F.size(spans) == 0, F.col(f"`{text}`")).otherwise(done)


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, ``base_sha256`` and ``spans`` as text."""
    return found.select(
        "doc_id", *[F.size(_of_kind("base_spans", k)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written("base_spans"), 256).alias("base_sha256"), _written("spans").alias("spans"))

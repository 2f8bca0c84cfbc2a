"""License detections by ordered signature rules.

A text is reduced to lower-case words with one space between them. Hundreds of hand-written patterns
(``license_rules``) look for texts, notices, names and weak signs of licenses; a pattern is tried
only on texts that hold the words it needs. Where detections overlap, one that lies inside the
interval of a detection of higher priority goes (of equal priority: inside a longer one, or the same
interval of an earlier rule). Places of given phrases are found beside the rules and always stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import fresh, text_or_empty
from netshield.llm.license_rules import rules

# Phrases whose places count as base detections, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: How sure a detection of each priority is.
SURE = {1: 0.95, 2: 0.9, 3: 0.7, 4: 0.3}
#: Priority of a phrase in the score.
PHRASE_PRIORITY = 2

_WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_TO_WORDS = bytes(b if b in _WORD_BYTES else 0x20 for b in range(256)).lower()

Detection = tuple[int, int, int]  # start and end in words, rule


class Signatures:
    """Compiled rules by the words they need."""

    def __init__(self, table: Iterable[tuple[str, int, tuple[frozenset[bytes], ...], bytes]]):
        self.rules = [(label, priority, needs, re.compile(b" (?:" + pattern + b")(?= )"))
                      for label, priority, needs, pattern in table]
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for k, (_, _, needs, _) in enumerate(self.rules):
            for word in needs[0]:
                self.by_word[word].append(k)
        self.words = frozenset(self.by_word)

    def candidates(self, held: set[bytes]) -> list[int]:
        """Rules whose needed words a text holds; of each group of spellings one is enough."""
        first = {k for word in held & self.words for k in self.by_word[word]}
        return sorted(k for k in first if all(held & group for group in self.rules[k][2]))

    def rank(self, found: Detection) -> tuple[int, int, int]:
        start, end, rule = found
        return self.rules[rule][1], start - end, rule

    def unsuppressed(self, found: Iterable[Detection]) -> list[Detection]:
        """Detections that lie in no interval of a higher one, by start, end and rule.

        In order of starts (longest first) any interval around a detection comes before it, so the
        furthest end of each priority so far decides.
        """
        kept, furthest = [], {p: -1 for p in SURE}
        order = sorted(found, key=lambda d: (d[0], -d[1], self.rank(d)))
        for d in order:
            priority = self.rules[d[2]][1]
            if all(furthest[p] < d[1] for p in SURE if p <= priority):
                kept.append(d)
            furthest[priority] = max(furthest[priority], d[1])
        return sorted(kept)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def _places(spaced: bytes, phrase: bytes) -> Iterator[int]:
    at = spaced.find(phrase)
    while at >= 0:
        yield at
        at = spaced.find(phrase, at + 1)


@lru_cache(maxsize=1)
def _signatures() -> Signatures:
    return Signatures(rules())


def scan_text(text: str, phrases: Sequence[tuple[bytes, str]], signatures: Signatures
              ) -> tuple[int, list[tuple[str, int]], list[Detection]]:
    """Number of words, places of the phrases, and the detections that stay."""
    words = words_of(text)
    held = set(words)
    wanted = [(phrase, label) for phrase, label in phrases if held.issuperset(phrase.split())]
    tried = signatures.candidates(held)
    if not wanted and not tried:
        return len(words), [], []
    spaced = b" " + b" ".join(words) + b" "
    gaps = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 0x20)
    at_word = lambda places: np.searchsorted(gaps, places).tolist()
    base = sorted((start, label) for phrase, label in wanted for start in at_word(list(_places(spaced, b" " + phrase + b" "))))
    found = []
    for k in tried:
        spans = [m.span() for m in signatures.rules[k][3].finditer(spaced)]
        if spans:
            starts, ends = zip(*spans)
            found += zip(at_word(starts), at_word(ends), [k] * len(spans))
    return len(words), [(label, start) for start, label in base], signatures.unsuppressed(found)


def scan(df: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """Add ``n_words``, ``base`` and ``detections`` to each row.

    Words are runs of ASCII letters, digits and any characters beyond ASCII, of the whole text. ``base``
    lists the label and first word of every place where a phrase's words stand consecutively,
    ``detections`` the label, priority and words (from 0, end exclusive) of the signatures that nothing
    suppresses; both are ordered by place. A null or empty text has no words and empty lists. Rows,
    repeated ones too, and all other columns stay; input columns of the three names are replaced.
    """
    plain = [(phrase.encode(), label) for phrase, label in phrases]

    @F.arrow_udf("struct<n_words:bigint,base:array<struct<label:string,start:bigint>>,"
                 "detections:array<struct<label:string,priority:int,start:bigint,end:bigint>>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signatures = _signatures()
        place = pa.struct([("label", pa.string()), ("start", pa.int64())])
        span = pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            sizes, bases, spans = [], [], []
            for value in batch:
                n, base, found = scan_text(value.as_py(), plain, signatures)
                sizes.append(n)
                bases.append([{"label": label, "start": start} for label, start in base])
                spans.append([{"label": signatures.rules[k][0], "priority": signatures.rules[k][1],
                               "start": start, "end": end} for start, end, k in found])
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(bases, pa.list_(place)), pa.array(spans, pa.list_(span))],
                ["n_words", "base", "detections"])

    made = fresh(df, "scanned")
    found = df.withColumn(made, scanned(text_or_empty(text)))
    return found.withColumns({name: F.col(made)[name] for name in ("n_words", "base", "detections")}).drop(made)


def labels(*lists: str) -> Column:
    """The distinct labels of the columns' entries, sorted and joined by commas."""
    every = F.concat(*[F.transform(name, lambda d: d["label"]) for name in lists])
    return F.array_join(F.array_sort(F.array_distinct(every)), ",")


def score() -> Column:
    """Chance that some license applies: of each label its surest detection counts, as if independent."""
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])
    pairs = F.array_distinct(F.concat(
        F.transform("detections", lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority"))),
        F.transform("base", lambda d: F.struct(d["label"].alias("label"), F.lit(PHRASE_PRIORITY).alias("priority")))))
    ordered = F.array_sort(pairs)
    first = F.filter(ordered, lambda d, i: (i == 0) | (F.get(ordered, i - 1)["label"] != d["label"]))
    return F.lit(1.0) - F.aggregate(first, F.lit(1.0), lambda left, d: left * (1 - sure[d["priority"]]))

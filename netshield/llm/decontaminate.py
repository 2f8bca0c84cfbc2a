"""Documents that contain passages of a benchmark, by q-gram lemma filtering and banded alignment.

Texts are normalised: A-Z lower-cased, white space runs as one space, none at the ends. Each
benchmark item is cut into probes of ``PROBE`` characters that overlap by half (shorter items are
one probe). A document holds a probe of ``m`` characters when some region of it is within
``e = floor(EDITS * m)`` edits. By the q-gram lemma such a region shares at least
``m - q + 1 - q * e`` q-grams with the probe, on diagonals at most ``e`` apart. So matches are
counted in diagonal bands of ``2 * (e + 1)`` that overlap by half; bands that reach the bound are
verified by an alignment that stays inside the band, widened by the budget. ``PROBE`` or more
characters of an item in a row are found wherever they start: as q-grams at consecutive places of
the document and of the item.

Before matches are expanded by probe, positions go where no window of a probe's length plus its
budget holds enough positions with any benchmark q-gram; that follows from the same bound.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import fresh, quoted, text_or_empty
from netshield.llm.minhash import mix
from netshield.session import settle

Q, PROBE, EDITS = 7, 100, 0.12
#: Normalised items with fewer characters identify nothing and are left out.
SHORTEST = 30
#: Bytes of benchmark texts that one index holds; a larger benchmark is searched in several passes.
INDEX_BYTES = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
# White space, as Python splits at it.
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_TABLE_BITS = 20
#: Bits of a band's number beside its probe.
_SHIFT = 34


def _lowered(codes: np.ndarray) -> np.ndarray:
    return codes + ((codes >= 65) & (codes <= 90)) * np.uint32(32)


def normalised(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    return _lowered(np.frombuffer(" ".join(text.split()).encode("utf-32-le", "surrogatepass"), np.uint32))


def places(text: str) -> np.ndarray:
    """The place in the text of each character of the normalised text; of white space, the run's last."""
    space = np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _SPACES)
    keep = ~space
    keep[:-1] |= keep[1:] & space[:-1]
    place = np.flatnonzero(keep)
    return place[1:] if len(place) and space[place[0]] else place


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the text's q-grams, joined from those of shorter ones."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    one = codes.astype(np.uint64)
    value, size, power, base = None, 0, one, _BASE
    for bit in range(Q.bit_length()):
        width = 1 << bit
        if Q & width:
            value = power if value is None else value[:len(power) - size] * base + power[size:]
            size += width
        if width * 2 <= Q:
            power = power[:-width] * base + power[width:]
            base = np.uint64(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return mix(value[:len(codes) - Q + 1])


@dataclass
class Index:
    """Probes and the sorted q-grams that lead to them."""

    items: list
    probes: list[np.ndarray]
    item_of: np.ndarray
    begin: np.ndarray
    texts: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    probe: np.ndarray
    offset: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple]) -> Index:
        items, probes, item_of, begin, texts = [], [], [], [], []
        for item, text in sorted(rows, key=repr):
            codes = normalised(text)
            if len(codes) < SHORTEST:
                continue
            last = max(0, len(codes) - PROBE)
            for start in sorted({*range(0, last, PROBE // 2), last}):
                probes.append(codes[start:start + PROBE])
                item_of.append(len(items))
                begin.append(start)
            items.append(item)
            texts.append(codes)
        size = np.array([len(p) for p in probes], np.int64)
        budget = np.floor(EDITS * size).astype(np.int64)
        each = [grams(p) for p in probes]
        key = np.concatenate(each) if each else np.empty(0, np.uint64)
        probe = np.repeat(np.arange(len(probes)), [len(g) for g in each])
        offset = np.concatenate([np.arange(len(g)) for g in each]) if each else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return cls(items, probes, np.array(item_of, np.int64), np.array(begin, np.int64), texts, budget, size - Q + 1 - Q * budget, keys,
                   np.append(first, len(key)), probe[order], offset[order], table)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item number, start, end and edits of every item that the text holds (its best probe)."""
        codes = normalised(text)
        if not self.probes or len(codes) < Q:
            return []
        found = grams(codes)
        at = np.flatnonzero(self.table[(found >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        least, reach = int(self.bound.min()), PROBE + int(self.budget.max())
        if len(at) < least:
            return []
        number = np.searchsorted(self.keys, found[at])
        real = number < len(self.keys)
        real[real] = self.keys[number[real]] == found[at[real]]
        at, number = at[real], number[real]
        if len(at) < least:
            return []
        # keep what lies in some window of `reach` positions with at least `least` matches
        dense = at[least - 1:] - at[:len(at) - least + 1] <= reach
        cover = np.zeros(len(at) + 1, np.int64)
        begins = np.flatnonzero(dense)
        np.add.at(cover, begins, 1)
        np.add.at(cover, begins + least, -1)
        on = np.cumsum(cover[:-1]) > 0
        at, number = at[on], number[on]
        if not len(at):
            return []
        many = self.first[number + 1] - self.first[number]
        post = np.repeat(self.first[number] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        probe = self.probe[post]
        best = self.fragments(codes, np.repeat(at, many), post)
        diagonal = np.repeat(at, many) - self.offset[post]
        width = self.budget[probe] + 1
        band = diagonal // width + 1 + PROBE  # not negative
        key = np.concatenate([(probe << _SHIFT) + band, (probe << _SHIFT) + band - 1])
        offset = np.tile(self.offset[post], 2)
        # bands that could reach the bound: counted by hash first, then by place of the probe, each once
        bits = max(8, int(4 * len(key)).bit_length())
        cell = ((key.astype(np.uint64) * _BASE) >> np.uint64(64 - bits)).astype(np.int64)
        likely = np.bincount(cell, minlength=1 << bits)[cell] >= least
        placed = np.sort(key[likely] * PROBE + offset[likely])
        placed = placed[np.append(True, placed[1:] != placed[:-1])[:len(placed)]] // PROBE
        bands, counts = np.unique(placed, return_counts=True)
        bands = bands[counts >= self.bound[bands >> _SHIFT]]
        spans = []
        for one in bands.tolist():
            p, b = one >> _SHIFT, (one & ((1 << _SHIFT) - 1)) - 1 - PROBE
            w = int(self.budget[p]) + 1
            spans.append((int(self.item_of[p]), one, p, b * w - w + 1, (b + 2) * w + w - 2, w))
        for item, _, p, low, high, _ in spans:
            if item not in best:
                start = exact(self.probes[p], codes, low, high)
                if start >= 0:
                    best[item] = (start, start + len(self.probes[p]), 0)
        tried = []
        for item, one, p, low, high, w in spans:
            if item not in best:
                edits = fewest_edits(self.probes[p], codes, low, high)
                if edits < w:
                    tried.append((item, edits, one, p, low, high, w))
        for item, edits, _, p, low, high, w in sorted(tried):
            if item not in best or edits < best[item][2]:
                hit = aligned(self.probes[p], codes, low, high, w - 1)
                if hit and (item not in best or hit[2] < best[item][2]):
                    best[item] = hit
        if not best:
            return []
        place = places(text)
        return [(item, int(place[s]), int(place[e - 1]) + 1, edits) for item, (s, e, edits) in sorted(best.items())]


    def fragments(self, codes: np.ndarray, at: np.ndarray, post: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Start, end and 0 edits of the first ``PROBE`` or more characters in a row of each item.

        ``post`` are the postings of the q-grams at the places ``at`` of the text, in order.
        """
        size = PROBE - Q + 1
        places_with = at[np.append(True, at[1:] != at[:-1])]
        if len(places_with) < size:
            return {}
        full = np.flatnonzero(places_with[size - 1:] - places_with[:len(places_with) - size + 1] == size - 1)
        if not len(full):
            return {}
        cover = np.zeros(len(places_with) + 1, np.int64)
        np.add.at(cover, full, 1)
        np.add.at(cover, full + size, -1)
        on = np.isin(at, places_with[np.cumsum(cover[:-1]) > 0])
        at, post = at[on], post[on]
        item = self.item_of[self.probe[post]]
        diagonal = at - self.begin[self.probe[post]] - self.offset[post]
        order = np.lexsort((at, diagonal, item))
        item, diagonal, at = item[order], diagonal[order], at[order]
        new = np.append(True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1]))
        item, diagonal, at = item[new], diagonal[new], at[new]
        cut = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)))
        length = np.diff(np.append(cut, len(at)))
        best: dict[int, tuple[int, int, int]] = {}
        for k, n in zip(cut[length >= size].tolist(), length[length >= size].tolist()):
            number, start, end = int(item[k]), int(at[k]), int(at[k]) + n + Q - 1
            there = start - int(diagonal[k])
            if (number not in best or start < best[number][0]) and np.array_equal(
                    codes[start:end], self.texts[number][there:there + end - start]):
                best[number] = (start, end, 0)
        return best


def exact(probe: np.ndarray, codes: np.ndarray, low: int, high: int) -> int:
    """Where the text holds the probe unchanged on one of the diagonals, or -1."""
    first = max(0, low)
    region, wanted = codes[first:max(first, high + len(probe))].tobytes(), probe.tobytes()
    at = region.find(wanted)
    while at % 4 and at >= 0:
        at = region.find(wanted, at + 1)
    return first + at // 4 if at >= 0 else -1


def fewest_edits(probe: np.ndarray, codes: np.ndarray, low: int, high: int) -> int:
    """Edits of the best alignment on diagonals ``low`` to ``high``, or fewer at the ends of the text.

    What lies outside the text counts as characters that match nothing.
    """
    width = high - low + 1
    first, last = max(0, low), max(0, min(len(codes), high + len(probe)))
    text = np.full(width + len(probe) - 1, 0xFFFFFFFF, np.uint32)
    text[first - low:max(first, last) - low] = codes[first:last]
    slope = np.arange(width)
    cost = np.zeros(width, np.int64)
    skip = np.empty(width, np.int64)
    skip[-1] = 1 << 30
    for i, code in enumerate(probe):
        np.add(cost[1:], 1, out=skip[:-1])
        new = np.minimum(cost + (text[i:i + width] != code), skip) - slope
        cost = np.minimum.accumulate(new) + slope
    return int(cost.min())


def aligned(probe: np.ndarray, codes: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the best region for the probe on diagonals ``low`` to ``high``.

    None when it takes more than ``budget`` edits. Among equally good ends the first is taken, and
    the start that its alignment reaches by substitutions before gaps.
    """
    diagonals = np.arange(low, high + 1)
    far = len(probe) + len(codes) + 1
    cost = np.where((diagonals >= 0) & (diagonals <= len(codes)), 0, far)
    start = diagonals.copy()
    for i, code in enumerate(probe):
        column = diagonals + i  # place in the text that diagonal k pairs with the probe's place i
        inside = (column >= 0) & (column < len(codes))
        same = np.zeros(len(diagonals), bool)
        same[inside] = codes[column[inside]] == code
        swap = np.where(inside, cost + ~same, far)
        skip = np.append(cost[1:], far) + 1  # leave out the probe's character
        skip[(column + 1 < 0) | (column + 1 > len(codes))] = far
        new = np.minimum(swap, skip)
        begun = np.where(swap <= skip, start, np.append(start[1:], 0))
        shifted = new - diagonals
        lowest = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == lowest, np.arange(len(new)), 0))
        cost, start = np.minimum(lowest + diagonals, far), begun[source]
        cost = np.where((column + 1 >= 0) & (column + 1 <= len(codes)), cost, far)
    k = int(np.argmin(cost))
    end = int(diagonals[k]) + len(probe)
    if cost[k] > budget or end <= start[k]:
        return None
    return max(0, int(start[k])), end, int(cost[k])


def search(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
           item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Add ``leaks``: an array of ``item_id, start, end, edits``, sorted by item and start.

    It holds one entry for each benchmark item with a probe in the whole text: the region of the
    probe with the fewest edits, in code points of the text, its end exclusive. Benchmark rows
    without an id or text, or shorter than ``SHORTEST`` normalised characters, are left out;
    repeated ones give repeated entries. Null and empty texts have no entries. An input column
    named ``leaks`` is replaced; rows and other columns stay as they are. A benchmark of more than
    ``index_bytes`` is searched in several passes, each with an index of about that size; a pass
    writes what it found to the shared folder before the next index is built.
    """
    usable = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")).filter(
        "item is not null and text is not null")
    total = usable.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    passes = max(1, -(-total // index_bytes))
    kept = [F.col(quoted(c)) for c in df.columns if c.lower() != "leaks"]
    if passes == 1:
        leaks = _searcher(Index.build([tuple(r) for r in usable.collect()]))(text_or_empty(text))
        return df.select(*kept, F.array_sort(leaks).alias("leaks"))
    # each pass writes what it found before the next one's index is built
    row, row_found, all_found = fresh(df, "row"), fresh(df, "row_found"), fresh(df, "found")
    rows = settle(df.withColumn(row, F.monotonically_increasing_id()), "documents")
    usable = settle(usable.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(passes))), "benchmark")
    found = []
    for k in range(passes):
        part = usable.filter(F.col("pass") == k).select("item", "text").collect()
        leaks = _searcher(Index.build([tuple(r) for r in part]))(text_or_empty(text))
        found.append(settle(rows.select(row, leaks.alias("leaks")).filter(F.size("leaks") > 0), "leaks"))
        del part, leaks
    every = reduce(DataFrame.unionByName, found).groupBy(row).agg(F.flatten(F.collect_list("leaks")).alias(all_found))
    every = every.withColumnRenamed(row, row_found)
    none = F.array().cast(every.schema[all_found].dataType)
    joined = rows.select(*kept, F.col(row)).join(every, F.col(row) == F.col(row_found), "left")
    return joined.select(*kept, F.array_sort(F.coalesce(F.col(all_found), none)).alias("leaks"))


def _searcher(index: Index):
    kind = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])

    @F.arrow_udf("array<struct<item_id: long, start: long, end: long, edits: long>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[dict(zip(("item_id", "start", "end", "edits"), (index.items[m[0]], *m[1:])))
                             for m in index.matches(t.as_py())] for t in batch], pa.list_(kind))

    return found

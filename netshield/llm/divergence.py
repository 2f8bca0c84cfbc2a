"""How far the sources of each language diverge in their words.

Every (language, source) group and every language gives each frequent term of the language a smoothed
share in integer parts of ``SCALE``. The distance of two groups is the sum of the differences of their
shares over all terms, most of which one of them doesn't use. So a pair starts from the difference of
the shares of absent terms; each group's used terms correct it as if the other lacked them (prefix
sums over distinct shares); and what both use is corrected once more by a frequent-pattern tree.

A term's row for the tree is the path of the groups that use it, in the order of the groups' sizes,
with their shares; equal rows count with their multiplicity. The tree is never stored: with the rows
dealt and sorted by path, a task holds only the path to the current node, and the rows below a node
are consecutive. Rows are dealt by the start of their paths, and sorted in full. A node that is left corrects its pairs with all its ancestors at once, times its
multiplicity. A node in two tasks is two nodes, whose corrections the final sums put together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.llm.common import text_or_empty
from netshield.session import settle

#: Parts that shares are counted in, and what is added to each count.
SCALE = 1_000_000_000
SMOOTHING = 5
#: Documents of a language that hold a term, at least, and terms listed for a group.
LEAST_DOCUMENTS = 30
TOP_TERMS = 50

#: Terms that a task counts before it hands them on, and bytes of a text that it splits at a time.
HELD_TERMS = 300_000
_BLOCK = 1 << 22
#: Corrections that a task holds before it sums up equal pairs.
_HELD_PAIRS = 1 << 20
_TERM_BYTES = frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_TO_TERMS = bytes(b if b in _TERM_BYTES else 0x20 for b in range(256)).lower()


def _term_blocks(text: str) -> Iterator[list[bytes]]:
    data = text.encode().translate(_TO_TERMS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                held_terms: int = HELD_TERMS) -> DataFrame:
    """Partial counts ``(lang, source, term, n, documents)``, combined in the task that reads the texts.

    A task hands its counts on when it holds more than ``held_terms`` of them. A row with a null term and zero counts stands for each group, so that groups without terms show.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("n", pa.int64()), ("documents", pa.int64())])

    def handed_on(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in groups.items():
            terms = list(occurrences)
            columns = [[None, *(t.decode() for t in terms)], [0, *(occurrences[t] for t in terms)],
                       [0, *(documents[t] for t in terms)]]
            size = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([value] * size, pa.string()) for value in (lang, source)]
                + [pa.array(column, kind) for column, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()))], schema=schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            texts = batch.column(2)
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                occurrences, documents = groups.setdefault(key, (Counter(), Counter()))
                before, seen = len(occurrences), set()
                for terms in _term_blocks(texts[k].as_py()):
                    occurrences.update(terms)
                    seen.update(terms)
                documents.update(seen)
                held += len(occurrences) - before
                if held > held_terms:
                    yield from handed_on(groups)
                    groups, held = {}, 0
        yield from handed_on(groups)

    read = df.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).alias("text"))
    return read.mapInArrow(counted, "lang string, source string, term string, n bigint, documents bigint")


def vocabulary(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Kept terms ``(lang, term, n, cells)`` with one cell ``(source, n)`` for each group that uses them.

    The row of the null term has a cell for each group of its language. Counts are summed by group
    first, so that a row gathers no more cells than its language has sources.
    """
    by_group = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by_term = by_group.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return by_term.where(F.col("term").isNull() | (F.col("documents") >= least)).select("lang", "term", "n", "cells")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms))``, exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = wide(count + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)")
    below = wide(total + SMOOTHING * terms)
    return F.lit(1).cast("bigint") + F.call_function("div", above, below)


def _groups(kept: DataFrame) -> DataFrame:
    """Each group with its ``total`` count, number of ``terms`` in its language, ``zero`` share and ``place``."""
    used = kept.where("term IS NOT NULL")
    totals = used.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = used.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    all_groups = kept.where("term IS NULL").select("lang", F.inline("cells")).drop("n")
    by_size = Window.partitionBy("lang").orderBy(F.desc("total"), "source")
    found = all_groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))).otherwise(F.lit(0))
    return found.withColumns({"zero": zero, "place": F.row_number().over(by_size)})


def _cells(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each use of a term by a group, with the group's share ``p`` and the language's share ``q``."""
    used = kept.where("term IS NOT NULL").select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells"))
    joined = used.join(groups, ["lang", "source"])
    return joined.select(
        "lang", "source", "place", "term", "zero", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two paths (columns are nodes)."""
    size = min(a.shape[1], b.shape[1])
    differ = np.flatnonzero((a[:, :size] != b[:, :size]).any(axis=0))
    return int(differ[0]) if len(differ) else size


def node_corrections(path: np.ndarray, counts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and corrections of the pairs of each node from ``first`` on with its ancestors.

    ``path`` has the rows place, share and zero share; ``counts`` are the nodes' multiplicities.
    """
    places, p, zero = path
    node, above = np.nonzero(np.arange(path.shape[1])[None, :] < np.arange(first, path.shape[1])[:, None])
    node += first
    found = (abs(p[node] - p[above]) - abs(p[above] - zero[node]) - abs(p[node] - zero[above])
             + abs(zero[node] - zero[above]))
    return places[above], places[node], found * counts[node]


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, value = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[starts], b[starts], np.add.reduceat(value, starts)


def walk(rows: Iterator[tuple[str, np.ndarray, int]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Corrections of the tree whose sorted rows ``(lang, path, multiplicity)`` are given."""
    lang, path, counts = None, np.empty((3, 0), np.int64), np.empty(0, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for new_lang, new_path, times in rows:
        common = _common(path, new_path) if new_lang == lang else 0
        if common < path.shape[1]:
            parts.append(node_corrections(path, counts, common))
            held += len(parts[-1][0])
        if parts and (new_lang != lang or held > _HELD_PAIRS):
            parts = [_summed(parts)] if held else []
            held = len(parts[0][0]) if parts else 0
            if parts and (new_lang != lang or held > _HELD_PAIRS // 2):
                yield lang, *parts[0]
                parts, held = [], 0
        counts = np.concatenate([counts[:common], np.zeros(new_path.shape[1] - common, np.int64)]) + times
        lang, path = new_lang, new_path
    if path.shape[1]:
        parts.append(node_corrections(path, counts, 0))
    if sum(len(part[0]) for part in parts):
        yield lang, *_summed(parts)


def tree_corrections(cells: DataFrame) -> DataFrame:
    """``(lang, a, b, value)``: what pairs of groups (by place) gain where both use a term."""
    node = F.struct("place", "p", "zero")
    rows = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(node)).alias("path"))
    counted = settle(rows.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")), "paths")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[str, np.ndarray, int]]:
            for batch in batches:
                paths = batch.column(1)
                nodes, bounds = paths.flatten(), np.append(0, np.cumsum(paths.value_lengths().to_numpy()))
                values = np.stack([nodes.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
                for k, (lang, times) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                    yield lang, values[:, bounds[k]:bounds[k + 1]], times

        for lang, a, b, value in walk(read()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())],
                ["lang", "a", "b", "value"])

    # the start of a path keeps neighbours of the tree together, its hash splits starts that many share
    dealt = counted.repartitionByRange("lang", F.slice("path", 1, 3), F.xxhash64("path"))
    sorted_rows = dealt.sortWithinPartitions("lang", "path")
    found = sorted_rows.mapInArrow(walked, "lang string, a int, b int, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def one_sided(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, value)``: the terms of ``a`` against the zero share of ``b``, summed up.

    ``|p - z|`` is ``p - z`` plus twice what ``p`` lacks to ``z``; the latter needs the number and sum of
    the shares of ``a`` below ``z``, running sums over its distinct shares and the zero shares of
    all other groups.
    """
    shares = cells.groupBy("lang", F.col("place").alias("a"), F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("times"))
    other = groups.select("lang", F.col("place").alias("b"), F.col("zero").alias("at"))
    limits = groups.select("lang", F.col("place").alias("a")).join(other, "lang").where("a <> b")
    points = shares.select("lang", "a", F.lit(None).cast("int").alias("b"), "at", "times").unionByName(
        limits.withColumn("times", F.lit(0).cast("bigint")))
    whole = Window.partitionBy("lang", "a")
    upto = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    sums = points.withColumns({
        "used": F.sum("times").over(whole), "shares": F.sum(F.col("times") * F.col("at")).over(whole),
        "below": F.sum("times").over(upto), "below_shares": F.sum(F.col("times") * F.col("at")).over(upto)})
    value = F.col("shares") - F.col("at") * F.col("used") + 2 * (F.col("at") * F.col("below") - F.col("below_shares"))
    return sums.where("b IS NOT NULL").select("lang", "a", "b", "used", value.alias("value"))


def pair_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two groups of a language, in both directions."""
    side = lambda name, other: groups.select(
        "lang", F.col("place").alias(name), F.col("source").alias(f"source_{name}"), F.col("zero").alias(f"zero_{name}"), *other)
    apart = F.abs(F.col("zero_a") - F.col("zero_b"))
    pairs = side("a", ["terms"]).join(side("b", []), "lang").where("a < b")
    absent = pairs.select("lang", "a", "b", (apart * F.col("terms")).alias("value"))
    known = one_sided(cells, groups).join(groups.select("lang", F.col("place").alias("a"), F.col("zero").alias("zero_a")), ["lang", "a"]).join(
        groups.select("lang", F.col("place").alias("b"), F.col("zero").alias("zero_b")), ["lang", "b"])
    used = known.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                        (F.col("value") - F.col("used") * apart).alias("value"))
    every = absent.unionByName(used).unionByName(tree_corrections(cells))
    summed = every.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda at: groups.select("lang", F.col("place").alias(at), F.col("source").alias(f"source_{at}"))
    named = summed.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"])
    both = F.array(*[F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")])
    return named.select("lang", "value", F.inline(both)).select("lang", "source", "item", "value")


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS,
          top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group of documents.

    Part ``pair`` ranks the other sources of the language by their distance, part ``term`` the ``top``
    terms that a group uses more than its language. Terms are runs of ASCII letters and characters
    beyond ASCII, lower-cased in A-Z only; a language keeps those that at least ``least`` of its documents
    hold. Null texts, languages and sources count as empty ones; a row is a document, so repeated
    rows count again. A language without kept terms has distances of zero, a group of its own none.
    Ties are ranked by item. An empty table gives no rows; other columns of the input don't matter.
    """
    kept = settle(vocabulary(term_counts(df, text, lang, source), least), "vocabulary")
    groups = settle(_groups(kept), "groups")
    cells = settle(_cells(kept, groups), "cells")
    terms = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(pair_distances(cells, groups), "pair").unionByName(_ranked(terms, "term").where(F.col("rank") <= top))

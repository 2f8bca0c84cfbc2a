"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set of word shingles is sketched into ``SKETCH`` coordinates. In round ``i`` every
shingle is hashed to one coordinate, with the round as the leading part of its value; after as
many rounds as there are coordinates, coordinate ``j`` takes the smallest hash of all shingles in
round ``SKETCH + j``. Every coordinate is therefore filled, and the share of equal coordinates is
concentrated about the Jaccard similarity like that of independent samples without replacement.
``ROWS`` coordinates make a band; pairs that agree in a band are candidates and are confirmed on
their full shingle sets. At similarity 0.8 a pair misses all 42 bands with probability 3e-6.

Groups of copies never become all pairs:

* Equal sets are one class, found by a digest that is counted map-side.
* In each band bucket, members meet a few of its classes, drawn by hash, only. Of those that a
  member meets in all its buckets, the nearest by bit sketch for each draw is compared with it, so
  a turn of draws compares at most ``DRAWS`` pairs a member, however large a group is.
* Classes linked so far share a label. Buckets that still hold several labels get new draws, each
  paired with members of other labels, while that leaves many pairs to look at.
* What then still holds several labels is compared whole. Buckets of at most ``SMALL`` members are
  joined with themselves, on members of different labels that pass a size and a bit-sketch test.
  Larger ones are dealt into blocks of bounded shingles and members; a task takes two blocks,
  counts all intersections as a matrix product, and returns at most one link a label. So every
  pair that shares a band is linked already or looked at, and no task or row count is quadratic
  in what it holds at once.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import fresh, quoted, text_or_empty
from netshield.llm.components import components
from netshield.session import settle

SKETCH, ROWS = 256, 6
BANDS = SKETCH // ROWS
_SHIFT = np.uint64(64 - (SKETCH.bit_length() - 1))
_LOW = np.uint64((1 << 50) - 1)
_GOLDEN, _MIX1, _MIX2 = (np.uint64(c) for c in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_ROUNDS = (np.arange(2 * SKETCH, dtype=np.uint64) + np.uint64(1)) * _GOLDEN
#: Classes drawn from a bucket at once, rounds of draws, and pairs a member for which rounds go on.
DRAWS, DRAW_ROUNDS, PAIRS_A_MEMBER = 4, 2, 2
#: Members of a bucket that may be joined with itself, and shingles and members of a larger one's block.
SMALL, BLOCK_SHINGLES, BLOCK_MEMBERS = 48, 200_000, 2048
#: Words whose hashes a Python worker remembers before it starts anew.
WORD_MEMORY = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, words: int, memory: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one whole text.

    A-Z are lower-cased; words end at space and at characters 9 to 13. With fewer words than a
    shingle has, the whole sequence is the only shingle; without words the set is empty.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))
    width = min(words, len(hashes))
    joined = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        joined = mix(joined * _GOLDEN + hashes[k:len(hashes) - width + 1 + k])
    return np.unique(joined)


def sketch(values: np.ndarray) -> np.ndarray:
    """The filled sketch of a nonempty set of 64-bit hashes."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    empty, start, n = SKETCH, 0, len(values)
    while empty and start < SKETCH:
        # enough rounds to fill what is empty, most likely; later rounds never displace earlier ones
        stop = min(SKETCH, start + max(1, int(SKETCH * np.log(2 * empty + 2) / n)))
        drawn = mix(values[None, :] + _ROUNDS[start:stop, None])
        value = (np.arange(start, stop, dtype=np.uint64)[:, None] << np.uint64(50)) | (drawn & _LOW)
        np.minimum.at(out, (drawn >> _SHIFT).astype(np.intp).ravel(), value.ravel())
        empty = int((out == np.iinfo(np.uint64).max).sum())
        start = stop
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        i = SKETCH + int(j)
        out[j] = (np.uint64(i) << np.uint64(50)) | (mix(values + _ROUNDS[i]).min() & _LOW)
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band."""
    rows = coordinates[:BANDS * ROWS].reshape(BANDS, ROWS)
    key = mix(np.arange(BANDS, dtype=np.uint64) + _GOLDEN)
    for k in range(ROWS):
        key = mix(key * _GOLDEN + rows[:, k])
    return key.view(np.int64)


def bits(coordinates: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, as four signed 64-bit values."""
    return np.packbits((mix(coordinates) & np.uint64(1)).astype(bool)).view(np.int64)


def sketched(df: DataFrame, words: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, mark, n_shingles, digest, bands, bits`` of every row; ``mark`` is a hash of the text.

    An empty set has nulls for the last three.
    """

    @F.arrow_udf("n_shingles long, digest binary, bands array<long>, bits array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _Words()
        for batch in batches:
            sizes, digests, keys, tests = [], [], [], []
            for value in batch:
                found = shingles(value.as_py(), words, memory)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), keys.append(None), tests.append(None)
                    continue
                coordinates = sketch(found)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(bands(coordinates))
                tests.append(bits(coordinates))
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(tests, pa.list_(pa.int64()))],
                names=["n_shingles", "digest", "bands", "bits"])

    whole = text_or_empty(text)
    return df.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(whole).alias("mark"),
                     made(whole).alias("s")).select("id", "mark", "s.*")


def _apart(a: str = "", b: str = "") -> F.Column:
    """In how many places the bit sketches differ."""
    return sum(F.bit_count(F.col(f"{a}bits")[k].bitwiseXOR(F.col(f"{b}bits")[k])) for k in range(4))


def _likely(share: int, a: str = "", b: str = "") -> F.Column:
    """Sizes allow ``share`` percent, and the bit sketches don't rule it out.

    Bits of equal coordinates agree, others agree half the time, so 256 bits of a pair at
    similarity s differ in 128 * (1 - s) places on average; six standard deviations above that
    are still let through.
    """
    mean = SKETCH * (100 - share) / 200
    most = int(mean + 6 * (mean * (1 - mean / SKETCH)) ** 0.5) + 1
    n = [F.col(f"{a}n"), F.col(f"{b}n")]
    return (F.least(*n) * 100 >= F.greatest(*n) * share) & (_apart(a, b) <= most)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, shingles``: the sorted hashes of each text's set, as bytes."""

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _Words()
        for batch in batches:
            yield pa.array([shingles(t.as_py(), words, memory).tobytes() for t in batch], pa.binary())

    return texts.select("node", packed("text").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Those pairs ``a, b`` whose full shingle sets reach ``share`` percent similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sets_a, sets_b in batches:
            out = []
            for s, t in zip(sets_a, sets_b):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())

    return pairs.join(left, "a").join(right, "b").filter(linked("set_a", "set_b")).select("a", "b")


def linked_in_blocks(nodes: np.ndarray, block: np.ndarray, sets: list[np.ndarray], share: int) -> list[tuple[int, int]]:
    """Pairs that connect the members as their links do; across the two blocks, or inside a single one."""
    size = np.array([len(x) for x in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, len(shared), 4096):
        part = slice(*np.searchsorted(column, [start, start + 4096]))
        table = np.zeros((len(sets), min(4096, len(shared) - start)), np.float32)
        table[owner[part], column[part] - start] = 1
        both += table[left] @ table[right].T
    linked = 100 * both >= share * (size[left][:, None] + size[right][None, :] - both)
    label = np.arange(len(sets))
    while True:
        before = label.copy()
        np.minimum.at(label, left, np.where(linked, label[right][None, :], len(sets)).min(1))
        np.minimum.at(label, right, np.where(linked, label[left][:, None], len(sets)).min(0))
        label = label[label]
        if (label == before).all():
            break
    return [(int(nodes[k]), int(nodes[label[k]])) for k in np.flatnonzero(label != np.arange(len(sets)))]


def _in_blocks(large: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links ``a, b`` between labels of the members of large buckets, from two blocks of a bucket at a time."""
    blocks = large.groupBy("key").agg(F.greatest(
        F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS)).alias("blocks"))
    dealt = (large.join(blocks, "key")
             .withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .select("node", "label", "key", "block", F.least("block", "other").alias("first"),
                     F.greatest("block", "other").alias("second"))
             .join(sets, "node"))

    def links(group: pa.Table) -> pa.Table:
        sets_of = [np.frombuffer(v.as_buffer(), np.uint64) for v in group["shingles"]]
        block = group["block"].to_numpy()
        if block.min() == block.max() and group["first"][0] != group["second"][0]:
            found = []  # one of the two blocks is empty
        else:
            found = linked_in_blocks(group["label"].to_numpy(), block, sets_of, share)
        found = {(a, b) for a, b in found if a != b}  # members of a label are linked already
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "first", "second").applyInArrow(links, "a long, b long")


def _unsettled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their labels, of the buckets that hold several labels."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = (labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
               .filter("low < high").select("key"))
    return labelled.join(several, "key")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _drawn(rest: DataFrame, share: int, turn: int) -> DataFrame:
    """Likely pairs of members with a few members of their buckets that have another label.

    Nodes are hashes, so the least one after flipping fixed bits is a draw. A member of many buckets
    meets about as many drawn ones; of each draw, only the nearest by bit sketch is paired with it.
    """
    seeds = [int(x) for x in mix(np.arange(DRAWS, dtype=np.uint64) + np.uint64(1 + turn * DRAWS)).view(np.int64)]
    drawn = rest.groupBy("key").agg(*[
        F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"d{k}") for k, x in enumerate(seeds)])
    drawn = drawn.select(
        "key", F.posexplode(F.array_distinct(F.array(*[f"d{k}" for k in range(DRAWS)]))).alias("draw", "node"))
    drawn = drawn.join(rest.select("node", "label", "n", "bits").dropDuplicates(["node"]), "node")
    met = rest.alias("l").join(
        drawn.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.label") != F.col("r.label"))
        & _likely(share, "l.", "r.")).select(
        F.col("l.node").alias("node"), "draw", F.col("r.node").alias("other"), _apart("l.", "r.").alias("apart"))
    # one number, as hash aggregation can't keep a struct: the distance, then the other's hash
    near = F.shiftleft(F.col("apart").cast("bigint"), 54).bitwiseOR(F.shiftrightunsigned("other", 10))
    nearest = met.groupBy("node", "draw").agg(F.min_by("other", near).alias("other"))
    return nearest.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _all_across(rest: DataFrame, share: int) -> DataFrame:
    """All likely pairs of members of a bucket that have different labels."""
    return _ordered(rest.alias("l").join(
        rest.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.label") < F.col("r.label"))
        & _likely(share, "l.", "r.")))


def near_duplicates(df: DataFrame, words: int = 5, share: int = 80, id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text_hash, n_shingles, component_id, kept``.

    Rows are linked when ``100 * |A and B| >= share * |A or B|`` for their sets of ``words``-word
    shingles. ``component_id`` is the smallest id that links reach, ``kept`` whether that is the
    row's own. Rows without words have an empty set, are linked with nothing and are kept. Rows
    with equal sets are one class, also when their ids are equal, so repeated rows stay rows and
    share a component; rows with equal ids and
    different sets are separate rows. A row without an id keeps a null ``component_id`` and is kept; it links
    nothing. Other columns of the input are ignored. An empty table gives an empty result.
    """
    rows = settle(sketched(df, words, id, text), "sketches")
    usable = rows.filter("id is not null and digest is not null")
    classes = usable.groupBy("digest").agg(F.min("id").alias("id"))
    reps = settle(
        usable.join(classes, ["digest", "id"])
        .select(F.xxhash64("digest").alias("node"), "id", "mark", F.col("n_shingles").alias("n"),
                "bands", "bits").dropDuplicates(["node"]), "classes")

    members = reps.select("node", F.explode("bands").alias("key"))
    shared = settle(members.join(members.groupBy("key").count().filter("count > 1").select("key"), "key")
                    .join(reps.select("node", "n", "bits"), "node"), "members")
    sets = settle(shingle_sets(
        df.select(F.col(id).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
        .withColumn("mark", F.xxhash64("text"))
        .join(reps.join(shared.select("node").distinct(), "node", "left_semi").select("id", "mark", "node"),
              ["id", "mark"])
        .select("node", "text").dropDuplicates(["node"]), words), "sets")

    rows_left, labels, tested = shared, None, None
    for turn in range(DRAW_ROUNDS + 1):
        rest = settle(_unsettled(rows_left, labels), "mixed")
        rows_left = rest.drop("label")
        of_label = rest.groupBy("key", "label").agg(F.count("*").cast("double").alias("m"))
        work, left = of_label.groupBy("key").agg(
            (F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("w"), F.sum("m").alias("m")).agg(
            F.coalesce(F.sum("w") / 2, F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0.0))).first()
        last = turn == DRAW_ROUNDS or work <= PAIRS_A_MEMBER * left
        if last:
            size = rest.groupBy("key").count()
            small = rest.join(size.filter(F.col("count") <= SMALL).select("key"), "key")
            large = rest.join(size.filter(F.col("count") > SMALL).select("key"), "key")
        pairs = _all_across(small, share) if last else _drawn(rest, share, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs, "candidates")
        links = settle(confirmed(pairs, sets, share), "links")
        if last:
            links = links.union(_in_blocks(large, sets, share).distinct())
        tested = pairs if tested is None else tested.union(pairs)
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = components(links)
        if last:
            break

    known = labels.join(reps.select("node", "id"), "node")
    named = known.join(known.groupBy("label").agg(F.min("id").alias("component")), "label")
    of_class = (classes.withColumn("node", F.xxhash64("digest"))
                .join(named.select("node", "component"), "node", "left")
                .select("digest", F.coalesce("component", "id").alias("component")))
    result = rows.select("id", "mark", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(F.col("id").alias("doc_id"), F.col("mark").alias("text_hash"), "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, words: int = 5, share: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of ``near_duplicates``: the one with the smallest id.

    All columns stay. Of rows with equal id and text one stays; rows without an id or words stay.
    """
    id_key, mark = fresh(df, "id_key"), fresh(df, "mark")
    kept = (near_duplicates(df, words, share, id, text).filter("kept and doc_id is not null")
            .select(F.col("doc_id").alias(id_key), F.col("text_hash").alias(mark)).distinct())
    marked = df.withColumns({id_key: F.col(quoted(id)).cast("bigint"), mark: F.xxhash64(text_or_empty(text))})
    named = marked.join(kept, [id_key, mark], "left_semi").dropDuplicates([id_key, mark])
    return named.unionByName(marked.filter(F.col(id_key).isNull())).drop(id_key, mark)

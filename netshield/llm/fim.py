"""Fill-in-middle texts by piece tables.

A document becomes a table of descriptors ``(buffer, start, length)`` over two immutable buffers: its
text and the sentinels. Two cuts split the text's descriptor in three; an arrangement permutes these
and the sentinels' descriptors. No text is copied until ``render`` joins the slices, and digests
stream them. ``restore`` finds the descriptors in a rendered text and applies the inverse permutation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import fresh, quoted, text_or_empty

# The sentinels, white space, and the order of the parts in each form.
SENTINELS = ("<P>", "<S>", "<M>")
SPACES = b" \t\n\v\f\r"
#: Positions in (prefix, middle, suffix, <P>, <S>, <M>), in the order of the output.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}

TEXT, SENTINEL = 0, 1
_SENTINEL_BUFFER = "".join(SENTINELS)
#: Characters that a digest encodes at a time.
_STRIDE = 1 << 20

Piece = tuple[int, int, int]


def cut(pieces: Sequence[Piece], at: int) -> list[Piece]:
    """Split the last descriptor of the text buffer at a character of it; either part may be empty."""
    *before, (buffer, start, length) = pieces
    return [*before, (buffer, start, at - start), (buffer, at, start + length - at)]


def permute(pieces: Sequence[Piece], order: Sequence[int]) -> list[Piece]:
    return [pieces[k] for k in order]


def inverse(order: Sequence[int]) -> list[int]:
    return sorted(range(len(order)), key=order.__getitem__)


def slices(buffers: Sequence[str], pieces: Sequence[Piece]) -> Iterator[str]:
    """The described text, in slices of bounded length."""
    for buffer, start, length in pieces:
        for at in range(start, start + length, _STRIDE):
            yield buffers[buffer][at:min(at + _STRIDE, start + length)]


def digest(buffers: Sequence[str], pieces: Sequence[Piece]) -> str:
    found = hashlib.sha256()
    for part in slices(buffers, pieces):
        found.update(part.encode())
    return found.hexdigest()


def _sentinel_pieces() -> list[Piece]:
    starts = [sum(map(len, SENTINELS[:k])) for k in range(len(SENTINELS))]
    return [(SENTINEL, start, len(mark)) for start, mark in zip(starts, SENTINELS)]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def unit_ends(data: bytes) -> np.ndarray:
    """Where units end, in bytes.

    A unit is a run of other characters with the white space before it; white space at the end of
    the text is one of its own.
    """
    space = _IS_SPACE[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data)) if data else ends


def plan(text: str, draws: Sequence[int], rate: int, spm: int) -> tuple[int, str, list[Piece]]:
    """Units, form and descriptors of one text; ``draws`` are four unsigned integers."""
    data = text.encode()
    ends = unit_ends(data)
    n, whole = len(ends), [(TEXT, 0, len(text))]
    if not text or any(mark in text for mark in SENTINELS) or draws[2] % 100 >= rate:
        return n, "plain", whole
    parts = whole
    for k in sorted(draw % (n + 1) for draw in draws[:2]):
        parts = cut(parts, len(data[:ends[k - 1]].decode()) if k else 0)
    form = "spm" if draws[3] % 100 < spm else "psm"
    return n, form, permute([*parts, *_sentinel_pieces()], ARRANGEMENTS[form])


def found_pieces(output: str, form: str) -> list[Piece]:
    """Descriptors over a rendered text that spell the text it was made of."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order = ARRANGEMENTS[form]
    pieces, at = [], 0
    for mark, after in zip(order[::2], order[2::2] + (None,)):
        size = len(SENTINELS[mark - 3])
        end = len(output) if after is None else output.index(SENTINELS[after - 3], at + size)
        pieces += [(TEXT, at, size), (TEXT, at + size, end - at - size)]
        at = end
    return permute(pieces, inverse(order))[:3]


_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def arrange(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50,
            spm: int = 80) -> DataFrame:
    """Add ``n``, ``form``, ``pieces``, ``prefix_chars``, ``middle_chars`` and ``output_sha256``.

    ``n`` is the number of units; ``form`` is ``plain`` (the text as it is), ``psm`` or ``spm``. Draws
    come from the digest of ``seed`` and ``key``: ``rate`` percent of the texts are rearranged, and
    ``spm`` percent of those start with the suffix. ``pieces`` describes the output over the text
    (buffer 0) and ``<P><S><M>`` (buffer 1). A null or empty text, and one that holds a sentinel, is
    plain; a plain row has null ``prefix_chars`` and ``middle_chars``. A null key draws as an empty
    one. Repeated keys draw alike; every row and all other columns stay, and input columns of the
    new names are replaced. A text is handled whole, whatever its length.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(hashed, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]

    @F.arrow_udf("struct<n:bigint,form:string,pieces:array<struct<buffer:int,start:bigint,length:bigint>>,"
                 "prefix_chars:bigint,middle_chars:bigint,output_sha256:string>")
    def planned(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *drawn in batches:
            rows = []
            for value, *four in zip(texts, *(d.to_pylist() for d in drawn)):
                value = value.as_py()
                n, form, pieces = plan(value, four, rate, spm)
                lengths = [None, None]
                if form != "plain":
                    parts = permute(pieces, inverse(ARRANGEMENTS[form]))
                    lengths = [parts[0][2], parts[1][2]]
                rows.append((n, form, pieces, *lengths, digest((value, _SENTINEL_BUFFER), pieces)))
            kinds = [pa.int64(), pa.string(), _PIECES, pa.int64(), pa.int64(), pa.string()]
            names = ["n", "form", "pieces", "prefix_chars", "middle_chars", "output_sha256"]
            columns = [pa.array([
                [dict(zip(("buffer", "start", "length"), p)) for p in row[k]] if k == 2 else row[k]
                for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, names)

    made = fresh(df, "arranged")
    fields = ("n", "form", "pieces", "prefix_chars", "middle_chars", "output_sha256")
    found = df.withColumn(made, planned(text_or_empty(text), *draws))
    return found.withColumns({f: F.col(made)[f] for f in fields}).drop(made)


def render(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``output``, the text that ``pieces`` describe; a null text is an empty one."""
    def slice_of(piece):
        source = F.when(piece["buffer"] == TEXT, text_or_empty(text)).otherwise(F.lit(_SENTINEL_BUFFER))
        return F.substring(source, (piece["start"] + 1).cast("int"), piece["length"].cast("int"))

    return df.withColumn("output", F.concat_ws("", F.transform("pieces", slice_of)))


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Add ``restored``, the exact text behind each rendered text.

    A null output restores to an empty text, a null form counts as ``plain``. An output that lacks
    the sentinels of its form is an error.
    """
    @F.arrow_udf("string")
    def restored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            texts = (value.as_py() for value in outputs)
            yield pa.array(["".join(slices((value,), found_pieces(value, kind)))
                            for value, kind in zip(texts, forms.to_pylist())], pa.string())

    kind = F.coalesce(F.col(quoted(form)), F.lit("plain"))
    return df.withColumn("restored", restored(text_or_empty(output), kind))

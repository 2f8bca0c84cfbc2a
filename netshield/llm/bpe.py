"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts stay whole. The library's pattern engine gives up on runs of about a million white space
characters, so texts longer than ``BLOCK`` are first cut where no match of the pattern can cross:
between a character that isn't white space and one that is. A block that is still too long (one
huge word or run of spaces) is cut into its single pattern matches, each encoded on its own.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StructField, StructType

from netshield.llm.common import quoted

#: Characters up to which a text goes to the library in one piece.
BLOCK = 100_000
#: Rows whose results leave a task at once.
SLICE_ROWS = 256


def public_files() -> tuple[str, str]:
    """Rank file and pre-splitting pattern of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def _encoding(rank_path: str, pattern: str):
    import tiktoken

    ranks = {}
    with open(rank_path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def blocks(text: str, limit: int = BLOCK) -> Iterator[str]:
    """Consecutive blocks of at most ``limit`` characters, or single units that are longer.

    A unit is a run of white space with the run of other characters after it.
    """
    import regex

    start = end = 0
    for unit in regex.finditer(r"\s*\S+|\s+", text):
        if unit.end() - start > limit and end > start:
            yield text[start:end]
            start = end
        end = unit.end()
    if end > start:
        yield text[start:end]


def encode_text(encoding, pattern: str, text: str, limit: int = BLOCK) -> np.ndarray:
    """Token ids of one whole text, as the library gives them without special tokens."""
    if len(text) <= limit:
        return encoding.encode_to_numpy(text, disallowed_special=())
    import regex

    parts = []
    for block in blocks(text, limit):
        if len(block) <= limit:
            parts.append(encoding.encode_to_numpy(block, disallowed_special=()))
        else:
            for match in regex.finditer(pattern, block):
                parts.append(np.asarray(encoding._encode_single_piece(match.group()), np.uint32))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _over(df: DataFrame, made: list[tuple[str, pa.DataType, DataType]], source: str, make) -> DataFrame:
    """``df`` with columns made of ``source`` in tasks; results leave in slices, so few are held.

    ``make`` gives a row's new values from the source's value. Columns of the same names go.
    """
    names = [name for name, *_ in made]
    df = df.select(*[F.col(quoted(c)) for c in df.columns if c == source or c.lower() not in names])
    schema = StructType([*(f for f in df.schema.fields if f.name.lower() not in names),
                         *(StructField(name, kind) for name, _, kind in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = make()
        for batch in batches:
            kept = [n for n in batch.schema.names if n.lower() not in names]
            values = batch.column(batch.schema.get_field_index(source))
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows = [ready(v.as_py()) for v in values.slice(start, SLICE_ROWS)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in kept),
                     *(pa.array([row[k] for row in rows], kind) for k, (_, kind, _) in enumerate(made))],
                    names=[*kept, *names])

    return df.mapInArrow(run, schema)


_TOKENS = [("tokens", pa.binary(), BinaryType()), ("n_tokens", pa.int64(), LongType())]
_DECODED = [("decoded", pa.binary(), BinaryType())]


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``tokens`` (binary: ids as little-endian unsigned 32-bit integers) and ``n_tokens``.

    One output row per input row, in any order; repeated rows and ids are encoded alike. A null or
    empty text has zero tokens and empty ``tokens``. Input columns named ``tokens`` or
    ``n_tokens`` are replaced; all other columns pass through.
    """
    def make():
        encoding = _encoding(rank_path, pattern)

        def row(value: str | None) -> tuple:
            ids = encode_text(encoding, pattern, value or "")
            return ids.astype("<u4").tobytes(), len(ids)

        return row

    return _over(df, _TOKENS, text, make)


def decode(df: DataFrame, rank_path: str, pattern: str, tokens: str = "tokens") -> DataFrame:
    """Add ``decoded`` (binary: the raw bytes that ``tokens`` stand for).

    Bytes need not be valid UTF-8, as ids may be cut anywhere. Null or empty ``tokens`` decode to
    empty bytes. An input column named ``decoded`` is replaced.
    """
    def make():
        encoding = _encoding(rank_path, pattern)
        return lambda value: (decode_tokens(encoding, value),)

    return _over(df, _DECODED, tokens, make)


def decode_tokens(encoding, tokens: bytes | None) -> bytes:
    return encoding.decode_bytes(np.frombuffer(tokens or b"", "<u4").tolist())


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` followed by ``decode`` of its tokens, in one pass of a task over its rows."""
    def make():
        encoding = _encoding(rank_path, pattern)

        def row(value: str | None) -> tuple:
            ids = encode_text(encoding, pattern, value or "")
            tokens = ids.astype("<u4").tobytes()
            return tokens, len(ids), decode_tokens(encoding, tokens)

        return row

    return _over(df, _TOKENS + _DECODED, text, make)


def digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded documents."""
    return df.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))

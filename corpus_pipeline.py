"""From raw documents to token ids: filter, deduplicate, decontaminate, redact and encode.

Each stage takes the documents that its predecessor kept and returns rows with the same columns;
the last returns tokens. Columns beyond ``doc_id``, ``text`` and ``n_chars`` pass through unchanged, whatever
their names; the last stage leaves them out but for ``lang`` and ``source``. A null or empty text is neither
toxic, a copy nor contaminated, and has no tokens. Rows without an id are scored and searched like others and never
count as copies; of repeated rows with equal id and text one stays. An empty table gives an empty result,
and without labels no document counts as toxic. ``run`` writes every stage's result to the shared folder and reads it
back, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netshield.llm import bpe, decontaminate, minhash, pii, toxicity
from netshield.llm.common import quoted, table
from netshield.session import settle


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` beside the whole row in one column, which no operator's results can replace."""
    return docs.select("doc_id", "text", F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole_row"))


def _unpacked(found: DataFrame) -> DataFrame:
    return found.select("whole_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels of held-out ids aren't used."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(_packed(docs), model).filter("score < 0.5"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 similarity of five-word shingles."""
    return _unpacked(minhash.keep_one(_packed(docs), words=5, share=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.search(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.filter(F.size("leaks") == 0))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data spans are replaced by their kinds; ``n_chars`` follows the text."""
    found = pii.find(_packed(docs))
    text = pii.redact(found)
    row = F.col("whole_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length(text).cast("bigint"), F.col("whole_row.n_chars")))
    return _unpacked(found.select(row.alias("whole_row")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document, with digests of them and of the bytes they decode to."""
    ranks, pattern = bpe.public_files()
    tokens = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    return tokens.select("doc_id", "lang", "source", "n_tokens", "tokens", F.sha2("tokens", 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("pii", redact_personal_data), ("bpe", encode)]

#: A trained network, sketches and alignments have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

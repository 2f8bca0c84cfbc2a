"""Preference pairs: the common prompt once, and masked completions, with DataFrame functions only.

Input rows are turns of the two sides of pairs. The prompt ends before the first turn number at
which the sides differ; that is a minimum over grouped counts, so no task sees a whole
conversation. The result has a row for each rendered turn, in parts: a part's text is its rows in
the order of ``turn`` and ``rendered``, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import quoted

# The turn template.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Roles whose turns a model learns to write.
TRAINED_ROLES = ("assistant",)
#: Turn number of rows without one.
NO_TURN = -(1 << 63)


def rendered(role: Column, text: Column) -> Column:
    """A turn as text; ``<|`` inside a role or text gets a space, so that it can't open or close turns."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), plain(role), F.lit(MIDDLE), plain(text), F.lit(END))


def format_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """``pair_id, part, turn, role, rendered, trained`` of every turn.

    ``side`` is ``chosen`` or ``rejected``; rows with another side are left out. The prompt is the
    longest run of turn numbers, from the smallest, at which both sides have the same roles and
    texts, repeated rows counted; it comes once, as part ``prompt``. Later turns come for each side
    as parts ``chosen`` and ``rejected``. ``trained`` masks what counts in training: assistant
    turns of completions. Sides that are equal are all prompt; a pair with one side has no prompt.
    A null role is ``user``, a null text empty; rows without a turn number come first, as turn
    ``NO_TURN``; rows without a pair id form one pair. Other columns are ignored.
    """
    rows = turns.select(
        F.col(quoted(pair)).alias("pair_id"), F.col(quoted(side)).alias("side"),
        F.coalesce(F.col(quoted(turn)).cast("bigint"), F.lit(NO_TURN)).alias("turn"),
        F.coalesce(F.col(quoted(role)).cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("side").isin("chosen", "rejected"))
    # digests keep long texts out of the shuffle
    apart = (rows.groupBy("pair_id", "turn", "role", F.sha2("text", 256).alias("digest"))
             .agg(F.sum(F.when(F.col("side") == "chosen", 1).otherwise(-1)).alias("excess"))
             .filter("excess <> 0").groupBy("pair_id").agg(F.min("turn").alias("first"))
             .select(F.col("pair_id").alias("of"), "first"))
    joined = rows.join(apart, rows["pair_id"].eqNullSafe(apart["of"]), "left")
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    part = F.when(shared, F.lit("prompt")).otherwise(F.col("side"))
    return joined.filter(~shared | (F.col("side") == "chosen")).select(
        "pair_id", part.alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"),
        (~shared & F.col("role").isin(*TRAINED_ROLES)).alias("trained"))


def halved_answers(conversations: DataFrame) -> DataFrame:
    """Both sides of a pair from each conversation: as it is, and ending in half of its last answer.

    The rejected side stops at the last assistant turn and keeps the first half of that turn's
    text, rounded down. A conversation without assistant turns is the same on both sides.
    """
    last = (conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
            .withColumnRenamed("conv_id", "of"))
    rows = conversations.join(last, conversations["conv_id"].eqNullSafe(last["of"]), "left")
    cut = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"),
                 F.left("text", F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = rows.filter("last is null or turn is null or turn <= last").select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", cut.alias("text"))
    return chosen.union(rejected)

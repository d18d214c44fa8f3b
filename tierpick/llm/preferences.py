"""Preference pairs of conversations: shared prompt, and two masked completions.

DataFrame functions only. Everything stays one row per turn, so a
conversation of any length is never gathered in one place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tierpick.session import stage

OPENING, MIDDLE, CLOSING = "<|", "|>\n", "\n"
LEARNED_ROLE = "assistant"
BLOCK = 1024  # turns whose offsets one task adds up

PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"


def rendered(role: Column, text: Column) -> Column:
    """A turn as ``<|role|>``, a line break, its text and a line break."""
    return F.concat(F.lit(OPENING), F.coalesce(role, F.lit("")), F.lit(MIDDLE),
                    F.coalesce(text, F.lit("")), F.lit(CLOSING))


def _offsets(turns: DataFrame) -> DataFrame:
    """Adds ``start``: the rendered length of the turns before in the same part.

    Added up in blocks of turns, and over the blocks, so no long part is a
    single task's.
    """
    block = turns.withColumn("_block", F.floor(F.col("place") / BLOCK))
    keys = ["pair_id", "part"]
    sums = block.groupBy(*keys, "_block").agg(F.sum("_length").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0))
                       .alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    return block.withColumn(
        "_inside", F.coalesce(F.sum("_length").over(inside), F.lit(0))
    ).join(sums, [*keys, "_block"]).withColumn("start", F.col("_base") + F.col("_inside"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From turns (pair_id, place, role, text) of both sides the rows of prompt and completions.

    Per turn: pair_id, part, place, role, rendered, start, learn_start,
    learn_end. The prompt is the longest prefix of equal turns (role and text)
    and comes once. The places go on in ``chosen`` and ``rejected``; ``start``
    counts code points within the part. A loss may be taken between
    ``learn_start`` and ``learn_end``: the text and closing break of assistant
    turns of the completions; elsewhere both are null.

    Places number the turns of a side from 0 without gaps or repeats. Null
    roles and texts are equal to nulls only and are rendered as empty. A side
    that is a prefix of the other has no completion; a pair with one side only
    has no prompt. No rows give no rows.
    """
    c, r = (side.select("pair_id", "place", F.struct("role", "text").alias(name))
            for side, name in ((chosen, "_c"), (rejected, "_r")))
    both = stage(c.join(r, ["pair_id", "place"], "full"), "sides")  # read for the split, and cut
    same = F.col("_c").isNotNull() & F.col("_r").isNotNull() & F.col("_c").eqNullSafe(F.col("_r"))
    parted = both.groupBy("pair_id").agg(
        F.min(F.when(~same, F.col("place"))).alias("_split"))
    both = both.join(parted, "pair_id")
    shared = F.col("_split").isNull() | (F.col("place") < F.col("_split"))
    parts = F.when(shared, F.array(F.struct(F.lit(PROMPT).alias("part"), F.col("_c").alias("turn")))
                   ).otherwise(F.array(
                       F.struct(F.lit(CHOSEN).alias("part"), F.col("_c").alias("turn")),
                       F.struct(F.lit(REJECTED).alias("part"), F.col("_r").alias("turn"))))
    turns = both.select("pair_id", "place", F.inline(parts)).where(
        F.col("turn").isNotNull()).select(
        "pair_id", "part", "place", F.col("turn.role").alias("role"),
        rendered(F.col("turn.role"), F.col("turn.text")).alias("rendered"))
    turns = turns.withColumn("_length", F.char_length("rendered").cast("long"))
    turns = _offsets(stage(turns, "rendered"))  # read for the sums, and added up
    learned = (F.col("part") != PROMPT) & F.col("role").eqNullSafe(F.lit(LEARNED_ROLE))
    head = F.char_length("role") + len(OPENING) + len(MIDDLE)
    return turns.select(
        "pair_id", "part", "place", "role", "rendered", "start",
        F.when(learned, F.col("start") + head).alias("learn_start"),
        F.when(learned, F.col("start") + F.col("_length")).alias("learn_end"))


def pairs_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from (conv_id, turn, role, text), a pair per conversation.

    Chosen is the conversation as it is. Rejected is the same up to its last
    assistant turn, where the assistant repeats an earlier answer of its own
    (the one before) or, without one, the turn that it should have answered.
    Turns after that are the chosen side's alone. A conversation without an
    assistant turn, or with nothing before it, has the chosen side only.

    Turns are numbered anew in their order; repeated rows each count.
    """
    rows = conversations.select(
        F.col("conv_id").alias("pair_id"), "turn", "role", "text",
        F.xxhash64("role", "text").alias("_hash"))
    # Turns that share a number: in order of role and text.
    grouped = rows.groupBy("pair_id", "turn", "role", "text").count()
    rows = grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    rows = stage(_numbered(rows), "numbered-turns")  # read five times below
    learned = F.col("role").eqNullSafe(F.lit(LEARNED_ROLE))
    last = rows.where(learned).groupBy("pair_id").agg(F.max("place").alias("_last"))
    joined = rows.join(last, "pair_id")
    earlier = joined.where(F.col("place") < F.col("_last")).groupBy("pair_id").agg(
        F.max(F.when(learned, F.col("place"))).alias("_answer"),
        F.max("place").alias("_before"))
    source = earlier.select("pair_id", F.coalesce("_answer", "_before").alias("place"))
    text = rows.join(source, ["pair_id", "place"], "left_semi").select(
        "pair_id", F.struct("text").alias("_other"))
    rejected = joined.join(text, "pair_id").where(F.col("place") <= F.col("_last")).select(
        "pair_id", "place", "role",
        F.when(F.col("place") == F.col("_last"), F.col("_other.text"))
        .otherwise(F.col("text")).alias("text"))
    return rows.select("pair_id", "place", "role", "text"), rejected


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``place``: the turn's number from 0 within its conversation.

    Rows are sorted by range and written with their place in their range, and
    the rows of a conversation in the ranges before are added, so a long
    conversation is many tasks' work.
    """
    order = ["pair_id", "turn", "role", "text", "_copy"]
    ranged = rows.repartitionByRange("pair_id", "turn").sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    firsts = placed.groupBy("pair_id", "_range").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("pair_id").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = firsts.select("pair_id", "_range", "_first", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    return placed.join(firsts, ["pair_id", "_range"]).select(
        "pair_id", (F.col("_at") - F.col("_first") + F.col("_earlier")).alias("place"),
        "role", "text")


def formatted(conversations: DataFrame) -> DataFrame:
    """Preference rows of all conversations, see ``pairs_of`` and ``format_pairs``.

    Null conv_ids make no pairs. Further columns are ignored.
    """
    chosen, rejected = pairs_of(conversations.where(F.col("conv_id").isNotNull()))
    return format_pairs(chosen, rejected)

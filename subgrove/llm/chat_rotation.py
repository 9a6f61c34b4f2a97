"""Training views of multi-party dialogues, one for each participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"


def _head(system: tuple[str, ...], mine: Column) -> Column:
    """How a turn begins."""
    who = F.when(F.col("speaker").isin(*system), F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def perspective_rotation(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = ("system",), turns_per_chunk: int | None = None) -> DataFrame:
    """Renders each whole dialogue once per participant: that speaker as assistant, the others as named users.

    A turn becomes "<|turn|>assistant\\n{text}<|end|>\\n", or "user name={speaker}" or "system" in the place of
    "assistant". Speakers named in system take no part and keep their role; a dialogue of such turns only has no
    views. One row per dialogue and participant: conv_id, perspective, chunk (0), n_turns, rendered, and spans, the
    places in rendered (in characters, end exclusive) of what the assistant says, its end mark included, which is
    what a loss mask keeps. Turns are in order of turn, speaker and text, nulls first, so ties and repeated rows have
    a place. Null speakers are "unknown", null texts empty, null turns come first. A row of null conv_id is
    a dialogue of its own, so that such rows never meet in one task. Very long texts and dialogues are rendered
    whole. An empty table gives no rows. Built-in functions only; other columns are not read.

    turns_per_chunk, if given, cuts dialogues by turn number into rows of their own (chunk: turn // turns_per_chunk,
    -1 for null turns), for speakers so talkative that a rendered dialogue is too long for one value.
    """
    number = F.coalesce(F.col(turn).cast("long"), F.lit(-1))
    chunk = F.lit(0) if turns_per_chunk is None else F.when(number < 0, F.lit(-1)).otherwise(F.floor(number / turns_per_chunk))
    named = turns.select(
        F.col(conv).alias("conv_id"), number.alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), chunk.cast("long").alias("chunk"),
    )
    body = F.concat(F.col("text"), F.lit(CLOSE)).alias("body")
    whole = named.where("conv_id IS NOT NULL")
    parties = whole.where(~F.col("speaker").isin(*system)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    mine = F.col("speaker") == F.col("perspective")
    views = whole.join(parties, "conv_id").select("conv_id", "perspective", "chunk", "turn", "speaker", "text", mine.alias("mine"), _head(system, mine).alias("head"), body)
    before = W.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "speaker", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = views.withColumn("end", F.sum(F.length("head") + F.length("body")).over(before)).withColumn("place", F.row_number().over(before))
    one = F.struct("place", F.concat("head", "body").alias("said"), F.when(F.col("mine"), F.struct((F.col("end") - F.length("body")).alias("start"), (F.col("end") - 1).alias("end"))).alias("span"))
    rows = placed.groupBy("conv_id", "perspective", "chunk").agg(F.array_sort(F.collect_list(one)).alias("all"))
    dialogues = rows.select(
        "conv_id", "perspective", "chunk", F.size("all").cast("long").alias("n_turns"), F.concat_ws("", F.col("all.said")).alias("rendered"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("spans"),
    )
    alone = named.where(F.col("conv_id").isNull() & ~F.col("speaker").isin(*system)).select("conv_id", F.col("speaker").alias("perspective"), "chunk", _head(system, F.lit(True)).alias("head"), body)
    begin, end = F.length("head").cast("long").alias("start"), (F.length("head") + F.length("body") - 1).cast("long").alias("end")
    alone = alone.select("conv_id", "perspective", "chunk", F.lit(1).cast("long").alias("n_turns"), F.concat("head", "body").alias("rendered"), F.array(F.struct(begin, end)).alias("spans"))
    return dialogues.unionByName(alone)

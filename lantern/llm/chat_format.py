"""Chat formatting by rotating perspectives.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as users with
their names; the mask is set on what the assistant says, its end mark included. System turns are context: shown to all, never
learnt, and not a perspective.

``rotate`` gives a row for each turn and perspective with its piece of the rendered text and the piece's place, so a dialogue of any
length spreads over tasks; ``render`` joins the pieces to whole texts and mask spans where dialogues fit in a row. Places come from
two levels of sums, inside blocks of ``BLOCK`` turns and over the blocks.

No text or name can end a turn or begin another: in both a backslash is put into each ``<|`` and ``|>`` (and one more where there
is one or more already), so ``unescape`` gives back what was written.

Turns are in the order of (turn, speaker, text), nulls first; repeated turns stay. A null text is an empty turn, a null speaker is
the participant named ``NOBODY``, and null conv_ids form one conversation. A conversation of system turns only gives nothing.
Columns but the four that are named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

NOBODY, SYSTEM, BLOCK = "unknown", "system", 1024


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\|(\\*)\\>", r"|$1>"), r"<(\\*)\\\|", r"<$1|")


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, piece, start, end (code points), body_start (where the mask starts), masked."""
    t = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit(NOBODY)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    people = t.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    r = t.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), escape(F.col("speaker")), F.lit("|>\n")))
    r = r.withColumn("head", F.length(head)).withColumn("piece", F.concat(head, escape(F.col("text")), F.lit("<|end|>\n"))).withColumn("masked", mine)
    r = r.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)).withColumn("n", F.length("piece").cast("long")).drop("text")
    key = ["conv_id", "perspective", "block"]
    sums = r.groupBy(*key).agg(F.sum("n").alias("total"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "speaker", "piece").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("upto", F.sum("n").over(inside))
    r = r.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    end = F.col("before") + F.col("upto")
    return r.select("conv_id", "perspective", "turn", "speaker", "piece", (end - F.col("n")).alias("start"), end.alias("end"), (end - F.col("n") + F.col("head")).alias("body_start"), "masked")


def render(pieces: DataFrame) -> DataFrame:
    """conv_id, perspective, rendered, mask (spans to learn) of dialogues that fit in a row each."""
    rows = pieces.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("start", "end", "body_start", "masked", "piece"))).alias("all"))
    mask = F.transform(F.filter("all", lambda x: x["masked"]), lambda x: F.struct(x["body_start"].alias("start"), x["end"].alias("end")))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("rendered"), mask.alias("mask"))

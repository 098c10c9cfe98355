"""Preference formatting of paired conversations, in DataFrame functions only.

A pair is two conversations, one chosen and one rejected. Turns are compared in order by role and text; the longest common
prefix of turns is rendered once, as the prompt, and what follows in each conversation is rendered as its completion. The
mask of a completion lists the characters a model is trained on, as start:end offsets in prompt + completion: content
and end marker of the assistant's turns after the prompt.

One shuffle brings the turns of a pair together; offsets are running sums inside it. Rows of a conversation end up in one
text, which is the result, so a conversation is as long as a value may be.

Defined results: turns are ordered by turn (null first), role and text, so repeated rows are repeated turns; null roles and
texts render as empty and equal only null; markers inside a text are broken up by a zero-width space; rows without a
conversation are no conversation's turns and are left out; a conversation without a partner is a pair whose other side is
empty; equal conversations leave two empty completions; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<|​im_"))


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """pair_id, n_common, n_chosen, n_rejected, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns: conv_id, turn, role, text; pair: the id of a conversation's pair; chosen: whether it is the chosen one.
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("is_chosen"), "turn", "role", "text").filter("pair_id IS NOT NULL AND is_chosen IS NOT NULL")
    before = F.concat(F.lit(START), _safe(F.col("role")), F.lit("\n"))
    body = F.concat(_safe(F.col("text")), F.lit(END))
    own = Window.partitionBy("pair_id", "is_chosen").orderBy("turn", "role", "text")
    # the offset of a turn's body; a running sum over rows, so repeated rows count one by one
    upto = F.sum(F.length(before) + F.length(body) + 1).over(own.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.repartition("pair_id").withColumn("at", F.row_number().over(own)).withColumn("until", upto.cast("long") - 1) \
        .withColumn("piece", F.concat(before, body, F.lit("\n"))).withColumn("size", F.length(body))
    turn = F.struct("at", "role", "text", "piece", "until", "size")
    both = placed.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("is_chosen"), turn))).alias("c"),
                                         F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), turn))).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, False)
    common = F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")
    known = both.withColumn("n", common)
    render = lambda x: F.array_join(F.transform(x, lambda t: t["piece"]), "")
    rest = lambda x: F.filter(x, lambda t: t["at"] > F.col("n"))
    mask = lambda x: F.array_join(F.transform(F.filter(rest(x), lambda t: t["role"] == TRAINED), lambda t: F.concat_ws(":", t["until"] - t["size"], t["until"])), ",")
    return known.select(
        "pair_id", F.col("n").cast("long").alias("n_common"), (F.size("c") - F.col("n")).cast("long").alias("n_chosen"), (F.size("r") - F.col("n")).cast("long").alias("n_rejected"),
        render(F.filter("c", lambda t: t["at"] <= F.col("n"))).alias("prompt"), render(rest(F.col("c"))).alias("chosen"), render(rest(F.col("r"))).alias("rejected"),
        mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) as pairs n."""
    return preference_pairs(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 0)

"""Preference formatting: one prompt, two completions, with masks for what is learned.

The turns of a chosen and a rejected conversation meet in one row per pair.  Their longest
common prefix of turns is rendered once as the prompt; what follows is rendered as the two
completions, and masks give the stretches of each that a model is trained on: the texts of
assistant turns with their end mark.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks around a turn.  Marks inside a role or text are broken up by a blank.
START, END = "<|im_start|>", "<|im_end|>"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"
_MASK = "array<struct<start:int,end:int>>"


def _plain(column: str) -> Column:
    """The column as text, null as empty, without the marks of a turn."""
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _turns(rows: DataFrame, pair_col: str, side: int) -> DataFrame:
    return rows.where(F.col(pair_col).isNotNull()).select(
        F.col(pair_col).alias("pair"), F.lit(side).alias("side"),
        F.struct(F.col("turn").cast("long").alias("turn"), _plain("role").alias("role"), _plain("text").alias("text")).alias("t"))


def _rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat('{START}', t.role, '\\n', t.text, '{END}\\n')), '')")


def _mask(turns: str) -> Column:
    """Stretches [start, end) of code points of the rendered turns that hold an assistant's text and end mark."""
    opens, shut = len(START) + 1, len(END)
    step = f"acc.at + {opens} + length(t.role) + length(t.text) + {shut} + 1"
    own = f"named_struct('start', acc.at + {opens} + length(t.role), 'end', acc.at + {opens} + length(t.role) + length(t.text) + {shut})"
    return F.expr(f"""aggregate({turns}, named_struct('at', 0, 'mask', cast(array() as {_MASK})), (acc, t) -> named_struct(
        'at', {step}, 'mask', if(t.role = 'assistant', concat(acc.mask, array({own})), acc.mask)), acc -> acc.mask)""")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """(pair_col, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, usable) for every pair.

    Both tables hold rows (pair_col, turn, role, text); further columns are ignored.  A
    conversation's turns are ordered by turn (null first), then role and text; repeated rows
    are one turn, a null role or text is an empty one, rows with a null pair are left out.
    A pair with turns on one side only has an empty prompt and one empty completion; equal
    conversations are all prompt with two empty completions.  usable tells whether both
    completions hold something to learn.  Empty tables give an empty result.  A row holds
    one pair's turns, as its result does: its size is that of the two conversations.
    """
    both = _turns(chosen, pair_col, 1).union(_turns(rejected, pair_col, 2))
    gather = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("t")))).cast(_TURNS)
    rows = both.groupBy("pair").agg(gather(1).alias("c"), gather(2).alias("r"))
    # the place of the first difference; a shorter conversation differs where it ends
    rows = rows.withColumn("n", F.expr("coalesce(nullif(array_position(zip_with(c, r, (x, y) -> x <=> y), false), 0) - 1, size(c))").cast("int"))
    rows = rows.withColumns({"p": F.expr("slice(c, 1, n)"), "c": F.expr("slice(c, n + 1, size(c))"), "r": F.expr("slice(r, n + 1, size(r))")})
    done = rows.select(F.col("pair").alias(pair_col), F.col("n").alias("n_prompt_turns"), _rendered("p").alias("prompt"), _rendered("c").alias("chosen"),
                       _rendered("r").alias("rejected"), _mask("c").alias("chosen_mask"), _mask("r").alias("rejected_mask"))
    return done.withColumn("usable", F.expr("size(chosen_mask) > 0 and size(rejected_mask) > 0"))


def with_neighbours_answers(turns: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Preference data from plain conversations: (chosen, rejected) turn tables keyed by pair_id.

    Chosen is every conversation up to its last assistant turn.  Rejected is the same
    conversation with that answer replaced by the last answer of its neighbour, the one
    whose id differs in the lowest bit; without a neighbour's answer it ends before.
    Conversations without an assistant turn are chosen whole and rejected empty.
    """
    own = turns.select(F.col(id_col).cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("pair_id is not null")
    last = (own.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("answer"))
            .select("pair_id", F.col("answer.turn").alias("last"), F.col("answer.text").alias("answer")))
    placed = own.join(last.select("pair_id", "last"), "pair_id", "left")
    chosen = placed.where("last is null or turn is null or turn <= last").drop("last")
    before = placed.where("last is not null and (turn is null or turn < last)").drop("last")
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "answer")
    swapped = last.select("pair_id", F.col("last").alias("turn")).join(other, "pair_id").select("pair_id", "turn", F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return chosen, before.union(swapped)

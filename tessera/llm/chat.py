"""Chat formatting of maximal conversations: cumulative snapshots collapse into the longest one.

Logs often hold a conversation once per turn, each snapshot a prefix of the next.
Rolling hashes over turn prefixes name every prefix; conversations whose whole
hash is a proper prefix of another one leave by an anti-join, equal ones
collapse to the least id, and what remains is rendered.  Only hashes are
shuffled for that; texts follow for the conversations that stay.

The rolling hash is the exclusive or of two 64-bit hashes of (position, role,
text), so a prefix takes one step from the last one and order matters.

Results for odd input: rows without a conversation id belong to no conversation
and are left out; rows repeated within a conversation (turn, role and text) count
once; turns with the same number stand by role, then by the text's MD5, nulls
first in all three; a very long text goes along as its hashes until its
conversation is known to stay, and one conversation is one task's; a null role
is ``unknown`` and a null text is empty, both distinct from the spelled ones in
comparison; columns other than the four are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace

#: Marks of the chat template: fixed values.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.col(role_col), F.col(text_col)
    own = [role.isNull(), role, text.isNull(), text]
    return rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(17), *reversed(own)).alias("h2"), F.md5(text.cast("binary")).alias("tie"), text.alias("text"))


def prefix_hashes(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, position, n_turns, p1, p2): the rolling hash of each conversation's first turns."""
    by = Window.partitionBy("conv").orderBy("turn", "role", "tie")
    turns = _turns(rows, conv_col, turn_col, role_col, text_col).drop("text")
    repeated = F.lag("turn").over(by).eqNullSafe(F.col("turn")) & F.lag("h1").over(by).eqNullSafe(F.col("h1")) & F.lag("h2").over(by).eqNullSafe(F.col("h2")) & (F.row_number().over(by) > 1)
    placed = turns.withColumn("repeated", repeated).where("not repeated").withColumn("position", F.row_number().over(by))
    running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv", "position", F.count("*").over(Window.partitionBy("conv")).alias("n_turns"),
        F.bit_xor(F.xxhash64("position", "h1")).over(running).alias("p1"), F.bit_xor(F.xxhash64("position", "h2")).over(running).alias("p2"),
    )


def maximal_conversations(rows: DataFrame, **columns: str) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that no longer one begins with; of equal ones the least id."""
    work = Workspace(rows.sparkSession, "chat")
    prefixes = work.save(prefix_hashes(rows, **columns), "prefixes")
    whole = prefixes.where("position = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    proper = prefixes.where("position < n_turns").select(F.col("position").cast("long").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv", "n_turns", "n_copies")


def render_maximal(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: its id, n_turns, n_copies and the rendered text."""
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    kept = maximal_conversations(rows, **columns)
    turns = _turns(rows, **columns).join(kept, "conv")
    said = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    gathered = turns.groupBy("conv").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_set(F.struct("turn", "role", "tie", "h1", "h2", said.alias("said")))).alias("all"))
    return gathered.select(F.col("conv").alias(conv_col), "n_turns", "n_copies", F.array_join(F.transform("all", lambda t: t["said"]), "").alias("rendered"))

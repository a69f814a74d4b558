"""Cumulative snapshots of chats: a logged conversation that is the beginning of a longer one goes, and of equal ones the
smallest conv_id stays; the rest are rendered. Built-in functions only.

A conversation's prefix is known by its length and the xor of hashes of (position, role, text), which rolls along its
turns. Conversations whose whole hash is a proper prefix of any other are dropped by an anti-join. Positions and hashes
are counted in blocks of turn numbers and summed over blocks, so that no task needs all turns of a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Turn numbers in a block that a window is over; turns in a rendered row.
BLOCK, SEGMENT = 4096, 4096


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn's conv_id, pos, n, role and text, x and y: pos counts from 1, n is the conversation's number of turns, x and
    y are the rolling hashes up to the turn. Turns stand in the order of turn, role and text."""
    own = lambda seed: F.xxhash64(F.lit(seed), F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long")
    order = ["turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), "a"]
    rows = turns.select("conv_id", block.alias("block"), "turn", "role", "text", own(1).alias("a"), own(2).alias("b"))
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = rows.withColumn("nth", F.row_number().over(inside))
    # How many turns stand before a block, and in all: a row for each block.
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", block.alias("block")).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n"))
    rows = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    rows = rows.withColumn("pos", F.col("start") + F.col("nth"))
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.select("conv_id", "block", "pos", "n", "role", "text", F.bit_xor(F.xxhash64("pos", "a")).over(upto).alias("x"), F.bit_xor(F.xxhash64("pos", "b")).over(upto).alias("y"))
    return rolled


def ordered(turns: DataFrame) -> DataFrame:
    """prefixes(), written, with hashes that go on over a conversation's blocks."""
    rows = cut(prefixes(turns), "turns")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "block").agg(F.max_by("x", "pos").alias("bx"), F.max_by("y", "pos").alias("by"))
    sums = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.coalesce(F.bit_xor("bx").over(before), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("by").over(before), F.lit(0)).alias("by"))
    out = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    return out.select("conv_id", "pos", "n", "role", "text", F.col("x").bitwiseXOR(F.col("bx")).alias("x"), F.col("y").bitwiseXOR(F.col("by")).alias("y"))


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations of ordered() that no longer one begins with; n_copies counts equal
    ones."""
    whole = rows.where("pos = n").groupBy("n", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = rows.where("pos < n").select(F.col("pos").alias("n"), "x", "y").distinct()
    return whole.join(inner, ["n", "x", "y"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """The maximal conversations' texts: conv_id, segment, n_turns, n_copies, text.

    Needs conv_id, turn, role and text; other columns are not read. Turns stand in the order of turn, and of role and text
    where it is equal; a null turn comes first, a null role or text is rendered as empty but differs from an empty one.
    A row holds 4096 turns at most, counted from the first whatever their numbers, so that a conversation of any length
    can be rendered; up to that length it is one row, of segment 0. A null conv_id is a conversation too, unless an equal
    one has an id. No rows: no rows.
    """
    rows = ordered(turns)
    kept = maximal(rows).withColumnRenamed("conv_id", "of")
    segment = F.floor((F.col("pos") - 1) / SEGMENT).cast("long")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>"))
    own = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", segment.alias("segment"), "n_turns", "n_copies", F.struct("pos", line.alias("line")).alias("t"))
    own = own.groupBy("conv_id", "segment", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return own.select("conv_id", "segment", "n_turns", "n_copies", F.array_join(F.transform("t", lambda t: t["line"]), "\n").alias("text"))

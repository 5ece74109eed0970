"""Chat formatting with collapse of cumulative snapshots.

Chat services often log a conversation anew at every turn, so shorter logs are prefixes of longer ones.
A rolling hash of turn prefixes identifies them: a conversation whose whole turn sequence is a prefix of
a longer conversation is dropped, of equal ones the least conv_id stays. What is left is rendered.
Everything is DataFrame operations.

Whole texts are shuffled once: counting, the join with what is kept and rendering all go by ``talk``, a
key that is never null, so they share one partitioning. Only hashes are shuffled besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turn(at: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at a place of its conversation; null and empty differ."""
    parts = [at, F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))]
    return [F.xxhash64(*parts), F.xxhash64(*parts, F.lit("second"))]


def numbered(turns: DataFrame) -> DataFrame:
    """Turns of each conversation counted from 1 in order of turn, role and text (nulls first), with prefix hashes.

    A row that repeats another in all of conv_id, turn, role and text counts once. Hashes of a prefix
    are running exclusive-or sums over place-dependent turn hashes, so one pass over sorted turns gives
    them all. ``turns`` is the conversation's number of turns, ``talk`` its id as text that is never null
    (conv_id, a number or a text, is read back from it, so that all uses of the rows are one shuffle).
    """
    talk = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    rows = turns.select(talk.alias("talk"), "turn", "role", "text")
    window = Window.partitionBy("talk").orderBy("turn", "role", "text")
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = [F.lag(c).over(window).eqNullSafe(F.col(c)) for c in ("turn", "role", "text")]
    fresh = ~((F.row_number().over(window) > 1) & before[0] & before[1] & before[2])
    counted = rows.withColumn("fresh", fresh).withColumn("at", F.count_if("fresh").over(running)).where("fresh")
    one, two = _turn(F.col("at"))
    hashed = counted.withColumn("one", F.bit_xor(one).over(running)).withColumn("two", F.bit_xor(two).over(running))
    conv_id = F.when(F.col("talk") != "-", F.substr("talk", F.lit(2))).cast(turns.schema["conv_id"].dataType)
    return hashed.withColumn("turns", F.max("at").over(Window.partitionBy("talk"))).withColumn("conv_id", conv_id).drop("fresh", "turn")


def maximal(prefixes: DataFrame) -> DataFrame:
    """Turns of the conversations that no other contains as a prefix; of equal ones those of the least conv_id.

    Prefix hashes are reduced by partial aggregates first, so a prefix that very many conversations
    share is one row in the join. A null conv_id is the least.
    """
    inner = prefixes.where("at < turns").select("at", "one", "two").distinct()
    whole = prefixes.where("at = turns").select("talk", "conv_id", "at", "one", "two")
    groups = whole.groupBy("at", "one", "two").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id", "talk")).alias("least"), F.count("*").alias("copies"))
    keep = groups.join(inner, ["at", "one", "two"], "left_anti").select("least.talk", "copies")
    return prefixes.join(keep, "talk")


def rendered(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, copies, chat): one text for each conversation, turns in order.

    A turn reads ``start role \\n text end \\n``; a null role is ``unknown``, a null text is empty.
    """
    piece = F.concat(F.lit(start), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end), F.lit("\n"))
    grouped = turns.groupBy("talk").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"), F.max("copies").alias("copies"))
    return grouped.select("conv_id", F.size("pieces").cast("long").alias("n_turns"), "copies", F.array_join("pieces.piece", "").alias("chat"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations of ``turns`` (conv_id, turn, role, text).

    Rows without conv_id form one conversation; other columns, whatever their names, are left out. An empty table gives no row. A conversation is rendered
    in one row, so its own length (not that of any group of conversations) bounds what a task holds.
    """
    return rendered(maximal(numbered(turns)))

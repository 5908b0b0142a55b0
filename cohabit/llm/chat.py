"""Chat formatting (operator 7): cumulative snapshots collapse to maximal conversations, which are rendered.

A logger that stores a conversation again after every turn leaves prefixes of longer
conversations.  Every turn gets the rolling hash of its conversation up to itself (128 bits: a running
exclusive-or of hashes of place, role and text, so it costs one window and no array).  A conversation whose last hash is
that of a *proper* prefix of another is removed by an anti-join; of equal ones the smallest id stays.
Only hashes take part in this; texts are gathered for the conversations that remain, and rendered with turn markers.

Both sides of the anti-join are distinct hashes, so a first turn that very many conversations
share, or very many copies of one, cost one row.  One rendered conversation is one row by nature.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role or text is
kept apart from an empty one for comparison and rendered as empty; repeated rows are repeated
turns; a turn with a null conversation id belongs to nothing and is a row of its own (null id, one turn, one copy),
compared with no other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Turn markers.
START, STOP = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) to (conv, n, last, h1, h2): rolling hash up to the n-th turn, and whether it is the last one."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = turns.select("*", F.row_number().over(order).cast("long").alias("n"), F.lead(F.lit(False), 1, True).over(order).alias("last"))
    content = [F.col("n"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    so_far = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.select("conv", "n", "last", *[F.xxhash64(F.lit(k), *content).alias(f"x{k}") for k in (1, 2)])
    return hashed.select("conv", "n", "last", *[F.bit_xor(f"x{k}").over(so_far).alias(f"h{k}") for k in (1, 2)])


def line(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(STOP + "\n"))


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies, rendered) for each maximal conversation."""
    plain = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    known = plain.where("conv is not null")
    prefixes = written(prefix_hashes(known), "prefixes")
    hashes = ["n", "h1", "h2"]
    ends = prefixes.where("last").groupBy(*hashes).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = prefixes.where("not last").select(*hashes).distinct()
    maximal = written(ends.join(inner, hashes, "left_anti").select("conv", F.col("n").alias("n_turns"), "n_copies"), "maximal-conversations", prefixes)
    spoken = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    whole = known.join(maximal, "conv").groupBy("conv", "n_turns", "n_copies").agg(spoken.alias("turns"))
    rendered = F.array_join(F.transform("turns", lambda t: line(t["role"], t["text"])), "")
    kept = whole.select(F.col("conv").alias(conv), "n_turns", "n_copies", rendered.alias("rendered"))
    lone = plain.where("conv is null").select(F.col("conv").alias(conv), F.lit(1).cast("long").alias("n_turns"), F.lit(1).cast("long").alias("n_copies"), line(F.col("role"), F.col("text")).alias("rendered"))
    return kept.unionByName(lone)


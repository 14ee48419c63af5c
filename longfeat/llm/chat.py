"""Chat logs: collapse of cumulative snapshots, then rendering. DataFrame functions only.

A log often holds the same conversation several times, each snapshot some turns longer. A conversation is dropped when
its turns are the first turns of a longer one, or equal those of one with a smaller id. Turns compare by number, role
and text; rows of one turn are compared together (as a bag), and a prefix ends between turns.

Every conversation gets a rolling hash of 128 bits after each of its turns: the XOR of its turns' hashes so far, in
which each turn's number and the number of equal rows take part. Running values are built in two steps (chunks of
``CHUNK`` turn numbers, then turns in a chunk), so a conversation of any length is spread over tasks. Anti-joins on the
hashes then retain the maximal conversations.

Defined results: rows without a conversation id belong to no conversation and are left out; a null turn comes first; a
null role or text differs from an empty one and is rendered as empty; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024
HASH = ["a", "b"]


def turn_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, n): a hash of each turn and its number of rows."""
    counted = rows.where("conv_id is not null").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    parts = [F.col(c).isNull() for c in ("turn", "role", "text")] + ["turn", "role", "text", "n"]
    hashed = counted.select("conv_id", "turn", "n", F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    return hashed.groupBy("conv_id", "turn").agg(*(F.bit_xor(c).alias(c) for c in HASH), F.sum("n").alias("n"))


def prefix_hashes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rolling (a, b, n) after each turn, and the last ones of each conversation."""
    chunked = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    folded = [*(F.bit_xor(c).alias(c) for c in HASH), F.sum("n").alias("n")]
    chunks = chunked.groupBy("conv_id", "chunk").agg(*folded)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sofar = chunks.select(
        "conv_id",
        "chunk",
        *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in HASH),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    within = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = chunked.select(
        "conv_id", "chunk", *(F.bit_xor(c).over(within).alias(c) for c in HASH), F.sum("n").over(within).alias("n")
    )
    rolled = running.join(sofar, ["conv_id", "chunk"]).select(
        "conv_id", *(F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in HASH), (F.col("n") + F.col("n0")).alias("n")
    )
    return rolled, chunks.groupBy("conv_id").agg(*folded)


def maximal(rows: DataFrame) -> DataFrame:
    """The ids of the conversations to retain."""
    rolled, whole = prefix_hashes(turn_hashes(rows))
    longer = rolled.join(whole.select("conv_id", F.col("n").alias("all_n")), "conv_id").where("n < all_n")
    proper = longer.select(*HASH, "n").distinct()
    first = whole.groupBy(*HASH, "n").agg(F.min("conv_id").alias("conv_id"))
    return first.join(proper, [*HASH, "n"], "left_anti").select("conv_id")


def collapse(rows: DataFrame) -> DataFrame:
    """The rows of the retained conversations, repeated rows included."""
    return rows.join(maximal(rows), "conv_id", "left_semi")


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered): one chat-format segment per row; a conversation is its segments in turn order.

    Segments stay rows, so that no conversation has to fit into one value; a writer sorts them by (conv_id, turn).
    """
    text = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    return rows.select("conv_id", "turn", "role", text.alias("rendered"))

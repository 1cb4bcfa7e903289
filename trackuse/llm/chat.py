"""Logged conversations without snapshots that a longer log repeats, rendered as chat text.

Logs are often cumulative: every request writes the whole conversation so far. A
conversation that is the beginning of another one goes. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackuse.sources.staging import stage

TURNS_PER_BLOCK = 256
LAST = 2**62  # stands for a missing turn number

# The markers around a turn.
START, END = "<|im_start|>", "<|im_end|>"

SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, {LAST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, '{START}' || role || chr(10) || text || '{END}' || chr(10) AS piece,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), prefixes AS (
  SELECT conv_id, pos, n, string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM placed
), whole AS (
  SELECT prefix AS rendered, n, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE pos = n GROUP BY ALL
)
SELECT conv_id, n AS n_turns, copies, rendered FROM whole
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n AND p.pos = whole.n AND p.prefix = whole.rendered)
"""


def _turns(conversations: DataFrame) -> DataFrame:
    return (
        conversations.where("conv_id is not null")
        .select(
            "conv_id",
            F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .distinct()
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies, rendered`` of the conversations that no longer one begins with.

    Turns are in the order of turn number (missing ones last), role, text. Of equal
    conversations the smallest id stays, ``copies`` says how many there were. A null role
    or text counts as empty, repeated rows count once, and turns without a conversation
    id are left out.
    """
    turns = _turns(conversations)
    # Places and hashes run inside blocks of turn numbers and then over the blocks, so
    # that a conversation with very many turns is not one task.
    block = F.floor(F.col("turn") / TURNS_PER_BLOCK)
    rows = turns.withColumn("block", block)
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inside))
    counts = turns.groupBy("conv_id", block.alias("block")).count()
    blocks = W.partitionBy("conv_id").orderBy("block")
    offsets = counts.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("count").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(W.partitionBy("conv_id")).alias("n"),
    )
    placed = rows.join(offsets, ["conv_id", "block"]).select(
        "conv_id", "block", "n", "role", "text", (F.col("before") + F.col("place")).alias("pos")
    )
    placed = stage(placed, "chat-turns")

    hashed = placed.select("conv_id", "block", "n", "pos", *[_turn_hash(s).alias(f"t{s}") for s in (1, 2)])
    own = hashed.groupBy("conv_id", "block").agg(*[F.bit_xor(f"t{s}").alias(f"b{s}") for s in (1, 2)])
    earlier = own.select(
        "conv_id",
        "block",
        *[
            F.coalesce(F.bit_xor(f"b{s}").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"b{s}")
            for s in (1, 2)
        ],
    )
    so_far = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "block", "n", "pos", *[F.bit_xor(f"t{s}").over(so_far).alias(f"r{s}") for s in (1, 2)])
    prefixes = rolled.join(earlier, ["conv_id", "block"]).select(
        "conv_id", "n", "pos", *[F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"h{s}") for s in (1, 2)]
    )
    prefixes = stage(prefixes, "chat-prefixes")
    whole = prefixes.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = prefixes.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    kept = whole.join(begun, ["n", "h1", "h2"], "left_anti").select("conv_id", "copies")
    return rendered(placed.join(kept, "conv_id"))


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "role", "text")


def rendered(placed: DataFrame) -> DataFrame:
    """One row per conversation, its turns between markers in the order of ``pos``."""
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return (
        placed.groupBy("conv_id", F.col("n").alias("n_turns"), "copies")
        .agg(F.array_join(F.transform(ordered, lambda t: t["piece"]), "").alias("rendered"))
        .select("conv_id", "n_turns", "copies", "rendered")
    )

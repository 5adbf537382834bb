"""Chat formatting: logged snapshots of growing conversations are collapsed before rendering.

Turns are hashed once (128 bits of role and text); from then on only hashes move.  A rolling hash
of each prefix of turns adds up a mixed hash of (place, turn) - two sums of 60 bits in wide
decimals, which a windowed sum rolls along.  A conversation whose full hash is the hash of a
proper prefix of another is a snapshot of it; of conversations that are equal throughout, the
smallest id stays.  Anti-joins on these hashes leave the maximal conversations.

Places come from counts by block of ``block`` turn numbers, so that a conversation of any length
is ranked and summed in pieces: windows run within blocks and over the blocks' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.llm.common import materialize


def _mixed(*parts: Column) -> list[Column]:
    """Two independent 60-bit hashes as decimals, so that sums cannot overflow."""
    text = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return [F.conv(F.substring(text, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(2)]


def numbered_turns(turns: DataFrame, block: int = 256) -> DataFrame:
    """conv_id, block, turn, role, digest, place (0, 1, ... within the conversation), h1, h2 (hash of the prefix up to here).

    Rows without a conversation are left out.  Rows that repeat conversation, turn, role and text
    count once.  Turns are ordered by number (null first), then role, then text hash.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col("role")), F.lit("null")), F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("null"))), 256)
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 40))).alias("block"), "turn", "role", digest.alias("digest")).distinct()
    rows = materialize(rows, "chat-turns")
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = W.partitionBy("conv_id", "block").orderBy("turn", "role", "digest")
    placed = rows.join(offsets, ["conv_id", "block"]).withColumn("place", F.col("offset") + F.row_number().over(own) - 1)
    a, b = _mixed(F.col("place").cast("string"), F.col("digest"))
    mixed = materialize(placed.withColumns({"m1": a, "m2": b}).drop("offset"), "chat-placed")
    sums = mixed.groupBy("conv_id", "block").agg(F.sum("m1").cast("decimal(38,0)").alias("s1"), F.sum("m2").cast("decimal(38,0)").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    carried = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{k}").over(before).cast("decimal(38,0)"), zero).alias(f"c{k}") for k in (1, 2)])
    rolling = own.rowsBetween(W.unboundedPreceding, 0)
    full = mixed.join(carried, ["conv_id", "block"])
    return full.select("conv_id", "block", "turn", "role", "digest", "place", *[(F.col(f"c{k}") + F.sum(f"m{k}").over(rolling)).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)])


def maximal(numbered: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other extends; of equal ones the smallest id."""
    key = ["n", "h1", "h2"]
    # what each prefix is, once: the smallest conversation that has it, and whether one goes on after it
    ends = numbered.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("e"))
    ends = ends.select("conv_id", (F.col("e.place") + 1).alias("n"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2"))
    first = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    lengths = ends.select("conv_id", F.col("n").alias("length"))
    prefixes = numbered.select("conv_id", (F.col("place") + 1).alias("n"), "h1", "h2").join(lengths, "conv_id")
    longer = prefixes.where("n < length").select(*key).distinct()
    return first.join(longer, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, part_turns: int = 64, block: int = 256, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """The maximal conversations in chat markup: conv_id, part (0, 1, ...), n_turns (of the part), total_turns, text.

    The texts of a conversation's parts, put together in order, are its rendering; a part holds at
    most ``part_turns`` turns, so no row is unbounded.  Markers inside a role or text are split by
    a zero-width space, so they cannot end a turn.  Null roles render as "unknown", null texts as
    empty.  An empty table gives an empty result.
    """
    numbered = materialize(numbered_turns(turns, block), "chat-numbered")
    kept = materialize(maximal(numbered), "chat-maximal")
    places = numbered.join(kept, "conv_id").select("conv_id", "turn", "role", "digest", "place", "n_turns")

    def safe(c: Column) -> Column:
        for mark in (start, end):
            c = F.replace(c, F.lit(mark), F.lit(mark[:1] + "​" + mark[1:]))
        return c

    digest = F.sha2(F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col("role")), F.lit("null")), F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("null"))), 256)
    body = F.concat(F.lit(start), safe(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), safe(F.coalesce("text", F.lit(""))), F.lit(end + "\n"))
    texts = turns.where("conv_id IS NOT NULL").select("conv_id", F.col("turn").alias("t"), digest.alias("digest"), body.alias("body"))
    same = (texts["conv_id"] == places["conv_id"]) & (texts["digest"] == places["digest"]) & texts["t"].eqNullSafe(places["turn"])
    rows = places.join(texts, same).select(places["conv_id"], F.floor(places["place"] / part_turns).alias("part"), places["place"], "n_turns", "body")
    # repeated rows bring equal bodies for a place: one is taken
    once = rows.groupBy("conv_id", "part", "place", "n_turns").agg(F.min("body").alias("body"))
    parts = once.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max("n_turns").alias("total_turns"), F.array_sort(F.collect_list(F.struct("place", "body"))).alias("x"))
    return parts.select("conv_id", "part", F.col("n").alias("n_turns"), "total_turns", F.array_join(F.transform("x", lambda t: t["body"]), "").alias("text"))

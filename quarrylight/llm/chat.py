"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A log that saves a conversation after every turn holds its prefixes too. Each conversation's turns get rolling prefix
hashes; a conversation whose whole hash is a longer one's prefix hash is dropped by an anti-join, equal conversations are
kept once, and what is left is rendered.

A prefix hash is the XOR of hashes of (place, role, text) up to a place, in two independent 64-bit halves. XOR can be
summed in any grouping, so a conversation of any length is cut into blocks of BLOCK turn numbers: places and hashes are
rolled inside blocks, and only one row per block is rolled over the conversation.

Defined results. Rows without conv_id are left out. A repeated row counts once. Rows of one turn number are ordered by
role and text. Null turns come first; null role or text is empty. Of equal conversations the smallest conv_id stays.
An empty table gives none. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import settle

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, turns): conv_id, place (from 1) and the prefix hashes x1, x2 there; and the distinct turns with texts."""
    rows = (
        turns.filter(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = settle(rows.withColumn("_local", F.row_number().over(inside)), "turns")
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", "block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    placed = rows.join(offsets, ["conv_id", "block"]).withColumn("place", F.col("_before") + F.col("_local"))
    placed = placed.withColumns({f"h{k}": F.xxhash64(F.lit(k), "place", "role", "text") for k in (1, 2)})
    rolled = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("conv_id", "block", "place", *[F.bit_xor(f"h{k}").over(rolled).alias(f"x{k}") for k in (1, 2)], F.col("h1"), F.col("h2"))
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    before = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{k}").over(over), F.lit(0)).alias(f"p{k}") for k in (1, 2)])
    return placed.join(before, ["conv_id", "block"]).select("conv_id", "place", *[F.col(f"x{k}").bitwiseXOR(F.col(f"p{k}")).alias(f"x{k}") for k in (1, 2)]), rows


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered."""
    prefixes, rows = numbered_turns(turns)
    prefixes = settle(prefixes, "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "x1", "x2")).alias("w")).select("conv_id", "w.*")
    kinds = whole.groupBy("place", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = prefixes.join(whole.select("conv_id", F.col("place").alias("_n")), "conv_id").filter(F.col("place") < F.col("_n"))
    maximal = kinds.join(proper.select("place", "x1", "x2").distinct(), ["place", "x1", "x2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")
    order = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    texts = rows.join(maximal, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(order)).alias("t"))
    return texts.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("t", lambda t: render(t["role"], t["text"])), "").alias("rendered"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, list(role || chr(1) || text ORDER BY turn NULLS FIRST, role, text) AS l,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM t GROUP BY conv_id),
g AS (SELECT min(conv_id) AS conv_id, n, count(*) AS n_copies, l, any_value(rendered) AS rendered FROM c GROUP BY n, l)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM g
WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.n > g.n AND list_slice(b.l, 1, g.n) = g.l)
"""

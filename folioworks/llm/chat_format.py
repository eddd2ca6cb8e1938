"""Preference formatting in built-in functions: shared prompt once, paired masked completions.

``preference_examples`` takes the turns of chosen and rejected conversations. The longest common prefix of turns (same
role, same text) is rendered once as the prompt; what is left of each side is a completion. Masks are character spans,
counted from the start of prompt and completion together, that a loss covers: the text and end marker of assistant turns.

Defined results: a null text or role counts as empty; rows without a pair id make one pair; a null turn comes first; turns sort by turn number, then role and text, so repeated rows
stay and order is fixed; a pair with one side missing has an empty completion there; pairs of equal sides have two
empty completions; very long texts stay whole; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


TURN = "struct<turn:bigint,role:string,text:string,till:bigint>"


def _side(turns: DataFrame, name: str) -> DataFrame:
    """Per pair its turns in order, each with where it ends in the rendered conversation."""
    plain = turns.select(F.col("pair_id").alias(f"{name}_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("role") + F.length("text") + F.lit(len(START) + len(MIDDLE) + len(END))
    order = Window.partitionBy(f"{name}_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    one = F.struct("turn", "role", "text", F.sum(size).over(order).alias("till"))
    return plain.select(f"{name}_id", one.alias("one")).groupBy(f"{name}_id").agg(F.array_sort(F.collect_list("one")).alias(name))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def mask_spans(turns: Column) -> Column:
    """Spans (start, end) of assistant text and end marker, from the start of the conversation."""
    only = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.transform(only, lambda t: F.struct((t["till"] - F.length(t["text"]) - F.lit(len(END))).alias("start"), t["till"].alias("end")))


def preference_examples(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both tables have pair_id, turn, role, text. One row per pair."""
    none = F.array().cast(f"array<{TURN}>")
    both = _side(chosen, "c").join(_side(rejected, "r"), F.col("c_id").eqNullSafe(F.col("r_id")), "full")
    both = both.select(F.coalesce("c_id", "r_id").alias("pair_id"), F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    both = both.withColumn("shared", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda side: F.slice(side, F.col("shared") + 1, F.greatest(F.size(side), F.lit(1)))
    parts = both.select("pair_id", "shared", rendered(F.slice("c", F.lit(1), F.col("shared"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        "pair_id",
        F.col("shared").cast("long").alias("shared_turns"),
        "prompt",
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        mask_spans(F.col("c")).alias("chosen_mask"),
        mask_spans(F.col("r")).alias("rejected_mask"),
    )


def swapped_endings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations: the rejected side ends with the last turn of the neighbour
    (2n and 2n + 1 are neighbours) instead of its own; without a neighbour that turn is missing.

    Turns are in the order of ``preference_examples``. Exactly one row is the last, so a last turn that is repeated loses one of
    its rows; the turn that takes its place has its number, which may be null. Turns without a conversation are one
    conversation, which has no neighbour.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("pair_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    ranked = turns.withColumn("from_end", F.row_number().over(order))
    last = ranked.filter("from_end = 1")
    lent = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "role", "text").join(last.select("pair_id", "turn"), "pair_id")
    return turns, ranked.filter("from_end > 1").drop("from_end").unionByName(lent)


def masks_as_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


ORACLE = """
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
ending AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end FROM t
), sides AS (
  SELECT 'c' AS side, pair_id, turn, role, text FROM t
  UNION ALL SELECT 'r', pair_id, turn, role, text FROM ending WHERE from_end > 1
  UNION ALL SELECT 'r', mine.pair_id, mine.turn, other.role, other.text FROM ending mine JOIN ending other ON other.pair_id = xor(mine.pair_id, 1) WHERE mine.from_end = 1 AND other.from_end = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn NULLS FIRST, role, text) AS k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM sides
), shared AS (
  SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, count(*)) AS n FROM (
    SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, coalesce(c.role = r.role AND c.text = r.text, false) AS same
    FROM (SELECT * FROM ranked WHERE side = 'c') c FULL JOIN (SELECT * FROM ranked WHERE side = 'r') r ON c.pair_id IS NOT DISTINCT FROM r.pair_id AND c.k = r.k) AS z
  GROUP BY pair_id
), placed AS (
  SELECT x.*, s.n, sum(length(piece)) OVER (PARTITION BY side, x.pair_id ORDER BY k) AS till FROM ranked x JOIN shared s ON s.pair_id IS NOT DISTINCT FROM x.pair_id
)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS shared_turns,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'c' AND k <= n), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'c' AND k > n), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'r' AND k > n), '') AS rejected,
  coalesce(string_agg((till - length(text) - 8) || '-' || till, ',' ORDER BY k) FILTER (side = 'c' AND k > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((till - length(text) - 8) || '-' || till, ',' ORDER BY k) FILTER (side = 'r' AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""

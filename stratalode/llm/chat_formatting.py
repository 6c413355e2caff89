"""Multi-party perspective rotation of dialogues, in DataFrame functions.

Every participant of a conversation (each role that isn't "system") sees it once: their own turns are the assistant's, the
others' are a user's with the speaker's name, system turns stay. A message renders as

    <|im_start|>assistant\\n{text}<|im_end|>\\n        or        <|im_start|>user name={speaker}\\n{text}<|im_end|>\\n

and the mask covers the assistant's text and its end marker, in characters of the whole rendered dialogue. Rows are
messages, so a conversation of any length stays spread: offsets are prefix sums in two steps, within blocks of turns and
over the blocks' sums.

Defined cases: a null text is empty; a null role is the speaker "unknown"; a null conv_id is a conversation of its own;
turns that tie are ordered by speaker and text and equal rows stay as many as they are; null turns come first; a
conversation of system turns only has no participants and gives no rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns whose offsets are summed together.
BLOCK = 1024
SYSTEM = "system"


def _speaker() -> Column:
    return F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown"))


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, turn, role, speaker, rendered, char_start, mask_start, mask_end (null where not trained)."""
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _speaker().alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    parties = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(parties, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.when(role == "user", F.concat(F.lit("<|im_start|>user name="), "speaker", F.lit("\n"))).otherwise(F.concat(F.lit("<|im_start|>"), role, F.lit("\n")))
    shown = each.withColumns({"role": role, "__head": F.length(head).cast("long"), "rendered": F.concat(head, "text", F.lit("<|im_end|>\n"))})
    shown = shown.withColumns({"__n": F.length("rendered").cast("long"), "__b": F.floor(F.coalesce("turn", F.lit(-1)) / F.lit(block))})
    key = ["conv_id", "perspective"]
    sums = shown.groupBy(*key, "__b").agg(F.sum("__n").alias("__s"))
    before = sums.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("__b").alias("__bb"), F.coalesce(F.sum("__s").over(Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*key, "__b").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    placed = placed.join(before, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("perspective") == F.col("__perspective")) & (F.col("__b") == F.col("__bb")))
    start = F.col("__before") + F.col("__in")
    mask = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "role", "speaker", "rendered", start.alias("char_start"),
        F.when(mask, start + F.col("__head")).alias("mask_start"), F.when(mask, start + F.col("__n") - 1).alias("mask_end"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH s AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
e AS (SELECT s.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN '<|im_start|>user name=' || speaker || chr(10) ELSE '<|im_start|>' || role || chr(10) END AS head FROM e),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
o AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM r)
SELECT conv_id, perspective, turn, role, speaker, rendered, CAST(place AS BIGINT) AS char_start,
  CASE WHEN role = 'assistant' THEN CAST(place + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN role = 'assistant' THEN CAST(place + length(rendered) - 1 AS BIGINT) END AS mask_end
FROM o
"""

"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users.  Only the assistant's
own words are trained on.  Narrators (system turns) keep their role in every
rendering and are nobody's perspective.

A result row is one turn of one rendering, with its text and its place in the
rendered dialogue; the texts in order of ``ordinal`` are the dialogue.  Places are
prefix sums over blocks of turns, so a conversation of any length is never
gathered in one task.

Cases: a null text is empty; a null role is the participant "unknown"; a turn with a
null conv_id is a dialogue of its own; null turns come first; turns that tie are
ordered by role and text, equal rows are all kept; a conversation of narrators
alone has no participant and gives no rows; an empty table gives no rows; other
columns are ignored.  The marker "<|" in a text is broken up, so that no text can
close its turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK_TURNS = 64
NO_NUMBER = -(1 << 63)


def _head(role: Column, name: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(" name="), name)), F.lit("\n"))


def rotate(conversations: DataFrame, narrators: Sequence[str] = ("system",)) -> DataFrame:
    break_up = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_NUMBER)).alias("at"),
        break_up(F.coalesce(F.col("role"), F.lit("unknown"))).alias("speaker"),
        break_up(F.coalesce(F.col("text"), F.lit(""))).alias("content"),
    )
    speaks = ~F.col("speaker").isin(*narrators) if narrators else F.lit(True)
    talks = rows.where(F.col("conv").isNotNull())
    cast = talks.where(speaks).select("conv", F.col("speaker").alias("perspective")).distinct()
    views = _rendered(talks.join(cast, "conv"), speaks).withColumn("block", F.floor(F.col("at") / BLOCK_TURNS))

    in_block = Window.partitionBy("conv", "perspective", "block").orderBy("at", "speaker", "content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    views = views.withColumn("turns_to", F.count("*").over(in_block)).withColumn("chars_to", F.sum("chars").over(in_block))
    blocks = views.groupBy("conv", "perspective", "block").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "perspective", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_before"))
    views = views.join(blocks, ["conv", "perspective", "block"])
    views = views.withColumn("ordinal", F.col("n_before") + F.col("turns_to") - 1).withColumn("start", F.col("c_before") + F.col("chars_to") - F.col("chars"))

    # A turn of no conversation is a dialogue of its own.
    alone = _rendered(rows.where(F.col("conv").isNull() & speaks).withColumn("perspective", F.col("speaker")), speaks)
    alone = alone.withColumn("ordinal", F.lit(0).cast("long")).withColumn("start", F.lit(0).cast("long"))
    views = views.select(alone.columns).unionByName(alone)

    stop = F.col("start") + F.col("chars")
    return views.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        "ordinal",
        F.when(F.col("at") != NO_NUMBER, F.col("at")).alias("turn"),
        "speaker",
        "role",
        "name",
        "rendered",
        "trained",
        "start",
        stop.alias("stop"),
        F.when(F.col("trained"), F.col("start") + F.col("head_chars")).alias("mask_start"),
        F.when(F.col("trained"), stop - 1).alias("mask_stop"),
    )


def _rendered(views: DataFrame, speaks: Column) -> DataFrame:
    """Role, name and text of a turn in a perspective."""
    own = F.col("speaker") == F.col("perspective")
    role = F.when(~speaks, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(speaks & ~own, F.col("speaker"))
    head = _head(role, name)
    views = views.select("conv", "perspective", "at", "speaker", role.alias("role"), name.alias("name"), "content", F.concat(head, "content", F.lit("<|im_end|>\n")).alias("rendered"), F.char_length(head).cast("long").alias("head_chars"), own.alias("trained"))
    return views.withColumn("chars", F.char_length("rendered").cast("long"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations),
c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (
  SELECT t.conv_id, c.perspective, t.turn, t.speaker, t.content,
         CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = c.perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN t.speaker <> 'system' AND t.speaker <> c.perspective THEN t.speaker END AS name,
         t.speaker = c.perspective AS trained
  FROM t JOIN c ON t.conv_id = c.conv_id),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM v),
r AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM h),
p AS (
  SELECT *, row_number() OVER w - 1 AS ordinal,
         CAST(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, content))
SELECT conv_id, perspective, ordinal, turn, speaker, role, name, rendered, trained,
       CAST(stop - length(rendered) AS BIGINT) AS start, stop,
       CASE WHEN trained THEN CAST(stop - length(rendered) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN trained THEN CAST(stop - 1 AS BIGINT) END AS mask_stop
FROM p
UNION ALL
SELECT NULL, speaker, 0, turn, speaker, 'assistant', NULL, rendered, true, 0, length(rendered), length(head), length(rendered) - 1
FROM (SELECT *, '<|im_start|>assistant' || chr(10) AS head, '<|im_start|>assistant' || chr(10) || content || '<|im_end|>' || chr(10) AS rendered
      FROM t WHERE conv_id IS NULL AND speaker <> 'system')
"""

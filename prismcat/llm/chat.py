"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant, the others as named users, and a mask that covers the
assistant's own words and their end mark.  System turns stay system turns; they
are no participant.

A rendering comes as one row per turn with its place in the whole text, so no
conversation has to fit one task: places are running sums, first over spans of
turns and then within a span.  ``dialogues`` joins the rows to whole texts.

Turns go in ascending order, null last, ties by speaker and text.  A null text
is empty; a null speaker is a user named ``unknown`` and takes no perspective;
rows with a null conv_id make up one conversation.  Repeated rows are repeated
turns.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm._arrow import columns
from prismcat.plans.scratch import Scratch

SYSTEM, UNKNOWN = "system", "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers to a span.
SPAN = 256


def render(conversations: DataFrame) -> DataFrame:
    """One row per conversation, perspective and turn.

    conv_id, perspective, position (from 0), turn, speaker, shown_role, segment,
    char_start, char_end, and mask_start, mask_end (null where nothing is learned).
    """
    turns = columns(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / SPAN).alias("span"),
    )
    people = Scratch(conversations.sparkSession, "chat").write(
        turns.where(~F.col("speaker").isin(SYSTEM, UNKNOWN)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct(), "people"
    )
    system, own = F.col("speaker") == SYSTEM, F.col("speaker") == F.col("perspective")
    head = F.when(system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    shown = (
        turns.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
        .drop("c")
        .withColumn("shown_role", F.when(system, "system").when(own, "assistant").otherwise("user"))
        .withColumn("segment", F.concat(F.lit(START), head, F.lit("\n"), F.col("text"), F.lit(END)))
        .withColumn("n", F.length("segment").cast("long"))
    )
    key = ["conv_id", "perspective"]
    spans = shown.groupBy(*key, "span").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy(*key).orderBy(F.col("span").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    base = spans.select(
        *[F.col(c).alias(f"_{c}") for c in [*key, "span"]],
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("first"),
    )
    inside = Window.partitionBy(*key, "span").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    placed = shown.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "span"]]
    end = F.col("base") + F.col("upto")
    mine = F.col("shown_role") == "assistant"
    return placed.join(base, same).select(
        "conv_id",
        "perspective",
        (F.col("first") + F.col("nth") - 1).cast("long").alias("position"),
        "turn",
        "speaker",
        "shown_role",
        "segment",
        (end - F.col("n")).alias("char_start"),
        end.alias("char_end"),
        F.when(mine, end - F.length("text") - len(END)).alias("mask_start"),
        F.when(mine, end).alias("mask_end"),
    )


def dialogues(rendered: DataFrame) -> DataFrame:
    """One row per conversation and perspective: its whole text and the masked spans.

    A dialogue becomes one row here, so each must fit one.
    """
    rows = F.array_sort(F.collect_list(F.struct("position", "segment", "mask_start", "mask_end")))
    return (
        rendered.groupBy("conv_id", "perspective")
        .agg(rows.alias("rows"))
        .select(
            "conv_id",
            "perspective",
            F.array_join(F.col("rows.segment"), "").alias("text"),
            F.transform(F.filter("rows", lambda r: r.mask_start.isNotNull()), lambda r: F.struct(r.mask_start.alias("start"), r.mask_end.alias("end"))).alias("masks"),
        )
    )


def op3_chat_rotation(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` from every participant's perspective."""
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker NOT IN ('system', 'unknown')
), s AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.text,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS shown_role,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                ELSE 'user name=' || speaker END || chr(10) || text || '<|im_end|>' || chr(10) AS segment
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), w AS (
  SELECT *, row_number() OVER o - 1 AS position, (sum(length(segment)) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT AS char_end
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text)
)
SELECT conv_id, perspective, position, turn, speaker, shown_role, segment,
       char_end - length(segment) AS char_start, char_end,
       CASE WHEN shown_role = 'assistant' THEN char_end - length(text) - 11 END AS mask_start,
       CASE WHEN shown_role = 'assistant' THEN char_end END AS mask_end
FROM w
"""

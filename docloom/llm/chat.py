"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users. The result is one row per perspective and turn, in rendering order: concatenating the segments of a
perspective gives the whole dialogue, and no conversation is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT, USER, END = "<|assistant|>\n", "<|user|>\n", "<|end|>\n"
#: Where a text or a name holds the start of a mark, a backslash parts its two characters: no speaker can forge a turn.
OPENS, PARTED = "<|", "<\\|"
#: Turns of a conversation that one window holds; counts and lengths of such blocks are added up first.
BLOCK_TURNS = 64


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, perspective, position, turn, speaker, segment_role, segment, seg_start, seg_end, mask_start, mask_end).

    position counts from 1; offsets are characters of the rendered dialogue; the mask is the span that is learnt (the
    assistant's text and end mark), null in other turns. Nulls: a null speaker is the participant 'unknown', a null
    text is empty, a null conversation is a conversation, null turns come last. Ties in the turn go by speaker, then
    text; equal rows are turns of their own. Marks within texts and names are parted. Very long texts and conversations
    stay rows of their own turn. Other columns are dropped, whatever their names. An empty table gives no rows.
    """
    plain = lambda c: F.replace(c, F.lit(OPENS), F.lit(PARTED))
    rows = turns.select(
        F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("s"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x")
    ).withColumn("b", F.floor(F.col("t") / BLOCK_TURNS))
    parties = rows.select(F.col("c").alias("pc"), F.col("s").alias("p")).distinct()
    seen = rows.join(parties, F.col("c").eqNullSafe(F.col("pc"))).drop("pc")
    own = F.col("s") == F.col("p")
    body = F.concat(plain(F.col("x")), F.lit("\n"), F.lit(END))
    seen = seen.withColumn("seg", F.when(own, F.concat(F.lit(ASSISTANT), body)).otherwise(F.concat(F.lit(USER), plain(F.col("s")), F.lit(": "), body))).withColumn("n", F.length("seg").cast("long"))
    blocks = seen.groupBy("c", "p", "b").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))
    ahead = Window.partitionBy("c", "p").orderBy(F.col("b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("c").alias("bc"), F.col("p").alias("bp"), F.col("b").alias("bb"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("chars"))
    inside = Window.partitionBy("c", "p", "b").orderBy(F.col("t").asc_nulls_last(), "s", "x")
    seen = seen.withColumn("i", F.row_number().over(inside)).withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    at = seen.join(blocks, F.col("c").eqNullSafe(F.col("bc")) & (F.col("p") == F.col("bp")) & F.col("b").eqNullSafe(F.col("bb")))
    end = F.col("chars") + F.col("upto")
    start = end - F.col("n")
    return at.select(
        F.col("c").alias("conv_id"), F.col("p").alias("perspective"), (F.col("rows") + F.col("i")).cast("long").alias("position"), F.col("t").alias("turn"), F.col("s").alias("speaker"), F.when(own, "assistant").otherwise("user").alias("segment_role"),
        F.col("seg").alias("segment"), start.alias("seg_start"), end.alias("seg_end"), F.when(own, start + len(ASSISTANT)).alias("mask_start"), F.when(own, end).alias("mask_end"),
    )


ORACLE = """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS x FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r),
s AS (SELECT r.conv_id, perspective, turn, speaker, x, CASE WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS segment_role,
  CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) || replace(x, '<|', '<\\|') ELSE '<|user|>' || chr(10) || replace(speaker, '<|', '<\\|') || ': ' || replace(x, '<|', '<\\|') END || chr(10) || '<|end|>' || chr(10) AS segment
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, row_number() OVER w AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS seg_end FROM s
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, position, turn, speaker, segment_role, segment, seg_end - length(segment) AS seg_start, seg_end,
  CASE WHEN speaker = perspective THEN seg_end - length(segment) + 14 END AS mask_start, CASE WHEN speaker = perspective THEN seg_end END AS mask_end FROM o
"""

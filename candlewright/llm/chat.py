"""Chat formatting by multi-party perspective rotation, in DataFrame operations alone.

Every participant of a conversation is the assistant once: the dialogue is rendered with that speaker's messages as the
assistant's and all others as named users, with a mask that marks the assistant's own text as what to learn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks around a message. Fixed values of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(messages: DataFrame, turns: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, speaker, part, n_messages, n_own, text, mask: a row for each conversation, speaker and part.

    By default a conversation is rendered whole, as part 0: a row has one dialogue, as long as that is. With `turns`,
    dialogues are cut into parts of so many messages in a row, counted from 0, whatever their turn numbers, and a
    speaker has every part, whether they speak there or not; a row is then bounded, as are all arrays.
    Messages are in order of turn (null first), then role, then text; repeated rows count once. mask: "length:flag"
    segments in characters, which add up to the text; flag 1 covers the speaker's text and its closing mark. Null texts
    are empty, a null role is "unknown", and a null conv_id is a conversation like others. Other columns play no part;
    an empty table gives no rows.
    """
    rows = messages.select(
        messages[conv_col].alias("conv_id"),
        messages[turn_col].cast("long").alias("turn"),
        F.coalesce(messages[role_col].cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(messages[text_col].cast("string"), F.lit("")).alias("text"),
    ).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    part = F.lit(0).cast("long") if turns is None else F.floor((F.row_number().over(order) - 1) / turns).cast("long")
    parts = rows.withColumn("part", part).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), F.col("turn").isNotNull().alias("known"), "role", "text"))).alias("said"))
    speakers = rows.select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    both = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["of"]))
    own = lambda m: m["role"] == F.col("speaker")
    head = lambda m: F.concat(F.lit(OPEN), F.when(own(m), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["role"])), F.lit("\n"))
    text = F.array_join(F.transform("said", lambda m: F.concat(head(m), m["text"], F.lit(CLOSE))), "")
    flags = lambda m: F.concat(F.length(head(m)), F.lit(":0,"), F.length(m["text"]) + len(CLOSE), F.lit(":"), own(m).cast("int"))
    mask = F.array_join(F.transform("said", flags), ",")
    return both.select("conv_id", "speaker", "part", F.size("said").cast("long").alias("n_messages"), F.size(F.filter("said", own)).cast("long").alias("n_own"), text.alias("text"), mask.alias("mask"))


#: The same for DuckDB.
SQL = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CAST(0 AS BIGINT) AS part
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows),
said AS (
  SELECT r.*, s.speaker, r.role = s.speaker AS own,
         '<|im_start|>' || CASE WHEN r.role = s.speaker THEN 'assistant' ELSE 'user name=' || r.role END || chr(10) AS head
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, speaker, part, count(*) AS n_messages, CAST(sum(CAST(own AS INT)) AS BIGINT) AS n_own,
       sha256(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS text_sha256,
       string_agg(length(head) || ':0,' || (length(text) + 11) || ':' || CAST(own AS INT), ',' ORDER BY turn NULLS FIRST, role, text) AS mask
FROM said GROUP BY conv_id, speaker, part
"""

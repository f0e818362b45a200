"""Chat formatting: multi-party perspective rotation, by DataFrame functions only.

For every participant of a conversation (every role but `system`) the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; only the assistant's messages bear loss.

Layout: `<|system|>`, `<|assistant|>` or `<|user:NAME|>`, a line end, the text, `<|end|>` and a line end. `<|` inside texts and
names becomes `< |`, so texts can't forge a header. `loss_spans` are code-point offsets in the rendered text, from after an
assistant header to after its `<|end|>`.

A message is some speaker's own once, so its place in that speaker's rendering follows from two running sums over the
conversation: lengths with every speaker named, and how often the speaker has spoken. Spans are thus collected from the
messages, not by walking every rendering.

A row holds a whole dialogue, as that is what is asked for, so one conversation's messages meet in one task. With `part_turns`
longer ones are rendered in parts of so many turn numbers, each of which begins with all system messages of the dialogue.

Defined results: null text is an empty message; null role is the speaker `unknown`; messages without a turn come first, and
rows that repeat without one are messages each; rows that repeat with their turn are one message; equal turns are ordered by
role, then text; rows without conv_id belong to no conversation; conversations with only system messages have no participant
and give no row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsieve.llm.common import read

END = "<|end|>\n"
SYSTEM_HEAD, ASSISTANT_HEAD = "<|system|>\n", "<|assistant|>\n"


def _safe(column: Column) -> Column:
    return F.replace(column, F.lit("<|"), F.lit("< |"))


def _named(role: Column) -> Column:
    """The header of a message by somebody else."""
    return F.when(role == "system", F.lit(SYSTEM_HEAD)).otherwise(F.concat(F.lit("<|user:"), _safe(role), F.lit("|>\n")))


def perspectives(conversations: DataFrame, part_turns: int | None = None) -> DataFrame:
    """conv_id, part, speaker, text, n_messages, mask (1 for loss-bearing messages), loss_spans, loss_chars."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("body"),
    )
    # equal rows meet as a count, so a row with a third of all copies is one row a task
    counted = rows.groupBy("conv_id", "turn", "role", "body").agg(F.count("*").alias("copies"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("turn").isNull(), F.col("copies")).otherwise(1)))).drop("copies")
    speakers = counted.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    if part_turns is None:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long"))
        system = rows.where("role = 'system'").withColumnRenamed("part", "own")
        repeated = system.join(rows.select("conv_id", "part").distinct(), "conv_id").where("part <> own").drop("own")
        rows = rows.unionByName(repeated)
    place = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "body", "copy")
    rest = F.concat(_safe(F.col("body")), F.lit(END))
    rows = rows.select("conv_id", "part", "turn", "role", "body", "copy", _named(F.col("role")).alias("head"), rest.alias("rest"))
    before = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spoken = F.row_number().over(Window.partitionBy("conv_id", "part", "role").orderBy("turn", "body", "copy")) - 1
    shorter = F.char_length("head") - len(ASSISTANT_HEAD)  # by so much an own message's header differs from its named one
    rows = rows.withColumn("spoken", spoken)
    rows = rows.withColumn("at", F.sum(F.char_length("head") + F.char_length("rest")).over(before) - F.char_length("head") - F.char_length("rest") - F.col("spoken") * shorter + len(ASSISTANT_HEAD))
    rows = rows.withColumn("until", F.col("at") + F.char_length("rest") - 1)  # the line end after the marker bears no loss
    message = F.struct("turn", "role", "body", "copy", "head", "rest", F.col("at").cast("long").alias("at"), F.col("until").cast("long").alias("until"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    told = parts.join(speakers, "conv_id")
    speaker = F.col("speaker")
    own = F.filter("messages", lambda m: m.role == speaker)
    return told.select(
        "conv_id",
        "part",
        "speaker",
        F.array_join(F.transform("messages", lambda m: F.concat(F.when(m.role == speaker, F.lit(ASSISTANT_HEAD)).otherwise(m["head"]), m["rest"])), "").alias("text"),
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.when(m.role == speaker, F.lit("1")).otherwise(F.lit("0"))), "").alias("mask"),
        F.array_join(F.transform(own, lambda m: F.concat_ws("-", m["at"].cast("string"), m["until"].cast("string"))), ",").alias("loss_spans"),
        F.aggregate(F.transform(own, lambda m: m["until"] - m["at"]), F.lit(0).cast("long"), lambda a, b: a + b).alias("loss_chars"),
    )


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(read(spark, sf_dir, "conversations"))


SQL = {
    "op7_chat_perspectives": """
WITH r AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce("text", '') AS body FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT DISTINCT * FROM r WHERE turn IS NOT NULL UNION ALL SELECT * FROM r WHERE turn IS NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
p AS (
  SELECT m.conv_id, speaker, turn, role, body, role = speaker AS own,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head,
         replace(body, '<|', '< |') || '<|end|>' || chr(10) AS rest
  FROM m JOIN s ON m.conv_id = s.conv_id),
q AS (
  SELECT *, coalesce(sum(length(head) + length(rest)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, body
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins
  FROM p)
SELECT conv_id, CAST(0 AS BIGINT) AS part, speaker,
       string_agg(head || rest, '' ORDER BY turn NULLS FIRST, role, body) AS "text",
       count(*) AS n_messages,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, role, body) AS mask,
       coalesce(string_agg(CASE WHEN own THEN CAST(begins AS BIGINT) || '-' || CAST(begins + length(rest) - 1 AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, role, body), '') AS loss_spans,
       CAST(sum(CASE WHEN own THEN length(rest) - 1 ELSE 0 END) AS BIGINT) AS loss_chars
FROM q GROUP BY conv_id, speaker
"""
}

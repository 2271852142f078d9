"""Chat formatting by multi-party perspective rotation. DataFrame operations only.

A dialogue is rendered once for every participant. In each rendering that speaker is the assistant, whose words are to be learned; all others
are users with their names; system turns stay system turns. Masks are the character spans of the assistant's words in the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: A dialogue is rendered in parts of so many turn numbers, so that no row grows without bound; common dialogues have one part.
TURNS_TOGETHER = 512


def _safe(text: Column) -> Column:
    """Marks of the format inside a text are broken up, so that they can't end a turn."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))


def _named(speaker: Column) -> Column:
    """A speaker's name as a header may hold it: on one line, without marks of the format."""
    return F.regexp_replace(_safe(speaker), r"[\r\n]+", " ")


def rotate(turns: DataFrame, turns_together: int | None = TURNS_TOGETHER) -> DataFrame:
    """conv_id, perspective, part, piece, n_turns, text, spans (array of struct<first, upto>: characters, from 0, upto not included).

    From (conv_id, turn, role, text); other columns are not used. role names the speaker; turns whose role is ``system`` belong to nobody, and
    those whose role is null to the speaker ``unknown``. Null text is empty. Turns of equal number go by role, then text; repeated rows are
    kept. A dialogue with system turns only has no rendering. The spans are the assistant's words; the mark that ends its turn is not in them.

    part counts from the turn numbers, 0 for those below ``turns_together``; a null turn number sorts first, in part 0. A part that holds more rows than that (turn numbers
    repeat) is rendered in pieces of as many. So no row grows without bound; with ``turns_together`` None a dialogue is rendered whole, however long it is. A row without conv_id is a dialogue of its own.
    """
    speaker = F.coalesce("role", F.lit("unknown"))
    part = F.coalesce(F.floor(F.col("turn") / (turns_together or 1)), F.lit(0)).cast("long") if turns_together else F.lit(0).cast("long")
    rows = turns.select("conv_id", part.alias("part"), F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), _safe(F.col("text")).alias("body"))
    said = F.struct("turn", "speaker", "body")
    alone = rows.where("conv_id IS NULL AND speaker <> 'system'").select("conv_id", "part", F.lit(0).cast("long").alias("piece"), F.array(said).alias("said"), F.col("speaker").alias("perspective"))
    rows = rows.where("conv_id IS NOT NULL")
    speakers = rows.where("speaker <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    piece = F.lit(0).cast("long")
    if turns_together:
        piece = F.floor((F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "body")) - 1) / turns_together).cast("long")
    parts = rows.withColumn("piece", piece).groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(said)).alias("said"))
    each = parts.join(speakers, "conv_id").select("conv_id", "part", "piece", "said", F.explode("speakers").alias("perspective")).unionByName(alone)

    mine = lambda t: t["speaker"] == F.col("perspective")
    head = lambda t: F.when(t["speaker"] == "system", F.lit(f"{START}system\n")).when(mine(t), F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), _named(t["speaker"]), F.lit("\n")))
    close = f"{END}\n"
    segments = F.transform("said", lambda t: F.struct(head(t).alias("head"), t["body"].alias("body"), mine(t).alias("mine")))
    each = each.withColumn("segments", segments)

    def add(acc, s):
        first = acc["at"] + F.length(s["head"])
        upto = first + F.length(s["body"])
        spans = F.when(s["mine"], F.concat(acc["spans"], F.array(F.struct(first.alias("first"), upto.alias("upto"))))).otherwise(acc["spans"])
        return F.struct((upto + len(close)).alias("at"), spans.alias("spans"))

    empty = F.array().cast("array<struct<first:int,upto:int>>")
    spans = F.aggregate("segments", F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit(close))), "")
    return each.select("conv_id", "perspective", "part", "piece", F.size("said").alias("n_turns"), text.alias("text"), spans.alias("spans"))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["upto"].cast("string"))), " ")
    return done.select("conv_id", "perspective", "part", "piece", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("spans"), F.size("spans").cast("long").alias("n_learned"))


OP5_SQL = """
WITH t0 AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, CAST(coalesce(floor(turn / 512), 0) AS BIGINT) AS part, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS body
  FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, alone, part ORDER BY turn NULLS FIRST, speaker, body) - 1) // 512 AS piece FROM t0),
p AS (SELECT DISTINCT conv_id, alone, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.conv_id, t.alone, p.perspective, t.part, t.piece, t.turn, t.speaker, t.body, t.speaker = p.perspective AS mine,
         CASE WHEN t.speaker = 'system' THEN '<|im_start|>system' WHEN t.speaker = p.perspective THEN '<|im_start|>assistant'
              ELSE '<|im_start|>user name=' || regexp_replace(replace(replace(t.speaker, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>'), '[\\r\\n]+', ' ', 'g') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.alone IS NOT DISTINCT FROM p.alone),
o AS (
  SELECT *, row_number() OVER w AS n,
         sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, alone, perspective, part, piece ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING)
           - length(body) - 11 AS first
  FROM s WINDOW w AS (PARTITION BY conv_id, alone, perspective, part, piece ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, part, piece, count(*) AS n_turns, string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(CASE WHEN mine THEN CAST(first AS BIGINT) || '-' || CAST(first + length(body) AS BIGINT) END, ' ' ORDER BY n), '') AS spans,
       count(*) FILTER (WHERE mine) AS n_learned
FROM o GROUP BY conv_id, alone, perspective, part, piece
"""

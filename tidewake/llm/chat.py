"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant
and everybody else as a named user. A row is one turn of one rendering: its text, its character
range within the rendered dialogue, and the range the loss mask covers (the assistant's words and
end mark, else empty). Concatenating the rows of a rendering in order gives the whole dialogue, so
no conversation, however long, is ever gathered in one task: offsets are running sums of three levels
(blocks of 64 turn numbers, then turns by 256 parts of the hash that orders equal turn numbers, then
turns). In texts ``<|`` is written ``<\\|``, and characters that would end a name are written as
``%`` and their code, so that no turn can forge another's marks and no two names are written alike.

Defined cases: a null role is the speaker ``unknown``; null texts are empty; turns are ordered by
(turn, md5 of role and text, role, text), null turns first; repeated rows are repeated turns; a null
conv_id is a conversation like any other, and ids keep their type; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import repeated

SPAN = 64
ASSISTANT = "<|assistant|>\n"
END = "<|end|>\n"
#: Characters of names that would end them, and what stands for each.
NAMES = (("%", "%25"), ("<", "%3C"), ("|", "%7C"), (">", "%3E"), ("\r", "%0D"), ("\n", "%0A"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, turn, role, segment, start, end, mask_start, mask_end."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    people = turns.select("conv", F.col("role").alias("speaker")).distinct()
    rows = turns.join(people, "conv")
    own, name = F.col("role") == F.col("speaker"), F.col("role")
    for mark, code in NAMES:
        name = F.replace(name, F.lit(mark), F.lit(code))
    head = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    body = F.replace(F.col("text"), F.lit("<|"), F.lit("<\\|"))
    rows = rows.withColumn("own", own).withColumn("head", F.length(head)).withColumn("segment", F.concat(head, body, F.lit(END)))
    rows = rows.withColumn("size", F.length("segment").cast("bigint")).withColumn("at", F.coalesce("turn", F.lit(-(1 << 62)))).withColumn("span", F.floor(F.col("at") / SPAN))
    rows = rows.withColumn("place", F.md5(F.concat_ws("|", "role", "text"))).withColumn("part", F.substring("place", 1, 2)).withColumn("mass", F.col("size") * F.col("copies"))

    def before(sums: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
        over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn(column, F.coalesce(F.sum("inside").over(over), F.lit(0)))

    parts = rows.groupBy("conv", "speaker", "span", "at", "part").agg(F.sum("mass").alias("inside"))
    spans = before(parts.groupBy("conv", "speaker", "span").agg(F.sum("inside").alias("inside")), ["conv", "speaker"], ["span"], "before").drop("inside")
    parts = before(parts, ["conv", "speaker", "span"], ["at", "part"], "within").join(spans, ["conv", "speaker", "span"])
    parts = parts.select("conv", "speaker", "at", "part", (F.col("before") + F.col("within")).alias("base"))
    inner = Window.partitionBy("conv", "speaker", "at", "part").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("mass").over(inner), F.lit(0))).join(parts, ["conv", "speaker", "at", "part"])
    rows = repeated(rows, "copies")
    rows = rows.withColumn("start", F.col("base") + F.col("inner") + F.col("copy") * F.col("size")).withColumn("end", F.col("start") + F.col("size"))
    mask = F.when(F.col("own"), F.col("start") + F.col("head")).otherwise(F.col("end"))
    return rows.select("conv_id", "speaker", "turn", "role", "segment", "start", "end", mask.alias("mask_start"), F.col("end").alias("mask_end"))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '-') AS conv, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT conv_id, conv, speaker, turn, role, text, role = speaker AS own,
        CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '|', '%7C'), '>', '%3E'), chr(13), '%0D'), chr(10), '%0A') || '|>' || chr(10) END AS head
      FROM t JOIN (SELECT DISTINCT conv, role AS speaker FROM t) USING (conv)),
s AS (SELECT *, head || replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS segment FROM r),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv, speaker ORDER BY turn NULLS FIRST, md5(role || '|' || text), role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM s)
SELECT conv_id, speaker, turn, role, segment, CAST("end" - length(segment) AS BIGINT) AS start, "end",
       CAST(CASE WHEN own THEN "end" - length(segment) + length(head) ELSE "end" END AS BIGINT) AS mask_start, "end" AS mask_end FROM o
"""

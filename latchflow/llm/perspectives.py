"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation (each role but `system`), the dialogue is rendered with that
speaker as assistant, all others as named users, and system turns as they are. The result is the rendering in segments,
one row per turn and perspective: joined in the order of `position` they are the whole text, in which
a segment spans [start, stop) and its content [content_start, content_stop), in characters. `trained`
is the loss mask: it is true for the content of the assistant's turns.

Segments keep a conversation of any length spread over tasks; positions and offsets are
two running sums over pieces, each a long of its own.

Nulls: a null role is the participant `unknown`; a null text is empty; null conv_ids are one
conversation; a null turn comes first. Turns alike in number are ordered by role and text. Markers inside texts
and names lose their meaning: `<|` becomes `<\\|`, `|>` becomes `|\\>`, a backslash is doubled, and line breaks in names become `\\n` and `\\r`. A conversation of system turns only has no perspective. An empty
table gives an empty result. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import running

SYSTEM, UNKNOWN = "system", "unknown"


#: What stands for characters that could form a marker or break a header; the backslash comes first, so all can be undone.
ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>"))
NAME_ESCAPES = (*ESCAPES, ("\n", "\\n"), ("\r", "\\r"))


def _plain(text: Column, escapes=ESCAPES) -> Column:
    for raw, written in escapes:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, segment, start, content_start, content_stop, stop, trained."""
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), _plain(F.coalesce("text", F.lit(""))).alias("content"),
    )
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _plain(F.col("speaker"), NAME_ESCAPES), F.lit("|>\n")))
    )
    rows = seen.select(
        "conv_id", "perspective", "turn", "speaker", head.alias("head"), "content", own.alias("trained"),
    ).withColumn("segment", F.concat("head", "content", F.lit("<|end|>\n"))).withColumns(
        {"_size": F.length("segment").cast("long"), "_one": F.lit(1).cast("long")}
    ).withColumn("_key", F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "perspective"))
    placed = running(rows, "_key", [F.col("turn"), F.col("speaker"), F.col("content")], "_size", "start", ("_one", "position"))
    start = F.col("start")
    begin = start + F.length("head")
    return placed.select(
        "conv_id", "perspective", "position", "turn", "speaker", "segment",
        "start", begin.alias("content_start"), (begin + F.length("content")).alias("content_stop"),
        (start + F.length("segment")).alias("stop"), "trained",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _plain_sql(text: str, escapes=ESCAPES) -> str:
    for raw, written in escapes:
        found = {"\n": "chr(10)", "\r": "chr(13)"}.get(raw, f"'{raw}'")
        text = f"replace({text}, {found}, '{written}')"
    return text


def oracle() -> str:
    return rf"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, {_plain_sql("coalesce(text, '')")} AS content
      FROM conversations),
    people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> '{SYSTEM}'),
    heads AS (
      SELECT s.*, perspective, speaker = perspective AS trained,
        CASE WHEN speaker = '{SYSTEM}' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
          ELSE '<|user name=' || {_plain_sql("speaker", NAME_ESCAPES)} || '|>' || chr(10) END AS head
      FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
    parts AS (SELECT *, head || content || '<|end|>' || chr(10) AS segment FROM heads),
    placed AS (
      SELECT *, row_number() OVER w - 1 AS position, (sum(length(segment)) OVER w - length(segment))::BIGINT AS start
      FROM parts WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, perspective, position, turn, speaker, segment, start, start + length(head) AS content_start,
      start + length(head) + length(content) AS content_stop, start + length(segment) AS stop, trained FROM placed
    """

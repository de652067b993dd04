"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once, with that speaker as
the assistant, all others as users under their names, and loss masks on the speaker's own turns.
All steps are native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """`<|` inside a text gets a backslash (`<\\|`), and one more if it has some: markers stay unique and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def named(role: Column) -> Column:
    """A role for one line of a header: backslashes doubled, line feeds as `\\n`, markers escaped; it can be undone."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system", part_turns: int | None = None) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, masks (array of start, end in code points of the text).

    A dialogue is one row for each participant, with part 0. As a row has at most 2 GB, a dialogue beyond that needs
    `part_turns`: part p then holds the turn numbers from p times as many, and masks count from the part's start. Turns of
    one number are ordered by role, then text. A mask covers the speaker's text and its end marker. Where a turn begins is
    summed once a conversation, with all under their names; a speaker's own headers shift it by a fixed length each.

    Defined cases: a null role is the speaker `unknown`; the system role is no participant and is rendered as
    such for each; a conversation without participants gives no row; a null text is an empty turn; a null turn
    number comes before all others (in a part of its own, null, with `part_turns`); a null conv_id is a conversation of
    its own; repeated rows are repeated turns; an empty table gives an empty frame; other columns are not read.
    """
    number = F.col(turn).cast("long")
    part = F.lit(0).cast("long") if part_turns is None else F.floor(number / part_turns).cast("long")
    who = F.coalesce(F.col(role), F.lit("unknown"))
    rows = turns.select(F.col(conv).alias("conv_id"), part.alias("part"), number.alias("turn"), who.alias("role"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    head = F.when(F.col("role") == system, f"{START}system\n").otherwise(F.concat(F.lit(f"{START}user name="), named(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("head", head).withColumn("size", (F.length("head") + F.length("text") + len(END) + 1).cast("long"))
    before = W.partitionBy("conv_id", "part").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "head", "text"))).alias("turns"))
    speakers = rows.where(F.col("role") != system).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    mine = f"{START}assistant\n"
    own = lambda t: t["role"] == F.col("speaker")
    pieces = F.transform("turns", lambda t: F.concat(F.when(own(t), mine).otherwise(t["head"]), t["text"], F.lit(f"{END}\n")))

    def mask(t: Column, k: Column) -> Column:
        start = t["at"] + k * (len(mine) - F.length(t["head"])) + len(mine)
        return F.struct(start.alias("start"), (start + F.length(t["text"]) + len(END)).alias("end"))

    return both.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(pieces, "").alias("text"), F.transform(F.filter("turns", own), mask).alias("masks"))


def mask_text(masks: Column) -> Column:
    """`start-end` pairs, comma-joined."""
    return F.array_join(F.transform(masks, lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS part, coalesce(role, 'unknown') AS role,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), pieces AS (
  SELECT t.conv_id, s.speaker, t.part, t.turn, t.role, t.text, t.role = s.speaker AS own,
         CASE WHEN t.role = s.speaker THEN '<|im_start|>assistant' || chr(10) WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || regexp_replace(replace(replace(t.role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10) END AS head
  FROM t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(text) + 11) OVER w - (length(head) + length(text) + 11) AS pos
  FROM pieces
  WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(head) + length(text) + 10 AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS masks
FROM placed GROUP BY conv_id, speaker, part
"""

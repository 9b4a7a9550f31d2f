"""Chat formatting with a grammar round trip, in column expressions only.

    conversation := "<chat escaped=" ("0" | "1") ">\n" turn*
    turn         := "### " role ": " text "</turn>\n"

The parser is deterministic: "</turn>" ends a turn wherever it stands, the first ": " ends a role.
Every conversation is rendered as it is, parsed and compared with its source; one that does not come
back identical is rendered again with its control strings escaped ("%" as "%25", "</turn>" as
"%3C/turn>", ":" in roles as "%3A"), parsed and compared again. Escaped text holds no control string
and every escape can be read back, so the second form always passes; the query fails if not.

Turns are ordered by turn number (NULL first), then role and text. A NULL text or role is empty.
Equal rows stay separate turns. A NULL conv_id is a conversation like others. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import keep, table

LOSS_ROLE = "assistant"
END = "</turn>"
CLASH_ID = -7
CLASH_TEXT = "\\### Assistant: </turn> ok"


def _escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(END), F.lit("%3C/turn>"))
    return F.replace(out, F.lit(":"), F.lit("%3A")) if role else out


def _unescape(text: Column) -> Column:
    for code, char in (("%3A", ":"), ("%3C", "<"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def rendered(turns: Column, level: int) -> Column:
    """The text of an array of (role, text)."""

    def turn(t: Column) -> Column:
        role, text = (t.role, t.text) if level == 0 else (_escape(t.role, True), _escape(t.text))
        return F.concat(F.lit("### "), role, F.lit(": "), text, F.lit(END + "\n"))

    return F.concat(F.lit(f"<chat escaped={level}>\n"), F.array_join(F.transform(turns, turn), ""))


def parsed(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation; NULL where it breaks the grammar."""
    escaped = F.startswith(formatted, F.lit("<chat escaped=1>"))
    body = F.substr(formatted, F.lit(len("<chat escaped=0>\n") + 1))
    parts = F.split(body, END + "\n?", -1)
    pieces = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        colon = F.locate(": ", p)
        role, text = F.substr(p, F.lit(5), colon - 5), F.substr(p, colon + 2)
        return F.struct(F.when(escaped, _unescape(role)).otherwise(role).alias("role"), F.when(escaped, _unescape(text)).otherwise(text).alias("text"))

    fine = (F.element_at(parts, -1) == "") & F.forall(pieces, lambda p: F.startswith(p, F.lit("### ")) & (F.locate(": ", p) >= 5))
    return F.when(fine, F.transform(pieces, turn))


def loss_spans(formatted: Column) -> Column:
    """(start from 0, length) in code points of every assistant text in the formatted conversation."""
    body = F.substr(formatted, F.lit(len("<chat escaped=0>\n") + 1))
    parts = F.split(body, END + "\n")
    pieces = F.slice(parts, F.lit(1), F.size(parts) - 1)
    start = F.struct(F.lit(len("<chat escaped=0>\n")).alias("at"), F.lit(None).cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        head = F.locate(": ", p) + 1
        own = F.array(F.struct((state.at + head).alias("start"), (F.length(p) - head).alias("length")))
        spans = F.coalesce(state.spans, F.array().cast("array<struct<start: int, length: int>>"))
        mine = F.startswith(p, F.lit(f"### {LOSS_ROLE}: "))
        return F.struct((state.at + F.length(p) + len(END) + 1).alias("at"), F.when(mine, F.concat(spans, own)).otherwise(spans).alias("spans"))

    return F.coalesce(F.aggregate(pieces, start, step, lambda s: s.spans), F.array().cast("array<struct<start: int, length: int>>"))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, formatted, loss (spans under the loss mask), escaped (level)."""
    rows = df.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("row"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # one conversation is one value
    convs = convs.select("conv_id", F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("turns"))
    plain = convs.withColumn("formatted", rendered(F.col("turns"), 0))
    same = parsed(F.col("formatted")).eqNullSafe(F.col("turns"))
    tried = plain.withColumn("escaped", F.when(same, 0).otherwise(1)).withColumn("formatted", F.when(F.col("escaped") == 0, F.col("formatted")).otherwise(rendered(F.col("turns"), 1)))
    fine = (F.col("escaped") == 0) | parsed(F.col("formatted")).eqNullSafe(F.col("turns"))
    checked = F.when(fine, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.col("conv_id").cast("string"))).cast("string"))
    return tried.select("conv_id", checked.alias("formatted"), "escaped").withColumn("loss", loss_spans(F.col("formatted")))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations alone."""
    turns = parsed(F.col("formatted"))
    text = F.array_join(F.transform("loss", lambda s: F.substr(F.col("formatted"), s.start + 1, s.length)), "")
    text = F.when(F.startswith("formatted", F.lit("<chat escaped=1>")), _unescape(text)).otherwise(text)
    back = formatted.select("conv_id", turns.alias("turns"), text.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted, written and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.range(2).select(
        F.lit(CLASH_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(CLASH_TEXT).alias("text"),
    )
    return digest(keep(format_conversations(rows.unionByName(clash)), "chat"))


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), levels AS (
  SELECT conv_id, bool_or(contains(text, '</turn>') OR contains(role, '</turn>') OR contains(role, ': ')) AS escaped FROM rows GROUP BY conv_id
), sized AS (
  SELECT r.*, escaped,
         length('### : </turn>' || chr(10)) + CASE WHEN escaped
           THEN length(replace(replace(replace(role, '%', '%25'), '</turn>', '%3C/turn>'), ':', '%3A')) + length(replace(replace(text, '%', '%25'), '</turn>', '%3C/turn>'))
           ELSE length(role) + length(text) END AS chars
  FROM rows r JOIN levels l ON r.conv_id IS NOT DISTINCT FROM l.conv_id
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(length('<chat escaped=0>' || chr(10)) + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

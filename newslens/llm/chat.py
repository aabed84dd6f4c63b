"""Chat formatting from event logs, with DataFrame functions only.

A log has rows (conv_id, seq, message, kind, role, text). ``kind`` is

* ``message``: the message starts with this text (again, if it had begun);
* ``delta``: the text is appended, as streamed pieces are;
* ``edit``: the text takes the place of what the message said so far;
* ``regenerate``: the message starts again with this text, and what later
  messages had been logged by then is void.

*Fold.* Events meet per (conversation, message), so a long conversation is spread over
tasks while its pieces are put together. Within a message they are sorted by
``seq``; the last event that is not a delta begins the final text and the
deltas after it follow. A running maximum over earlier messages' regenerations says
which events are void.

*Render.* A turn is ``<|im_start|>role`` NEWLINE ``text<|im_end|>`` NEWLINE. In roles and texts
a backslash is doubled and ``<|`` becomes ``<\\|``, so that no text can hold a control
string; in roles a line break becomes ``\\n``. The result carries the code point spans of the
(escaped) texts of assistants: the loss mask.

*Read back.* The output string alone is split at turn ends and unescaped, and the
mask's spans are cut from it, turn by turn.

Cases: a null text or role is empty. Null ids are one conversation. Events equal in
conversation, message and ``seq`` follow each other by kind, text and role; each counts. A delta without a
beginning begins a message. A conversation whose every event is void is left out. An
empty log gives no rows. Other columns are not read. One conversation's output is one cell, which
Spark holds in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import stored, table

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped`` (and of a role's line breaks): pairs of backslashes first, from the left."""

    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the conversations as they ended."""
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    by_message = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    live = by_message.withColumn("void", F.max("again").over(earlier)).withColumn(
        "log", F.filter("log", lambda e: F.col("void").isNull() | (e.seq > F.col("void")))
    ).where(F.size("log") > 0)
    begins = F.array_max(F.transform("log", lambda e, i: F.when(e.kind.eqNullSafe("delta"), F.lit(1)).otherwise(i + 1)))
    return live.withColumn("final", F.slice("log", begins, F.size("log"))).select(
        "conv_id",
        "message",
        F.element_at("log", -1).role.alias("role"),
        F.array_join(F.transform("final", lambda e: e.text), "").alias("text"),
    )


def render(messages: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans): one string per conversation, and its mask as [begin, end) code points."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "message", (F.col("role") == learned).alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    turn = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("turn", turn).withColumn(
        "begin", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    )
    span = F.struct(F.col("begin").alias("begin"), (F.col("begin") + F.length("body")).alias("end"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message", "turn"))), lambda t: t.turn), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), span))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, at, role, text, learned_text) per turn, from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split("formatted", F.lit(r"(?<=<\|im_end\|>\n)"))
    turns = formatted.select("conv_id", F.posexplode(pieces).alias("at", "turn")).where("turn <> ''")
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    line = F.locate("\n", F.col("turn"))
    cut = turns.select(
        "conv_id",
        "at",
        "turn",
        (F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + line).alias("begin"),
        line.alias("line"),
    )
    spans = formatted.select(F.col("conv_id").alias("s_conv"), F.explode("loss_spans").alias("span")).select("s_conv", "span.*")
    spans = spans.withColumnsRenamed({"begin": "s_begin", "end": "s_end"})
    met = cut.join(spans, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("begin") == F.col("s_begin")), "left")
    role = F.expr(f"substring(turn, {len(START) + 1}, line - {len(START) + 1})")
    text = F.expr(f"substring(turn, line + 1, length(turn) - line - {len(END)})")
    learned = F.expr("substring(turn, line + 1, s_end - s_begin)")
    return met.select("conv_id", "at", unescaped(role).alias("role"), unescaped(text).alias("text"), unescaped(learned).alias("learned_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns and masked text as read back from the output."""
    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n"))

    def joined(value: Column) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("at", value.alias("v")))))
        return F.array_join(F.transform(ordered, lambda t: t.v), "")

    read = read_back(formatted).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), joined(turn).alias("turns"), joined(F.col("learned_text")).alias("learned")
    )
    whole = formatted.select(F.col("conv_id").alias("f_conv"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.join(whole, F.col("conv_id").eqNullSafe(F.col("f_conv"))).select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as one message, in the order of turns."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.row_number().over(in_order).alias("seq"), "role", "text").select(
        "conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql(
        "SELECT -1L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    messages = fold_events(turns_as_events(rows.unionByName(hard)))
    return digests(stored(render(messages), "chat"))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

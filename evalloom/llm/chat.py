"""Chat formatting from an event log, in Spark expressions only.

Events of a conversation, in sequence, are folded into final messages: ``delta`` appends to its message,
``edit`` replaces the message's text, ``regenerate`` starts it anew and retracts all messages opened
after it and before the regeneration. Messages are rendered with control strings around each turn; texts
and roles have theirs escaped so that the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """``<|`` cannot occur: each ``<``, backslashes, ``|`` gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """One line: backslash becomes \\s, a line break \\n, then as in texts."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, opened, role, text): the final messages of a log of (conversation, seq, message, kind, role, text).

    Events of one sequence number go by message, kind and text. A message takes the role of its first
    event that has one. Null text is empty, a null role becomes the empty role, null conversations are one
    conversation, an unknown kind is an error. A repeated delta is appended twice, since a log may well say
    the same twice. One shuffle, on the conversation, serves all steps.
    """
    known = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    events = events.select(F.col(conversation).alias("c"), "seq", "message", known.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = events.withColumn("at", F.row_number().over(W.partitionBy("c").orderBy("seq", "message", "kind", "text")))
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    reset = F.max(F.when(F.col("kind") != "delta", F.col("at")))
    messages = placed.groupBy("c", "message").agg(
        F.min("at").alias("opened"), F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"), parts.alias("parts"), reset.alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("renewed"),
    )
    live = F.filter("parts", lambda p: p.at >= F.coalesce("reset", F.lit(0)))
    messages = messages.withColumn("text", F.array_join(F.transform(live, lambda p: p.text), ""))
    earlier = F.max("renewed").over(W.partitionBy("c").orderBy("opened").rowsBetween(W.unboundedPreceding, -1))
    kept = messages.withColumn("cut", earlier).where("cut is null or cut < opened")
    return kept.select(F.col("c").alias(conversation), "opened", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, conversation: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """(conversation, segments): the formatted conversation as (text, loss) segments, in order.

    The segments' texts after one another are the formatted text; ``loss`` marks the texts of ``trained``
    turns, without their control strings. A conversation is one training text, so its turns meet in one row.
    """
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    turns = F.sort_array(F.collect_list(F.struct("opened", "role", "text")))
    grouped = messages.groupBy(conversation).agg(turns.alias("turns"))
    parts = lambda t: F.array(
        segment(F.concat(F.lit(START), escaped_role(t.role), F.lit("\n")), F.lit(False)),
        segment(escaped(t.text), t.role == trained),
        segment(F.lit(f"{END}\n"), F.lit(False)),
    )
    return grouped.select(conversation, F.flatten(F.transform("turns", parts)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text)), "")


def read_back(text: Column) -> Column:
    """(role, text) of every turn of a formatted text."""
    pieces = F.split(text, r"<\|im_start\|>", -1)
    turns = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END) - 1)
    return F.transform(turns, lambda p: F.struct(unescaped_role(role(p)).alias("role"), unescaped(body(p)).alias("text")))


def format_chats(events: DataFrame, conversation: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """The log folded and rendered: one row per conversation that has a message."""
    return render(fold(events, conversation), conversation, trained)


def turn_events(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """An event log of a table of whole turns (conversation, turn, role, text): each text streams in as two deltas.

    Turns of one number go by role and text, each as a message of its own.
    """
    order = W.partitionBy(conversation).orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    deltas = F.posexplode(F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))).alias("part", "piece")
    numbered = turns.select(conversation, "role", "text", F.row_number().over(order).alias("message"))
    return numbered.select(conversation, "message", "role", deltas).select(conversation, (F.col("message") * 2 + F.col("part")).alias("seq"), "message", F.lit("delta").alias("kind"), "role", F.col("piece").alias("text"))

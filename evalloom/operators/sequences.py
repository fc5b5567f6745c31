"""Conversations as text and as id sequences, and padded batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.constants import IGNORE_ID
from evalloom.functions.sequences import ids, repeated, truncate
from evalloom.functions.text import strip


def render_chat(
    turns: DataFrame, system: str = "", seps: tuple[str, str] = ("\n\n", ""), conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", name: str = "rendered",
) -> DataFrame:
    """Ordered turns as ``Role: text`` with alternating separators; an empty turn is an open ``Role:``.

    The result is one string per conversation, so a conversation's text has to
    meet in one place.
    """
    said = F.struct(turn, F.initcap(role).alias("role"), strip(text).alias("text"))
    ordered = turns.groupBy(conv).agg(F.array_sort(F.collect_list(said)).alias("_t"))
    sep = lambda i: F.when(i % 2 == 0, seps[0]).otherwise(seps[1])
    lines = F.transform(
        "_t",
        lambda t, i: F.when(t["text"] == "", F.concat(t["role"], F.lit(":"))).otherwise(
            F.concat(t["role"], F.lit(": "), t["text"], sep(i))
        ),
    )
    head = [F.lit(system + seps[0])] if system else []
    return ordered.select(conv, strip(F.concat(*head, F.array_join(lines, ""))).alias(name))


def encode_turns(
    turns: DataFrame, begin: Sequence[int], end: Sequence[int], conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Ids and labels of whole conversations.

    ``turns`` has input_ids, output_ids (NULL for none), output_with_loss,
    need_eos and sep_ids. A begin id precedes the first turn and every turn
    that follows an end id; loss counts only on outputs flagged with loss and
    their end ids.
    """
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.when(F.col("output_ids").isNotNull(), F.coalesce("need_eos", F.lit(True)))
    opens = F.coalesce(F.last(ended, ignorenulls=True).over(before), F.lit(True))
    step = F.struct(turn, "_opens", "input_ids", "output_ids", "output_with_loss", "need_eos", "sep_ids")
    ordered = turns.withColumn("_opens", opens).groupBy(conv).agg(F.array_sort(F.collect_list(step)).alias("_t"))
    none = F.array().cast("array<int>")

    def block(t: Column) -> Column:
        lead = F.concat(F.when(t["_opens"], ids(begin)).otherwise(none), F.coalesce(t["input_ids"], none))
        has = t["output_ids"].isNotNull()
        close = F.when(F.coalesce(t["need_eos"], F.lit(True)), ids(end)).otherwise(none)
        body = F.when(has, F.concat(t["output_ids"], close)).otherwise(none)
        tail = F.when(has, F.coalesce(t["sep_ids"], none)).otherwise(none)
        learned = F.when(F.coalesce(t["output_with_loss"], F.lit(True)), body).otherwise(repeated(IGNORE_ID, F.size(body)))
        return F.struct(
            F.concat(lead, body, tail).alias("ids"),
            F.concat(repeated(IGNORE_ID, F.size(lead)), learned, repeated(IGNORE_ID, F.size(tail))).alias("labels"),
        )

    return ordered.withColumn("_b", F.transform("_t", block)).select(
        conv, F.flatten(F.transform("_b", lambda b: b["ids"])).alias("input_ids"), F.flatten(F.transform("_b", lambda b: b["labels"])).alias("labels")
    )


def pad_batch(
    df: DataFrame, batch: str, pad: int, side: str = "right", max_len: int | None = None, input_ids: str = "input_ids", labels: str = "labels",
    joined: str | None = None,
) -> DataFrame:
    """Pad to the longest of the batch; labels get the ignore id, the mask marks real ids.

    The longest length is one number per batch, found with map-side partial
    results and joined back, so no batch has to fit in one task. With ``joined``
    the three sequences are texts of their ids with that separator; the padding
    is then repeated as text and never held as ids.
    """
    if side not in ("right", "left"):
        raise ValueError(f"unknown side {side!r}")
    rows = df
    if max_len is not None:
        rows = rows.withColumns({c: truncate(c, max_len) for c in (input_ids, labels)})
    longest = rows.groupBy(batch).agg(F.max(F.size(input_ids)).alias("_n"))
    rows = rows.join(longest, batch).withColumn("_gap", F.col("_n") - F.size(input_ids))

    def fill(c: Column, value: int) -> Column:
        gap = repeated(value, F.col("_gap"))
        return F.concat(c, gap) if side == "right" else F.concat(gap, c)

    def fill_text(c: str, own: Column, value: int) -> Column:
        """``own`` is null where there is no sequence ``c``, and empty where it has no ids."""
        gap = F.when(F.col("_gap") > 0, F.concat(F.repeat(F.lit(f"{value}{joined}"), F.col("_gap") - 1), F.lit(str(value)))).otherwise("")
        between = F.when((F.size(c) > 0) & (F.col("_gap") > 0), joined).otherwise("")
        return F.concat(own, between, gap) if side == "right" else F.concat(gap, between, own)

    if joined is None:
        of_column, mask = lambda c, value: fill(F.col(c), value), fill(repeated(1, F.size(input_ids)), 0)
    else:
        ones = F.concat(F.repeat(F.lit(f"1{joined}"), F.size(input_ids) - 1), F.lit("1"))
        of_column = lambda c, value: fill_text(c, F.array_join(F.col(c).cast("array<string>"), joined), value)
        mask = fill_text(input_ids, F.when(F.size(input_ids) > 0, ones).when(F.col(input_ids).isNotNull(), ""), 0)
    return rows.select(
        *[of_column(c, pad if c == input_ids else IGNORE_ID).alias(c) if c in (input_ids, labels) else F.col(c) for c in df.columns],
        mask.alias("attention_mask"),
    )

"""Queries over id sequences made from the word lengths of the given conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import sequences as Q
from evalloom.operators import sequences
from evalloom.operators.positions import index_by_key
from evalloom.plans.common import okey, registry, table

QUERIES, query = registry()


def shown(c, name):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(name)


def word_ids(c):
    return F.transform(F.split(c, " "), lambda w: F.length(w))


IDS = "list_transform(string_split({0}, ' '), lambda w: length(w)::int)"
TURN_IDS = f"(select conv_id, turn, role, {IDS.format('text')} as ids, {IDS.format('role || chr(32) || conv_id')} as head from conversations)"


def turns(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", word_ids("text").alias("ids"), word_ids(F.concat("role", F.lit(" "), "conv_id")).alias("head")
    )


@query("mask_prompt", f"select conv_id, turn, array_to_string(list_concat(head, ids), ',') as input_ids, array_to_string(list_concat(list_transform(head, lambda x: -100), ids), ',') as labels, len(head)::int as n_prompt, len(ids)::int as n_target from {TURN_IDS}")
def _(spark, sf):
    df = turns(spark, sf).select("conv_id", "turn", Q.mask_prompt("head", "ids").alias("m"))
    return df.select("conv_id", "turn", shown("m.input_ids", "input_ids"), shown("m.labels", "labels"), "m.n_prompt", "m.n_target")


# assistant turns are outputs; every third turn carries no loss, every fifth conversation needs no end id
ENCODE = """select conv_id, turn, head as input_ids, case when role <> 'system' then ids end as output_ids, turn % 3 <> 0 as output_with_loss, conv_id % 5 <> 0 or turn % 2 = 0 as need_eos,
    case when role = 'user' then [7, 7] else []::int[] end as sep_ids from """ + TURN_IDS


@query("encode_turns", f"""with t as ({ENCODE}), o as (select *, coalesce(last_value(case when output_ids is not null then need_eos end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), true) as opens from t),
    b as (select conv_id, turn, list_concat(case when opens then [1] else []::int[] end, input_ids) as lead, case when output_ids is null then []::int[] else list_concat(output_ids, case when need_eos then [2] else []::int[] end) end as body, output_with_loss, case when output_ids is not null then sep_ids else []::int[] end as sep from o),
    f as (select conv_id, turn, list_concat(list_concat(lead, body), sep) as ids, list_concat(list_concat(list_transform(lead, lambda x: -100), case when output_with_loss then body else list_transform(body, lambda x: -100) end), list_transform(sep, lambda x: -100)) as labels from b)
    select conv_id, string_agg(array_to_string(ids, ','), ',' order by turn) as input_ids, string_agg(array_to_string(labels, ','), ',' order by turn) as labels from f group by conv_id""")
def _(spark, sf):
    none = F.array().cast("array<int>")
    t = turns(spark, sf).select(
        "conv_id", "turn", F.col("head").alias("input_ids"), F.when(F.col("role") != "system", F.col("ids")).alias("output_ids"),
        (F.col("turn") % 3 != 0).alias("output_with_loss"), ((F.col("conv_id") % 5 != 0) | (F.col("turn") % 2 == 0)).alias("need_eos"),
        F.when(F.col("role") == "user", Q.ids([7, 7])).otherwise(none).alias("sep_ids"),
    )
    df = sequences.encode_turns(t, [1], [2])
    return df.select("conv_id", shown("input_ids", "input_ids"), shown("labels", "labels"))


@query("truncate", f"select conv_id, turn, array_to_string(ids[1:12], ',') as first_ids, array_to_string(ids[greatest(len(ids) - 12, 0) + 1:], ',') as last_ids from {TURN_IDS}")
def _(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", shown(Q.truncate("ids", 12), "first_ids"), shown(Q.truncate("ids", 12, "left"), "last_ids"))


PAD_SQL = f"""with t as (select doc_id, {IDS.format('text')} as ids, (row_number() over (order by {okey(13, 'doc_id')}) - 1) // 16 as batch from documents),
    m as (select *, max(len(ids)) over (partition by batch) as n from t)
    select doc_id, batch::bigint as batch, {{0}} from m"""
RIGHT = "array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda x: 0)), ',') as input_ids, array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda x: -100)), ',') as labels, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(n - len(ids)), lambda x: 0)), ',') as attention_mask"
LEFT = "array_to_string(list_concat(list_transform(range(n - len(ids)), lambda x: 0), ids), ',') as input_ids, array_to_string(list_concat(list_transform(range(n - len(ids)), lambda x: -100), ids), ',') as labels, array_to_string(list_concat(list_transform(range(n - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)), ',') as attention_mask"


def padded(spark, sf, side, max_len=None):
    d = index_by_key(table(spark, sf, "documents").select("doc_id", "text"), 13, "doc_id")
    d = d.select("doc_id", F.floor(F.col("pos") / 16).alias("batch"), word_ids("text").alias("input_ids")).withColumn("labels", F.col("input_ids"))
    return sequences.pad_batch(d, "batch", 0, side, max_len, joined=",").select("doc_id", "batch", "input_ids", "labels", "attention_mask")


@query("pad_batch_right", PAD_SQL.format(RIGHT))
def _(spark, sf):
    return padded(spark, sf, "right")


@query("pad_batch_left_cut", PAD_SQL.format(LEFT).replace(f"{IDS.format('text')} as ids", f"({IDS.format('text')})[1:64] as ids"))
def _(spark, sf):
    return padded(spark, sf, "left", 64)


@query("mask_before_marker", f"""with t as (select conv_id, turn, list_concat(list_concat(head, [3, 9]), ids) as ids from {TURN_IDS}), p as (select *, list_position(list_transform(range(1, len(ids)), lambda i: ids[i:i + 1] = [3, 9]), true) as found from t)
    select conv_id, turn, array_to_string(list_transform(ids, lambda v, i: case when i <= found + 1 then -100 else v end), ',') as labels from p""")
def _(spark, sf):
    df = turns(spark, sf).withColumn("ids", F.concat("head", Q.ids([3, 9]), "ids"))
    return df.select("conv_id", "turn", shown(Q.mask_before_marker("ids", [3, 9]), "labels"))


@query("swap_terminator", f"select conv_id, turn, array_to_string(ids, ',') || case when conv_id % 3 = 0 then ',-2' else ',-5' end as ids from {TURN_IDS}")
def _(spark, sf):
    df = turns(spark, sf).withColumn("ids", F.concat("ids", Q.ids([-2])))
    return df.select("conv_id", "turn", shown(Q.swap_terminator("ids", F.col("conv_id") % 3 == 0, -2, -5), "ids"))


@query("expand_placeholder", f"select conv_id, turn, array_to_string(flatten(list_transform(ids, lambda v: case when v = 5 then [-1, -9, -9, -9, -3] else [v] end)), ',') as input_ids, len(list_filter(ids, lambda v: v = 5))::int as n_images from {TURN_IDS}")
def _(spark, sf):
    df = turns(spark, sf).select("conv_id", "turn", Q.expand_placeholder("ids", 5, -9, 3, -1, -3).alias("e"))
    return df.select("conv_id", "turn", shown("e.input_ids", "input_ids"), "e.n_images")



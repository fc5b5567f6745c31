"""Queries over joins, shards, merging and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import joins, shards
from evalloom.plans.builders import ATTR_ROWS, PART_MAP
from evalloom.plans.common import derive, duck, okey, permuted, registry, table

QUERIES, query = registry()
ATTRS = joins.ATTRS


FACES = """select concat('face_', lpad(cast(c_custkey as string), greatest(4, length(cast(c_custkey as string))), '0'), '.png') as image_name,
    case when c_custkey % 2 = 0 then 'male' else 'female' end as gender from {customer}"""
NAME_PAIRS = """select lpad(cast(c_custkey as string), greatest(4, length(cast(c_custkey as string))), '0') as id, concat('Mr ', c_name) as name_male, concat('Ms ', c_name) as name_female from {customer}"""


@query("assign_names", """select 'face_' || lpad(c_custkey::varchar, greatest(4, length(c_custkey::varchar))::int, '0') || '.png' as image_name,
    case when c_custkey % 2 = 0 then 'male' else 'female' end as gender, case when c_custkey % 2 = 0 then 'Mr ' else 'Ms ' end || c_name as name from customer""")
def _(spark, sf):
    return joins.assign_names(derive(spark, sf, FACES), derive(spark, sf, NAME_PAIRS))


@query("keep_available", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def _(spark, sf):
    return joins.keep_available(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("remaining", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def _(spark, sf):
    return joins.remaining(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


# graded image and text rows derived from parts; used by the measures too
RIGHT = {"color": "p_partkey % 3 = 0", "pattern": "p_partkey % 2 = 0", "position": "p_partkey % 5 <> 0", "shape": "p_partkey % 7 <> 1"}
IMAGE_ROWS = f"""select concat('image_', split, '_', p_partkey) as sample_id, p_partkey as dataset_index, split, image as prompt, {', '.join(ATTRS)},
    {', '.join('synthetic_' + a for a in ATTRS)}, {', '.join(f"case when {c} then {a} when p_partkey % 4 = 0 then null else 'other' end as grading_detected_{a}" for a, c in RIGHT.items())},
    {', '.join(f"{c} as grading_correct_{a}" for a, c in RIGHT.items())}, {' and '.join(RIGHT.values())} as grading_all_correct from ({ATTR_ROWS})"""
TEXT_ROWS = f"""select type as concept_type, code as concept_value_synthetic, true as is_synthetic_query, length(value) % 2 = 0 as grading_correct from ({PART_MAP}) where length(value) % 5 <> 0
    union all select type, code, false, length(value) % 3 = 0 from ({PART_MAP})"""
CASES = f"""with i as ({duck(IMAGE_ROWS)}), t as (select concept_type, concept_value_synthetic, bool_or(grading_correct) as ok from ({duck(TEXT_ROWS)}) where is_synthetic_query group by all),
    j as (select i.*, {', '.join(f"coalesce((select ok from t where concept_type = '{a}' and concept_value_synthetic = i.synthetic_{a}), false) as text_correct_{a}" for a in ATTRS)} from i)
    select 'run-0' as checkpoint, sample_id, dataset_index, split, prompt, {', '.join(ATTRS)}, {', '.join('synthetic_' + a for a in ATTRS)}, grading_all_correct as image_all_correct,
    {', '.join(f'grading_correct_{a} as image_correct_{a}' for a in ATTRS)}, {', '.join(f'text_correct_{a}' for a in ATTRS)}, {', '.join(f"coalesce(grading_detected_{a}, '-') as detected_{a}" for a in ATTRS)},
    grading_all_correct and not ({' and '.join(f'text_correct_{a}' for a in ATTRS)}) as image_correct_text_wrong,
    concat_ws(',', {', '.join(f"case when grading_correct_{a} and not text_correct_{a} then '{a}' end" for a in ATTRS)}) as image_attr_correct_text_wrong_attrs from j"""


@query("case_table", CASES)
def _(spark, sf):
    df = joins.case_table(derive(spark, sf, IMAGE_ROWS), derive(spark, sf, TEXT_ROWS), "run-0")
    shown = {f"detected_{a}": F.coalesce(f"detected_{a}", F.lit("-")) for a in ATTRS}
    return df.withColumns({**shown, "image_attr_correct_text_wrong_attrs": F.array_join("image_attr_correct_text_wrong_attrs", ",")})


@query("modality_join", """select l_suppkey as run, l_returnflag as attribute, round(avg((l_linestatus = 'F')::int), 9) as image_accuracy, round(avg((l_linenumber < 4)::int), 9) as text_accuracy
    from lineitem group by all""")
def _(spark, sf):
    keys = [F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("attribute")]
    li = table(spark, sf, "lineitem")
    image = li.groupBy(*keys).agg(F.round(F.avg((F.col("l_linestatus") == "F").cast("int")), 9).alias("image_accuracy"))
    text = li.groupBy(*keys).agg(F.round(F.avg((F.col("l_linenumber") < 4).cast("int")), 9).alias("text_accuracy"))
    return joins.modality_join(image, text, ["run", "attribute"])


OLD = "select o_orderkey as id, concat('t', o_custkey) as image_to_text_comparison, concat('i', o_custkey) as image_to_image_comparison from {orders} where o_orderkey % 3 <> 0"
NEW = "select o_orderkey as id, case when o_orderkey % 2 = 0 then 'fresh' end as image_to_text_comparison, case when o_orderkey % 5 = 0 then 'fresh' end as image_to_image_comparison from {orders}"
PARTS = {"text_to_image": "image_to_text_comparison", "image_to_image": "image_to_image_comparison"}


@query("merge_existing", f"""select n.id, coalesce(n.image_to_text_comparison, '-') as image_to_text_comparison,
    coalesce(o.image_to_image_comparison, n.image_to_image_comparison, '-') as image_to_image_comparison from ({duck(NEW)}) n left join ({duck(OLD)}) o using (id)""")
def _(spark, sf):
    df = joins.merge_existing(derive(spark, sf, NEW), derive(spark, sf, OLD), "id", "text_to_image", PARTS)
    return df.select("id", *[F.coalesce(c, F.lit("-")).alias(c) for c in PARTS.values()])


@query("attach_rubric", "select doc_id, lang, coalesce(quality, -1) as quality from documents left join labels using (doc_id)")
def _(spark, sf):
    rubric = table(spark, sf, "labels").select("doc_id", "quality")
    kept, skipped = joins.attach_rubric(table(spark, sf, "documents").select("doc_id", "lang"), rubric, "doc_id")
    return kept.unionByName(skipped.withColumn("quality", F.lit(-1)))


@query("union_with_source", """select s_suppkey as id, s_name as name, '-' as segment, 'supplier' as source from supplier union all select c_custkey, c_name, c_mktsegment, 'customer' from customer""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return joins.union_with_source({"supplier": s, "customer": c}).withColumn("segment", F.coalesce("segment", F.lit("-")))


# ------------------------------------------------------------------ shards
@query("round_robin_shard", "select o_orderkey, ((row_number() over (order by o_orderstatus, o_orderkey) - 1) % 16)::int as shard from orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return shards.round_robin_shard(df, 16, ["o_orderstatus", "o_orderkey"]).select("o_orderkey", "shard")


@query("dedupe_last", """select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_min(event_id, (ts, event_id)) as first_event from events group by 1""")
def _(spark, sf):
    df = shards.dedupe_last(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return df.select("user_id", "event_type", "event_id", F.col("first_seen.event_id").alias("first_event"))


SHARD_RESULTS = """select concat('s', l_orderkey, '.', l_linenumber) as sample_id, case when l_linenumber > 1 then l_returnflag end as split, case when l_linenumber > 2 then l_orderkey end as dataset_index,
    l_partkey, l_extendedprice as price, l_suppkey as shard, l_linestatus as file, l_partkey as line from {lineitem}"""


@query("merge_shards", f"""select sample_id, max(coalesce(split, '-')) as split, max(coalesce(dataset_index, -1)) as dataset_index, max(l_partkey) as l_partkey from (
    select *, row_number() over (partition by sample_id order by shard desc, file desc, line desc, price desc) as rn from ({duck(SHARD_RESULTS)})) where rn = 1 group by sample_id""")
def _(spark, sf):
    rows = derive(spark, sf, SHARD_RESULTS).withColumn("price", F.col("price"))
    df = shards.merge_shards(rows, order=("shard", "file", "line"))
    return df.select("sample_id", F.coalesce("split", F.lit("-")).alias("split"), F.coalesce("dataset_index", F.lit(-1)).alias("dataset_index"), "l_partkey")


DONE = "select concat('o', l_orderkey) as id, l_suppkey as src, min(l_partkey) as answer from {lineitem} where l_suppkey % 2 = 0 group by l_orderkey, l_suppkey union all select concat('x', s_suppkey), s_suppkey, 1 from {supplier}"
PLAN = "select concat('o', o_orderkey) as id, o_orderkey from {orders}"
RECOVER = f"""with p as ({duck(PLAN)}), d as (select id, arg_min(answer, src) as answer from ({duck(DONE)}) where id in (select id from p) group by id),
    r as (select id, o_orderkey, (row_number() over (order by o_orderkey) - 1) % 6 as shard from p where id not in (select id from d))"""


@query("recover_and_split", RECOVER + "select id, answer, -1 as shard from d union all select id, -1, shard from r")
def _(spark, sf):
    done, rest, _ = shards.recover_and_split(derive(spark, sf, PLAN), derive(spark, sf, DONE), 6, "id", ["src"], ["o_orderkey"])
    return done.select("id", "answer", F.lit(-1).cast("long").alias("shard")).unionByName(rest.select("id", F.lit(-1).cast("long").alias("answer"), F.col("shard").cast("long").alias("shard")))


@query("split_manifest", RECOVER + """select (select count(*) from p)::bigint as total_rows, (select count(*) from d)::bigint as recovered_rows, (select count(*) from r)::bigint as remaining_rows,
    6::int as num_residual_shards, (select string_agg(n::varchar, ',' order by s) from (select s, count(shard) as n from range(6) t(s) left join r on s = shard group by s)) as residual_counts""")
def _(spark, sf):
    manifest = shards.recover_and_split(derive(spark, sf, PLAN), derive(spark, sf, DONE), 6, "id", ["src"], ["o_orderkey"])[2]
    return manifest.withColumn("residual_counts", F.array_join(F.transform("residual_counts", lambda n: n.cast("string")), ","))


PLANNED = "select case when doc_id % 3 = 0 then doc_id else -1 - doc_id end as doc_id from {documents}"


@query("check_complete", f"""with plan as ({duck(PLANNED)}) select doc_id, 'missing' as problem from plan where doc_id not in (select doc_id from labels)
    union all select doc_id, 'extra' from labels where doc_id not in (select doc_id from plan)""")
def _(spark, sf):
    return shards.check_complete(derive(spark, sf, PLANNED), table(spark, sf, "labels"), "doc_id")


RETRY = "select event_id, event_type, case when event_type = 'error' then 'timeout' end as grading_error, case when event_type <> 'error' then 'A' end as grading_answer_key from {events}"


@query("retry_failed", "select event_id, event_type, case when event_type = 'error' then 'redo' else 'A' end as state from events")
def _(spark, sf):
    fine, redo = shards.retry_failed(derive(spark, sf, RETRY))
    assert redo.columns == ["event_id", "event_type"]
    return fine.select("event_id", "event_type", F.col("grading_answer_key").alias("state")).unionByName(redo.withColumn("state", F.lit("redo")))


def _stream(src: str, i: int, times: int, offset: int, cycle: int, wanted: int, batch: int) -> str:
    return f"""select (d // {batch} // {times}) * {cycle} + {offset} + (d // {batch}) % {times} as batch, (d % {batch})::int as slot, {i}::int as source, pass::int as pass, id from (
        select d, pass, {permuted('d % n', 'n', f'91-{i}', 'pass')} as r from (select range as d, n, range // n as pass from range({wanted}), (select count(*) as n from ({src}))))
        join (select id, row_number() over (order by {okey(f'91-{i}', 'id')}) - 1 as r from ({src})) using (r)"""


@query("interleave_batches", _stream("select 'c' || c_custkey as id from customer", 0, 2, 0, 3, 27 * 64, 64) + " union all " + _stream("select 's' || s_suppkey as id from supplier", 1, 1, 2, 3, 13 * 64, 64))
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    b = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return shards.interleave_batches([a, b], [2, 1], 64, 40, 91, "id")

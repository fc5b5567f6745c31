"""Queries over projections, filters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import tabular
from evalloom.plans.common import derive, duck, registry, table, u32

QUERIES, query = registry()


@query("single_turn_pairs", """select conv_id, max(case when turn = 0 then text end) as prompt, max(case when turn = 1 then text end) as completion
    from conversations group by conv_id having count(*) = 2 and max(case when turn = 0 then role end) = 'user'
    and max(case when turn = 1 then role end) = 'assistant'""")
def _(spark, sf):
    return tabular.single_turn_pairs(table(spark, sf, "conversations"), first_role="user", second_role="assistant")


@query("select_contract", "select doc_id, text as prompt, source as image from documents")
def _(spark, sf):
    df = table(spark, sf, "documents").withColumnsRenamed({"text": "prompt", "source": "image"})
    return tabular.select_contract(df, ["doc_id", "prompt", "image"])


IMAGE_ROWS = """select event_id, case when event_id % 11 <> 0 then concat('i', user_id) end as image_1,
    case when event_id % 3 = 0 then concat('j', user_id) end as image_2, case when event_id % 7 = 0 then concat('k', user_id) end as image_3,
    case when event_type = 'view' then 'open' else 'multiple-choice' end as question_type from {events}"""


@query("filter_single_image_mc", f"""select event_id, image_1 as image, question_type from ({duck(IMAGE_ROWS)})
    where image_1 is not null and image_2 is null and image_3 is null and question_type = 'multiple-choice'""")
def _(spark, sf):
    return tabular.filter_single_image_mc(derive(spark, sf, IMAGE_ROWS), 3)


SIZES = "select o_orderkey, cast(o_orderkey * 7 % 900 as int) as width, cast(o_custkey * 13 % 700 as int) as height from {orders}"


@query("filter_image_geometry", f"""select * from ({duck(SIZES)}) where width > 8 and height > 8
    and width / height > 0.1 and width / height < 10""")
def _(spark, sf):
    return tabular.filter_image_geometry(derive(spark, sf, SIZES))


BOXES = SIZES.replace("from {orders}", """, cast(o_orderkey % 50 as int) as rx, cast(o_custkey % 40 as int) as ry,
    cast(100 + o_orderkey % 30 as int) as rw, cast(100 + o_custkey % 60 as int) as rh from {orders} where o_orderkey * 7 % 900 > 8 and o_custkey * 13 % 700 > 8""")
PLAN = ["o_orderkey", "crop_left", "crop_top", "crop_right", "crop_bottom", "target_width", "target_height"]


@query("crop_plan_shorter_side", f"""select o_orderkey, 0.0::double as crop_left, 0.0::double as crop_top, width::double as crop_right, height::double as crop_bottom,
    round_even(width * (512.0::double / least(width, height)), 0)::int as target_width,
    round_even(height * (512.0::double / least(width, height)), 0)::int as target_height from ({duck(BOXES)})""")
def _(spark, sf):
    return tabular.crop_resize_plan(derive(spark, sf, BOXES), "shorter_side", 512).select(PLAN)


@query("crop_plan_center_square", f"""select o_orderkey, rx + (rw - least(rw, rh)) / 2.0::double as crop_left, ry + (rh - least(rw, rh)) / 2.0::double as crop_top,
    rx + (rw - least(rw, rh)) / 2.0::double + least(rw, rh) as crop_right, ry + (rh - least(rw, rh)) / 2.0::double + least(rw, rh) as crop_bottom,
    384::int as target_width, 384::int as target_height from ({duck(BOXES)})""")
def _(spark, sf):
    return tabular.crop_resize_plan(derive(spark, sf, BOXES), "center_square", 384, roi=["rx", "ry", "rw", "rh"]).select(PLAN)


@query("crop_plan_random_square", f"""with d as (select *, {u32(8, 'o_orderkey')} % (abs(width - height) + 1) as draw, least(width, height) as side from ({duck(BOXES)})),
    o as (select *, case when width > height then draw else 0 end as l, case when width > height then 0 else draw end as t from d)
    select o_orderkey, l::double as crop_left, t::double as crop_top, (l + side)::double as crop_right, (t + side)::double as crop_bottom,
    256::int as target_width, 256::int as target_height from o""")
def _(spark, sf):
    return tabular.crop_resize_plan(derive(spark, sf, BOXES), "random_square", 256, seed=8, key="o_orderkey").select(PLAN)


CAPTIONS = """select p_partkey, case when p_partkey % 6 = 0 then concat(p_name, ' Widget') when p_partkey % 6 = 1 then concat('Widget and widget ', p_name)
    else concat('A Widget for ', p_type) end as caption from {part}"""


@query("replace_term", f"""select p_partkey, case when contains(caption, 'Widget') and not contains(lower(replace(caption, 'Widget', 'Gizmo')), 'widget')
    then replace(caption, 'Widget', 'Gizmo') else caption end as caption,
    case when not contains(caption, 'Widget') then 'absent' when contains(lower(replace(caption, 'Widget', 'Gizmo')), 'widget') then 'remains' else 'none' end as violation
    from ({duck(CAPTIONS)})""")
def _(spark, sf):
    good, bad = tabular.replace_term(derive(spark, sf, CAPTIONS), "caption", "Widget", "Gizmo")
    return good.withColumn("violation", F.lit("none")).unionByName(bad)


@query("flatten_record", """select concat('face_', lpad(c_custkey::varchar, 4, '0'), '.png') as image_name,
    coalesce(case when c_custkey % 3 = 0 then c_name end, case when c_custkey % 3 = 1 then concat('nested ', c_name) end, 'Unknown') as name,
    c_mktsegment as hair_color, (c_nationkey % 4)::varchar as eye_color, (c_custkey % 6)::varchar as s_skin_tone, (c_custkey % 5)::varchar as s_face_shape from customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    secondary = F.struct((F.col("c_custkey") % 6).cast("string").alias("skin_tone"), (F.col("c_custkey") % 5).cast("string").alias("face_shape"))
    attributes = F.struct(
        F.col("c_mktsegment").alias("hair_color"), (F.col("c_nationkey") % 4).cast("string").alias("eye_color"),
        F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("nested "), "c_name")).alias("name"), secondary.alias("secondary_attributes"),
    )
    image = F.concat(F.lit("face_"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit(".png")).alias("image_name")
    docs = c.select(image, F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), attributes.alias("attributes"))
    return tabular.flatten_record(docs)


@query("limit_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def _(spark, sf):
    return tabular.limit_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, [F.col("o_totalprice").desc(), "o_orderkey"])


@query("prefix_columns", "select event_id, event_type as grading_event_type, value as grading_value from events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    return tabular.prefix_columns(df, "grading_", ["event_type", "value"])


@query("forbid_substring", "select item_id, contains(text, chr(10)) as violation from benchmark union all select -1 - doc_id, contains(text, 'license') from documents")
def _(spark, sf):
    def both(df, col, marker):
        good, bad = tabular.forbid_substring(df, col, marker)
        return good.withColumn("violation", F.lit(False)).unionByName(bad.withColumn("violation", F.lit(True)))

    items = both(table(spark, sf, "benchmark"), "text", "\n").select("item_id", "violation")
    docs = both(table(spark, sf, "documents"), "text", "license").select((-1 - F.col("doc_id")).alias("item_id"), "violation")
    return items.unionByName(docs)


@query("passthrough_prompt", "select c_name as prompt, c_custkey, c_name, c_mktsegment from customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").alias("image"))
    return tabular.passthrough_prompt(df, "c_name")


@query("filter_by_ids", "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)")
def _(spark, sf):
    ids = derive(spark, sf, "select concat(' ', doc_id, '  ') as id from {labels} where toxic = 1 union all select '  '")
    df = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "lang")
    return tabular.filter_by_ids(df, ids, "id").drop("id")


@query("filter_splits", "select event_id, event_type from events where event_type in ('click', 'view')")
def _(spark, sf):
    return tabular.filter_splits(table(spark, sf, "events").select("event_id", "event_type"), " click, ,view,", "event_type")


GRADED = """select event_id, user_id % 7 as run, case when event_type = 'error' and event_id % 2 = 0 then concat('failed ', event_id % 3) end as grading_error,
    concat(case when event_id % 3 = 0 then 'Answer: E: ' else 'Answer ' end, event_type) as inference_completion,
    case when event_type <> 'error' then 'A' end as grading_answer_key from {events}"""


@query("gate_errors_report", f"select run, count(*)::bigint as rows, count(grading_error)::bigint as errors from ({duck(GRADED)}) group by run")
def _(spark, sf):
    return tabular.gate_errors(derive(spark, sf, GRADED), "run", "report")


@query("gate_errors_drop", f"select event_id, run from ({duck(GRADED)}) where grading_error is null")
def _(spark, sf):
    return tabular.gate_errors(derive(spark, sf, GRADED), "run", "drop").select("event_id", "run")


@query("patch_known_rows", f"""with h as (select *, grading_error is not null and run in (0, 2) and starts_with(inference_completion, 'Answer: E: ') as hit from ({duck(GRADED)}))
    select event_id, case when hit then 'E' else coalesce(grading_answer_key, '-') end as grading_answer_key,
    coalesce(case when not hit then grading_error end, '-') as grading_error from h""")
def _(spark, sf):
    patches = derive(spark, sf, "select distinct user_id % 7 as run, 'Answer: E: ' as prefix, 'E' as value from {events} where user_id % 7 in (0, 2)")
    df = tabular.patch_known_rows(derive(spark, sf, GRADED), patches, "run", "inference_completion", "grading_answer_key")
    return df.select("event_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("grading_answer_key", "grading_error")])

"""Queries over graders, pixel measurements and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import detections, grading, images
from evalloom.plans.common import derive, duck, registry, scratch, stripped, table

QUERIES, query = registry()


def filled(df, *cols):
    return df.withColumns({c: F.coalesce(c, F.lit("-")) for c in cols})


ANSWERS = """select o_orderkey, concat_ws('|', 'red ring', o_orderpriority, 'blue bolt', concat('cust ', o_custkey)) as opts, substr('ABCD', cast(o_orderkey % 4 + 1 as int), 1) as expected_key,
    case o_orderkey % 10 when 0 then ' a ' when 1 then concat('B', chr(10)) when 2 then 'E' when 3 then 'The answer is C.' when 4 then 'I think Blue-Bolt is right'
    when 5 then 'A or B' when 6 then '' when 7 then concat('a star? ', o_orderstatus) when 8 then concat('it is cust ', o_custkey, ' surely') else concat(o_orderpriority, ' and red ring') end as inference_completion from {orders}"""
STRICT = f"""select o_orderkey, case when length(c) = 1 and ascii(upper(c)) - 65 between 0 and 3 then upper(c) else '-' end as grading_answer_key,
    length(c) = 1 and ascii(upper(c)) - 65 between 0 and 3 as grading_format_correct, case when length(c) = 1 and not (ascii(upper(c)) - 65 between 0 and 3) then 'Invalid option: ' || upper(c) else '-' end as grading_format_error,
    length(c) <> 1 as needs_judge from (select *, {stripped('inference_completion')} as c from ({duck(ANSWERS)}))"""


def answers(spark, sf):
    return derive(spark, sf, ANSWERS).withColumn("options", F.split("opts", r"\|")).drop("opts")


@query("grade_letter_strict", STRICT)
def _(spark, sf):
    df = grading.grade_letter_strict(answers(spark, sf))
    return filled(df, "grading_answer_key", "grading_format_error").select(
        "o_orderkey", "grading_answer_key", "grading_format_correct", "grading_format_error", "needs_judge"
    )


def lenient_sql(src: str, key: str) -> str:
    """``src`` gives key, opts (text with |), expected_key, inference_completion."""
    norm = "regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g')"
    return f"""with a as (select *, {stripped('inference_completion')} as raw, string_split(opts, '|') as o from ({src})),
        t as (select *, upper(raw) as up, list_distinct(list_filter(regexp_split_to_array(upper(raw), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z]$') and ascii(w) - 65 < len(o))) as letters,
            list_filter(list_transform(o, lambda v, i: case when {stripped(norm.format('v'))} <> '' and contains(' ' || {norm.format('raw')} || ' ', ' ' || {stripped(norm.format('v'))} || ' ') then chr((64 + i)::int) end), lambda x: x is not null) as hits from a),
        k as (select *, length(raw) = 1 and ascii(up) - 65 between 0 and len(o) - 1 as exact from t),
        g as (select *, case when exact then up when len(letters) = 1 then letters[1] when len(hits) = 1 then hits[1] end as answer from k)
        select {key}, coalesce(answer, '-') as grading_answer_key, exact as grading_format_correct, case when exact then '-' when len(letters) = 1 then '{grading.FROM_LETTER}'
            when len(hits) = 1 then '{grading.FROM_TEXT}' else '{grading.UNCLEAR}' end as grading_format_error, coalesce(answer = expected_key, false) as grading_correct from g"""


TEXT_ANSWERS = """select doc_id, concat_ws('|', 'the thed', 'la elle', 'onen', lang, 'in') as opts, 'E' as expected_key, text as inference_completion from {documents}"""


@query("grade_letter_lenient", lenient_sql(duck(ANSWERS), "o_orderkey"))
def _(spark, sf):
    df = grading.grade_letter_lenient(answers(spark, sf))
    return filled(df, "grading_answer_key", "grading_format_error").drop("options", "expected_key", "inference_completion")


@query("grade_letter_lenient_texts", lenient_sql(duck(TEXT_ANSWERS), "doc_id"))
def _(spark, sf):
    df = derive(spark, sf, TEXT_ANSWERS).withColumn("options", F.split("opts", r"\|")).drop("opts")
    df = grading.grade_letter_lenient(df)
    return filled(df, "grading_answer_key", "grading_format_error").drop("options", "expected_key", "inference_completion")


# ---------------------------------------------------------- judge verdicts
VERDICTS = """select o_orderkey, case o_orderkey % 11
    when 0 then '<"answer_key": "B", "format_error": null>' when 1 then '<"answer_key": null, "format_error": "two answers">' when 2 then '<"answer_key": null, "format_error": null>'
    when 3 then '<"answer_key": "A", "format_error": "both">' when 4 then '<"answer_key": "E", "format_error": null>' when 5 then '<"answer_key": "AB", "format_error": null>'
    when 6 then '<"answer_key": "A", "format_error": null, "extra": 1>' when 7 then '<"answer_key": "A">' when 8 then 'I say A' when 9 then '<"answer_key": 1, "format_error": null>'
    else '<"answer_key": "D", "format_error": null>' end as raw from {orders}"""
TO_BRACES = "replace(replace(raw, '<', chr(123)), '>', chr(125))"


@query("parse_mc_verdict", f"""with v as (select o_orderkey, {TO_BRACES} as j from ({duck(VERDICTS)})),
    p as (select *, json_valid(j) as ok, case when json_valid(j) then json_keys(j) end as ks, case when json_valid(j) then json_type(j, '$.answer_key') end as kt, case when json_valid(j) then json_extract_string(j, '$.answer_key') end as k,
        case when json_valid(j) then json_extract_string(j, '$.format_error') end as e from v),
    r as (select *, case when not ok then 'not a JSON object' when len(ks) <> 2 or not list_has_all(ks, ['answer_key', 'format_error']) then 'invalid verdict keys' when k is null and e is null then 'no verdict values'
        when kt not in ('VARCHAR', 'NULL') then 'invalid verdict types' when k is not null and not (length(k) = 1 and ascii(k) - 65 between 0 and 3) then 'invalid answer key' when k is not null and e is not null then 'both verdict values set' else '-' end as err from p)
    select o_orderkey, case when err = '-' then coalesce(k, '-') else '-' end as grading_answer_key, case when err = '-' then coalesce(e, '-') else '-' end as grading_format_error, false as grading_format_correct, err as grading_error from r""")
def _(spark, sf):
    df = derive(spark, sf, VERDICTS).selectExpr("o_orderkey", f"{TO_BRACES} as verdict", "array('a', 'b', 'c', 'd') as options")
    df = grading.parse_mc_verdict(df, "verdict").drop("verdict", "options")
    return filled(df, "grading_answer_key", "grading_format_error", "grading_error")


VOCAB = {"status": {"f_done": "finished", "o_open": "open", "p_wait": "pending"}, "level": {"hi": "high level", "lo": "low level"}}
ATTRIBUTES = """select o_orderkey, concat('<"status": ', case o_orderkey % 5 when 0 then '"finished"' when 1 then '"`open`"' when 2 then 'null' when 3 then '"pending"' else '"closed"' end,
    case when o_orderkey % 7 = 0 then '' else concat(', "level": ', case when o_custkey % 2 = 0 then '"high level"' else 'null' end) end, case when o_orderkey % 13 = 0 then ', "more": "x"' else '' end, '>') as raw from {orders}"""


@query("parse_attribute_verdict", f"""select o_orderkey, case when o_orderkey % 7 = 0 or o_orderkey % 13 = 0 then 'invalid attribute keys' when o_orderkey % 5 = 4 then 'Invalid attribute value: closed' else '-' end as grading_error,
    case when o_orderkey % 7 = 0 or o_orderkey % 13 = 0 or o_orderkey % 5 = 4 then '-' else concat_ws(',', 'status=' || (['f_done', 'o_open', '-', 'p_wait'])[o_orderkey % 5 + 1], 'level=' || case when o_custkey % 2 = 0 then 'hi' else '-' end) end as attributes
    from ({duck(ATTRIBUTES).replace('select o_orderkey,', 'select o_orderkey, o_custkey,')})""")
def _(spark, sf):
    df = derive(spark, sf, ATTRIBUTES).selectExpr("o_orderkey", f"{TO_BRACES} as verdict")
    df = grading.parse_attribute_verdict(df, "verdict", VOCAB)
    shown = F.concat_ws(",", *[F.concat(F.lit(f"{a}="), F.coalesce(F.col("grading_inferred_attributes")[a], F.lit("-"))) for a in VOCAB])
    attributes = F.when(F.col("grading_inferred_attributes").isNull(), "-").otherwise(shown)
    return df.select("o_orderkey", F.coalesce("grading_error", F.lit("-")).alias("grading_error"), attributes.alias("attributes"))


ENUMS = """select event_id, case when event_type = 'error' then 'no verdict' when event_type = 'view' then '<"verdict": "maybe">' else concat('<"verdict": "', case when event_id % 3 = 0 then 'positive' when event_id % 3 = 1 then 'negative' else 'partial' end, '">') end as raw from {events}"""


@query("parse_enum_verdict", """select event_id, case when event_type in ('error', 'view') then '-' else (['positive', 'negative', 'partial'])[event_id % 3 + 1] end as grading_verdict,
    case when event_type = 'error' then 'Failed to parse judge verdict: no value' when event_type = 'view' then 'Failed to parse judge verdict: maybe' else '-' end as grading_error from events""")
def _(spark, sf):
    df = derive(spark, sf, ENUMS).selectExpr("event_id", f"{TO_BRACES} as verdict")
    return filled(grading.parse_enum_verdict(df, "verdict").drop("verdict"), "grading_verdict", "grading_error")


SCORES = """select doc_id, case doc_id % 6 when 0 then null when 1 then concat('No JSON here: ', text) when 2 then '<"textual_analysis": "x">'
    else concat('Sure! <"textual_analysis": "', replace(text, '"', ''''), '", "scores": <"present_and_accurate": ', doc_id % 10, '.5>> Done.') end as raw from {documents}"""


@query("parse_judge_scores", """select doc_id, case doc_id % 6 when 0 then 'no response' when 1 then 'response is not a JSON object' when 2 then 'Invalid response structure: {"textual_analysis": "x"}' else replace(text, '"', '''') end as textual_analysis,
    case when doc_id % 6 < 3 then 0.0::double else doc_id % 10 + 0.5::double end as score, doc_id % 6 < 3 as failed from documents""")
def _(spark, sf):
    df = derive(spark, sf, SCORES).selectExpr("doc_id", f"{TO_BRACES} as response")
    df = grading.parse_judge_scores(df, "response")
    return df.select("doc_id", "comparison.textual_analysis", F.col("comparison.scores")["present_and_accurate"].alias("score"), "comparison.failed")


@query("match_attributes", """select event_id, event_type = case when event_id % 2 = 0 then event_type else 'view' end as grading_correct_kind, (case when event_id % 3 = 0 then null else user_id end) is not distinct from (case when event_id % 6 = 0 then null else user_id end) as grading_correct_user,
    event_type = case when event_id % 2 = 0 then event_type else 'view' end and (case when event_id % 3 = 0 then null else user_id end) is not distinct from (case when event_id % 6 = 0 then null else user_id end) as grading_all_correct from events""")
def _(spark, sf):
    df = derive(spark, sf, """select event_id, event_type as kind, case when event_id % 2 = 0 then event_type else 'view' end as grading_detected_kind,
        case when event_id % 3 = 0 then null else user_id end as user, case when event_id % 6 = 0 then null else user_id end as grading_detected_user from {events}""")
    return grading.match_attributes(df, ["kind", "user"]).select("event_id", "grading_correct_kind", "grading_correct_user", "grading_all_correct")


def _first_letter(row: dict) -> dict:
    text = row["inference_completion"].strip()
    if not text:
        raise ValueError("empty answer")
    return {"judge_key": text[0].upper()}


@query("with_judge", f"""select o_orderkey, case when c = '' then '-' else upper(substr(c, 1, 1)) end as judge_key, case when c = '' then 'Failed to query judge: empty answer' else '-' end as grading_error
    from (select o_orderkey, {stripped('inference_completion')} as c from ({duck(ANSWERS)}))""")
def _(spark, sf):
    df = derive(spark, sf, ANSWERS).select("o_orderkey", "inference_completion")
    judged = grading.with_judge(df, _first_letter, "judge_key string", 4)
    return filled(judged, "judge_key", "grading_error").drop("inference_completion")


@query("judge_with_ledger", f"""select o_orderkey, case when c = '' then '-' else upper(substr(c, 1, 1)) end as judge_key, case when c = '' then 'Failed to query judge: empty answer' else '-' end as grading_error
    from (select o_orderkey, {stripped('inference_completion')} as c from ({duck(ANSWERS)}))""")
def _(spark, sf):
    """Half of the rows are judged by a first start; the second one calls the rest and joins both."""
    df, ledger = derive(spark, sf, ANSWERS).select("o_orderkey", "inference_completion"), scratch(spark)
    grading.judge_with_ledger(df.filter("o_orderkey % 2 = 0"), "o_orderkey", _first_letter, "judge_key string", ledger, parts=2)
    judged = grading.judge_with_ledger(df, "o_orderkey", _first_letter, "judge_key string", ledger, parts=2, max_in_flight=4)
    return filled(judged, "judge_key", "grading_error").drop("inference_completion")


# ------------------------------------------------------------------ pixels
TINTS = ["0000ff", "00ff00", "ff0000", "00ffff", "ff00ff", "ffff00", "202020"]  # blue-green-red order
TINT_NAMES = ["red", "green", "blue", "yellow", "purple", "turquoise", "-"]


@query("detect_color", f"select p_partkey, list_extract({TINT_NAMES}, (p_partkey % 7 + 1)::int) as color, '-' as error from part")
def _(spark, sf):
    tint = F.element_at(F.array(*[F.lit(t) for t in TINTS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    pixels = F.unhex(F.concat(F.repeat(tint, F.lit(40)), F.repeat(F.lit("ffffff"), F.lit(24))))
    df = table(spark, sf, "part").select("p_partkey", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), pixels.alias("data"))
    found = images.run_detectors(df, {"color": images.detect_color})
    return filled(found, "grading_detected_color", "grading_error_color").withColumnsRenamed({"grading_detected_color": "color", "grading_error_color": "error"})


@query("detect_position", "select s_suppkey, (['top left', 'top right', 'bottom left', 'bottom right', '-'])[s_suppkey % 5 + 1] as position from supplier")
def _(spark, sf):
    def row(left: int):
        return F.concat(F.repeat(F.lit("ffffff"), F.lit(left)), F.repeat(F.lit("000000"), F.lit(24)), F.repeat(F.lit("ffffff"), F.lit(40 - left)))

    place = F.col("s_suppkey") % 5
    square = F.repeat(F.when(place % 2 == 0, row(4)).otherwise(row(36)), F.lit(24))
    blank = F.repeat(F.lit("ffffff"), F.lit(64))
    upper = F.concat(F.repeat(blank, F.lit(4)), square, F.repeat(blank, F.lit(36)))
    lower = F.concat(F.repeat(blank, F.lit(36)), square, F.repeat(blank, F.lit(4)))
    pixels = F.when(place < 2, upper).when(place < 4, lower).otherwise(F.repeat(blank, F.lit(64)))
    df = table(spark, sf, "supplier").select("s_suppkey", F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(3).alias("channels"), F.unhex(pixels).alias("data"))
    found = images.run_detectors(df, {"position": images.detect_position})
    return found.select("s_suppkey", F.coalesce("grading_detected_position", F.lit("-")).alias("position"))


# -------------------------------------------------------------- detections
def _component(i: int, spark_side: bool) -> str:
    return f"cast(embedding[{'4 * k + %d' % i if spark_side else '(4 * k + %d)::int' % (i + 1)}] as double)"


def _boxes(spark_side: bool) -> str:
    c = [_component(i, spark_side) for i in range(4)]
    source = "(select *, explode(sequence(0, 15)) as k from {embeddings})" if spark_side else "(select *, unnest(range(16)) as k from embeddings)"
    return f"""select vec_id * 16 + k as det_id, cast(floor(vec_id / 10) as bigint) as image_id, concat('c', label % 4) as class, abs({c[0]}) * 5 as score, ({c[1]} + 1) * 100 as x0, ({c[2]} + 1) * 100 as y0,
        ({c[1]} + 1) * 100 + 20 + abs({c[3]}) * 100 as x1, ({c[2]} + 1) * 100 + 20 + abs({c[0]}) * 100 as y1, case k % 4 when 0 then 'red' when 1 then 'blue' when 2 then 'green' else 'brown' end as color from {source}"""


RANKED = f"""select *, row_number() over (partition by image_id, class order by score desc, det_id) as rank from ({_boxes(False)}) where score > case when image_id % 2 = 0 then 0.9::double else 0.3::double end qualify rank <= 16"""


def boxes(spark, sf):
    return derive(spark, sf, _boxes(True))


@query("filter_detections", f"select det_id, image_id, class, round(score, 9) as score, rank::int as rank from ({RANKED})")
def _(spark, sf):
    det = detections.filter_detections(boxes(spark, sf), F.col("image_id") % 2 == 0)
    return det.select("det_id", "image_id", "class", F.round("score", 9).alias("score"), "rank")


def area(b: dict) -> str:
    return f"(greatest({b['x1']} - {b['x0']} + 1, 0) * greatest({b['y1']} - {b['y0']} + 1, 0))"


def iou(a: str, b: str) -> str:
    fa, fb = ({k: f"{n}.{k}" for k in ("x0", "y0", "x1", "y1")} for n in (a, b))
    both = {k: f"{'greatest' if k in ('x0', 'y0') else 'least'}({a}.{k}, {b}.{k})" for k in fa}
    return f"coalesce({area(both)} / nullif({area(fa)} + {area(fb)} - {area(both)}, 0), 0)"


LISTS = f"select image_id, class, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, det_id := det_id, color := color) order by rank) as bs from ({RANKED}) group by all"


@query("suppress_overlaps", f"""with recursive g as ({LISTS}), s as (select image_id, class, bs, 1 as i, bs[1:0] as kept from g
    union all select image_id, class, bs, i + 1, case when len(list_filter(kept, lambda k: {iou('k', 'bs[i]')} >= 0.4)) > 0 then kept else list_append(kept, bs[i]) end from s where i <= len(bs))
    select image_id, class, unnest(list_transform(kept, lambda b: b.det_id)) as det_id from s where i > len(bs)""")
def _(spark, sf):
    det = detections.filter_detections(boxes(spark, sf), F.col("image_id") % 2 == 0)
    return detections.suppress_overlaps(det, 0.4).select("image_id", "class", "det_id")


def relation(a: str, b: str) -> str:
    """List of relations of two box structs."""

    def axis(lo: str, hi: str) -> tuple[str, str]:
        o = f"(({a}.{lo} + {a}.{hi}) / 2 - ({b}.{lo} + {b}.{hi}) / 2)"
        return o, f"(greatest(abs({o}) - 0.1::double * (abs({a}.{hi} - {a}.{lo}) + abs({b}.{hi} - {b}.{lo})), 0) * sign({o}))"

    (ox, rx), (oy, ry) = axis("x0", "x1"), axis("y0", "y1")
    norm = f"nullif(sqrt({ox} * {ox} + {oy} * {oy}), 0)"
    parts = [(f"{rx} / {norm} < -0.5", "left of"), (f"{rx} / {norm} > 0.5", "right of"), (f"{ry} / {norm} < -0.5", "above"), (f"{ry} / {norm} > 0.5", "below")]
    cells = ", ".join(f"case when {c} then '{n}' end" for c, n in parts)
    return f"case when abs({rx}) < 1e-3 and abs({ry}) < 1e-3 then []::varchar[] else list_filter([{cells}], lambda x: x is not null) end"


PAIR_SQL = f"""with b as (select *, row_number() over (order by det_id) - 1 as i from ({_boxes(False)})),
    p as (select a.det_id, struct_pack(x0 := a.x0, y0 := a.y0, x1 := a.x1, y1 := a.y1) as p, struct_pack(x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1) as q from b a join b c on c.det_id = a.det_id + 1)
    select det_id, array_to_string({relation('p', 'q')}, ',') as relations from p"""


@query("relative_position", PAIR_SQL)
def _(spark, sf):
    cols = ["x0", "y0", "x1", "y1"]
    b = boxes(spark, sf).select("det_id", F.struct(*cols).alias("p"))
    after = b.select((F.col("det_id") - 1).alias("det_id"), F.col("p").alias("q"))
    rel = detections.relative_position(F.col("p"), F.col("q"))
    return b.join(after, "det_id").select("det_id", F.array_join(rel, ",").alias("relations"))


SPECS = """select distinct cast(floor(vec_id / 10) as bigint) as image_id from {embeddings}"""


@query("grade_compositional", f"""with l as ({LISTS}), s as ({duck(SPECS)}),
    i as (select s.image_id, 'c' || s.image_id % 4 as k1, 2 + s.image_id % 9 as n1, case when s.image_id % 3 = 0 then 'red' end as col, 'c' || (s.image_id + 1) % 4 as k2, (['left of', 'right of', 'above', 'below'])[s.image_id % 4 + 1] as rel, s.image_id % 2 = 0 as placed, 'c' || (s.image_id + 2) % 4 as k3, 12 as n3, s.image_id % 5 <> 0 as excl from s),
    f as (select i.*, coalesce(a.bs[1:n1], []) as b1, coalesce(b.bs[1:1], []) as b2, coalesce(c.bs, []) as b3 from i left join l a on a.image_id = i.image_id and a.class = k1 left join l b on b.image_id = i.image_id and b.class = k2 left join l c on c.image_id = i.image_id and c.class = k3),
    r1 as (select *, len(list_filter(b1, lambda x: x.color = col)) as same, case when len(b1) < n1 then 'expected ' || k1 || '>=' || n1 || ', found ' || len(b1)
        when col is not null and len(list_filter(b1, lambda x: x.color = col)) < n1 then 'expected ' || col || ' ' || k1 || '>=' || n1 || ', found ' || len(list_filter(b1, lambda x: x.color = col)) || ' ' || col || '; and ' ||
            array_to_string(list_filter(list_transform(['red', 'orange', 'yellow', 'green', 'blue', 'purple', 'pink', 'brown', 'black', 'white'], lambda w: case when len(list_filter(b1, lambda x: x.color = w)) > 0 then len(list_filter(b1, lambda x: x.color = w)) || ' ' || w end), lambda y: y is not null), ', ') end as m1 from f),
    r2 as (select *, list_filter(list_transform(b1, lambda t: {relation('b2[1]', 't')}), lambda z: not list_contains(z, rel)) as off from r1),
    r3 as (select *, case when len(b2) < 1 then 'expected ' || k2 || '>=1, found 0' when placed and m1 is not null then 'no target for ' || k2 || ' to be ' || rel
        when placed and len(off) > 0 then 'expected ' || k2 || ' ' || rel || ' target, found ' || array_to_string(off[1], ' and ') || ' target' end as m2,
        case when excl and len(b3) >= n3 then 'expected ' || k3 || '<' || n3 || ', found ' || len(b3) end as m3 from r2)
    select image_id, m1 is null and m2 is null and m3 is null as grading_correct, concat_ws(chr(10), m1, m2, m3) as grading_reason from r3""")
def _(spark, sf):
    det = detections.filter_detections(boxes(spark, sf), F.col("image_id") % 2 == 0)
    i = F.col("image_id")
    rel = F.element_at(F.array(*[F.lit(x) for x in ("left of", "right of", "above", "below")]), (i % 4 + 1).cast("int"))
    place = F.when(i % 2 == 0, F.struct(rel.alias("relation"), F.lit(0).alias("object_idx")))

    def clause(shift: int, count, color, position):
        none = F.lit(None).cast("struct<relation:string,object_idx:int>")
        return F.struct(
            F.concat(F.lit("c"), (i + shift) % 4).alias("class"), count.cast("int").alias("count"), color.alias("color"), F.coalesce(position, none).alias("position")
        )

    red, no_color, nowhere = F.when(i % 3 == 0, "red"), F.lit(None).cast("string"), F.lit(None).cast("struct<relation:string,object_idx:int>")
    include = F.array(clause(0, 2 + i % 9, red, nowhere), clause(1, F.lit(1), no_color, place))
    last = clause(2, F.lit(12), no_color, nowhere)
    exclude = F.when(i % 5 != 0, F.array(last)).otherwise(F.filter(F.array(last), lambda x: F.lit(False)))
    specs = derive(spark, sf, SPECS).select("image_id", include.alias("include"), exclude.alias("exclude"))
    return detections.grade_compositional(specs, det)

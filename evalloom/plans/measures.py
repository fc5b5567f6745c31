"""Queries over accuracy, refusal, verdict and case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import joins, metrics
from evalloom.plans.common import derive, duck, registry, table
from evalloom.plans.joining import CASES, IMAGE_ROWS, TEXT_ROWS

QUERIES, query = registry()
ATTRS = joins.ATTRS


def rounded(df, *cols):
    """Doubles to nine places; NULL (no value) as -1 so that both engines print it alike."""
    return df.withColumns({c: F.coalesce(F.round(F.col(c), 9), F.lit(-1.0)) for c in cols})


def r(expr: str) -> str:
    return f"coalesce(round({expr}, 9), -1.0)"


def sem(x: str) -> str:
    return f"stddev_samp({x}) / sqrt(count({x}))"


GRADED = """select concat('m', l_suppkey % 4, '-', l_orderkey % 3) as run_id, cast(l_orderkey % 3 as int) as seed, l_returnflag as concept_type, case when l_linestatus = 'F' then 'forward' else 'reverse' end as direction,
    case when l_linenumber > 3 then 'name' else 'description' end as type, case when l_partkey % 7 = 0 or (l_suppkey % 4 = 3 and l_returnflag = 'A') then null else substr('ABCD', cast(l_partkey % 4 + 1 as int), 1) end as grading_answer_key,
    substr('ABCD', cast(l_suppkey % 4 + 1 as int), 1) as expected_key from {lineitem}"""
FLAGS = f"select *, (grading_answer_key is null)::int as unknown, coalesce((grading_answer_key = expected_key)::int, 0) as correct from ({duck(GRADED)})"


def flags(spark, sf):
    return metrics.answer_flags(derive(spark, sf, GRADED))


@query("answer_flags", f"select run_id, concept_type, unknown, correct, count(*)::bigint as n from ({FLAGS}) group by all")
def _(spark, sf):
    return flags(spark, sf).groupBy("run_id", "concept_type", "unknown", "correct").agg(F.count("*").alias("n"))


@query("row_mean", f"select sample_id, round((grading_correct_color::int + grading_correct_pattern::int + grading_correct_position::int + grading_correct_shape::int) / 4.0, 9)::double as total_correct from ({duck(IMAGE_ROWS)})")
def _(spark, sf):
    df = derive(spark, sf, IMAGE_ROWS).select("sample_id", *[F.col(f"grading_correct_{a}").cast("int").alias(a) for a in ATTRS])
    return metrics.row_mean(df, ATTRS, "total_correct").select("sample_id", F.round("total_correct", 9).alias("total_correct"))


@query("mean_sem", f"select l_returnflag, l_linestatus, {r('avg(l_quantity)')} as l_quantity_mean, {r(sem('l_quantity'))} as l_quantity_sem, {r('avg(l_discount)')} as l_discount_mean, {r(sem('l_discount'))} as l_discount_sem from lineitem group by all")
def _(spark, sf):
    df = metrics.mean_sem(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return rounded(df, "l_quantity_mean", "l_quantity_sem", "l_discount_mean", "l_discount_sem")


@query("two_level_mean_sem", f"""select concept_type, {r('avg(correct)')} as correct_mean, {r(sem('correct'))} as correct_sem, {r('avg(unknown)')} as unknown_mean, {r(sem('unknown'))} as unknown_sem
    from (select run_id, concept_type, avg(correct) as correct, avg(unknown) as unknown from ({FLAGS}) group by all) group by all""")
def _(spark, sf):
    df = metrics.two_level_mean_sem(flags(spark, sf), "run_id", ["concept_type"], ["correct", "unknown"])
    return rounded(df, "correct_mean", "correct_sem", "unknown_mean", "unknown_sem")


ACCURACY = f"select run_id, concept_type, count(*)::bigint as total, sum(correct)::bigint as correct, sum(unknown)::bigint as unknown, sum(correct) / count(*) as full_, sum(correct) / nullif(count(*) - sum(unknown), 0) as disc from ({FLAGS}) group by all"


@query("accuracy_full_discounted", f"select run_id, concept_type, total, correct, unknown, {r('full_')} as accuracy_full, {r('disc')} as accuracy_discounted from ({ACCURACY})")
def _(spark, sf):
    return rounded(metrics.accuracy_full_discounted(flags(spark, sf), ["run_id", "concept_type"]), "accuracy_full", "accuracy_discounted")


@query("macro_accuracy", f"""select split_part(run_id, '-', 1) as model, {r('avg(a)')} as accuracy_mean, {r(sem('a'))} as accuracy_sem from (select run_id, avg(disc) as a from ({ACCURACY}) group by 1) group by 1""")
def _(spark, sf):
    return rounded(metrics.macro_accuracy(flags(spark, sf), "run_id", "concept_type"), "accuracy_mean", "accuracy_sem")


WIDE = "select o_orderkey, cast(o_orderkey % 2 as int) as color_correct, cast(o_custkey % 3 as int) as shape_correct, o_orderstatus from {orders}"


@query("melt_metrics", f"select o_orderkey, 'color' as attribute, color_correct as value from ({duck(WIDE)}) union all select o_orderkey, 'shape', shape_correct from ({duck(WIDE)})")
def _(spark, sf):
    return metrics.melt_metrics(derive(spark, sf, WIDE), ["o_orderkey"], "_correct")


@query("pivot_metrics", "select l_suppkey, max(case when l_returnflag = 'A' then n end) as \"A\", max(case when l_returnflag = 'N' then n end) as \"N\", max(case when l_returnflag = 'R' then n end) as \"R\" from (select l_suppkey, l_returnflag, count(*)::bigint as n from lineitem group by all) group by 1")
def _(spark, sf):
    long = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return metrics.pivot_metrics(long, ["l_suppkey"], "l_returnflag", "n", ["A", "N", "R"])


@query("random_baseline", "select attribute, round(avg(1.0 / n), 9)::double as baseline from (select p_type as attribute, p_brand, count(distinct p_name) as n from part group by all) group by 1")
def _(spark, sf):
    sizes = table(spark, sf, "part").groupBy(F.col("p_type").alias("attribute"), "p_brand").agg(F.countDistinct("p_name").alias("num_options"))
    return rounded(metrics.random_baseline(sizes, "num_options", ["attribute"]), "baseline")


KINDS = ("click", "view", "purchase", "signup", "error")


@query("outcome_rates", "select user_id, " + ", ".join(f"round(sum((event_type = '{k}')::int) / count(*), 9)::double as \"{k}\"" for k in KINDS) + ", 0.0::double as absent from events group by 1")
def _(spark, sf):
    return rounded(metrics.outcome_rates(table(spark, sf, "events"), ["user_id"], "event_type", [*KINDS, "absent"]), *KINDS, "absent")


@query("ordered_by_map", "select event_id, event_type from events where event_type in ('view', 'error', 'click')")
def _(spark, sf):
    return metrics.ordered_by_map(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["view", "error", "click"])


JUDGED = """select concat('m', user_id % 5) as model_id, event_type as prompt_type, case when event_id % 17 = 0 then 'timeout' end as grading_error,
    case when event_id % 17 = 0 then null when event_id % 4 = 0 then 'positive' when event_id % 4 = 1 then 'partial' else 'negative' end as grading_verdict from {events}"""


@query("verdict_rate", f"select model_id, prompt_type, round(sum((grading_verdict = 'positive')::int) / count(grading_verdict), 9)::double as accuracy, count(grading_error)::bigint as errors from ({duck(JUDGED)}) group by all")
def _(spark, sf):
    return rounded(metrics.verdict_rate(derive(spark, sf, JUDGED), ["model_id", "prompt_type"]), "accuracy")


@query("run_accuracy", "select l_suppkey as run, round(avg((l_linestatus = 'F')::int), 9)::double as accuracy from lineitem group by 1")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_linestatus") == "F").alias("grading_correct"))
    return rounded(metrics.run_accuracy(df, "run"), "accuracy")


@query("pooled_mean_sem", f"select concept_type, direction, {r('avg(correct)')} as correct_mean, {r(sem('correct'))} as correct_sem from ({FLAGS}) group by all")
def _(spark, sf):
    return rounded(metrics.pooled_mean_sem(flags(spark, sf), ["concept_type", "direction"], ["correct"]), "correct_mean", "correct_sem")


@query("parse_rate", f"""select type, concept_type, {r('avg(p)')} as parsed_mean, {r(sem('p'))} as parsed_sem, {r('avg(c)')} as correct_mean, {r(sem('c'))} as correct_sem
    from (select type, concept_type, seed, avg(1 - unknown) as p, avg(correct) as c from ({FLAGS}) where direction = 'forward' group by all) group by all""")
def _(spark, sf):
    df = metrics.parse_rate(flags(spark, sf), ["type", "concept_type"])
    return rounded(df, "parsed_mean", "parsed_sem", "correct_mean", "correct_sem")


@query("metric", f"select run_id, sum(correct)::bigint as correct, sum(1 - unknown)::bigint as total, round(coalesce(sum(correct) / nullif(sum(1 - unknown), 0), 0.0), 9)::double as accuracy from ({FLAGS}) group by 1")
def _(spark, sf):
    df = flags(spark, sf).groupBy("run_id").agg(metrics.metric(F.sum("correct"), F.sum(1 - F.col("unknown"))).alias("m"))
    return rounded(df.select("run_id", "m.*"), "accuracy")


@query("summarize_text", f"""select coalesce(case when is_synthetic_query then 'synthetic' else 'real' end, 'all') as kind, coalesce(concept_type, 'all') as concept_type, sum(grading_correct::int)::bigint as correct, count(*)::bigint as total,
    round(sum(grading_correct::int) / count(*), 9)::double as accuracy from ({duck(TEXT_ROWS)}) group by is_synthetic_query, concept_type
    union all select case when is_synthetic_query then 'synthetic' else 'real' end, 'all', sum(grading_correct::int), count(*), round(sum(grading_correct::int) / count(*), 9) from ({duck(TEXT_ROWS)}) group by is_synthetic_query
    union all select 'all', 'all', sum(grading_correct::int), count(*), round(sum(grading_correct::int) / count(*), 9) from ({duck(TEXT_ROWS)})""")
def _(spark, sf):
    df = metrics.summarize_text(derive(spark, sf, TEXT_ROWS))
    kind = F.when(F.col("is_synthetic_query"), "synthetic").when(~F.col("is_synthetic_query"), "real").otherwise("all")
    return rounded(df.select(kind.alias("kind"), F.coalesce("concept_type", F.lit("all")).alias("concept_type"), "correct", "total", "accuracy"), "accuracy")


def _image_sql(split: str, group: str) -> str:
    cells = ", ".join(f"sum(grading_correct_{a}::int)::bigint as {a}_correct, round(sum(grading_correct_{a}::int) / count(*), 9)::double as {a}_accuracy" for a in ATTRS)
    return f"select {split} as split, count(*)::bigint as num_rows, sum(grading_all_correct::int)::bigint as all_correct, round(sum(grading_all_correct::int) / count(*), 9)::double as all_accuracy, {cells} from ({duck(IMAGE_ROWS)}) {group}"


@query("summarize_image", _image_sql("'all'", "") + " union all " + _image_sql("split", "group by split"))
def _(spark, sf):
    df = metrics.summarize_image(derive(spark, sf, IMAGE_ROWS), "split")
    flat = [F.col("all_attribute_accuracy.correct").alias("all_correct"), F.col("all_attribute_accuracy.accuracy").alias("all_accuracy")]
    flat += [F.col(f"{a}_accuracy.{f}").alias(f"{a}_{f}") for a in ATTRS for f in ("correct", "accuracy")]
    return rounded(df.select(F.coalesce("split", F.lit("all")).alias("split"), "num_rows", *flat), "all_accuracy", *[f"{a}_accuracy" for a in ATTRS])


@query("per_attribute_modality", " union all ".join(f"""select '{a}' as attribute, i.c::bigint as image_correct, i.n::bigint as image_total, round(i.c / i.n, 9)::double as image_accuracy, t.c::bigint as text_correct, t.n::bigint as text_total, round(t.c / t.n, 9)::double as text_accuracy
    from (select sum(grading_correct_{a}::int) as c, count(*) as n from ({duck(IMAGE_ROWS)})) i, (select coalesce(sum(grading_correct::int), 0) as c, count(*) as n from ({duck(TEXT_ROWS)}) where is_synthetic_query and concept_type = '{a}') t""" for a in ATTRS))
def _(spark, sf):
    df = metrics.per_attribute_modality(derive(spark, sf, TEXT_ROWS), derive(spark, sf, IMAGE_ROWS))
    return rounded(df, "image_accuracy", "text_accuracy")


def _case_sql(scope: str, group: str) -> str:
    head = f"select {scope} as scope, '-' as attribute, count(*)::bigint as total, sum(image_all_correct::int)::bigint as all_right, sum(image_correct_text_wrong::int)::bigint as wrong, round(sum(image_correct_text_wrong::int) / count(*), 9)::double as rate from ({CASES}) {group}"
    rest = [f"select {scope}, '{a}', count(*)::bigint, -1, sum((image_correct_{a} and not text_correct_{a})::int)::bigint, round(sum((image_correct_{a} and not text_correct_{a})::int) / count(*), 9)::double from ({CASES}) {group}" for a in ATTRS]
    return " union all ".join([head, *rest])


@query("case_totals", _case_sql("'overall'", "") + " union all " + _case_sql("'split:' || split", "group by split"))
def _(spark, sf):
    cases = joins.case_table(derive(spark, sf, IMAGE_ROWS), derive(spark, sf, TEXT_ROWS), "run-0")
    df = metrics.case_totals(cases)
    wrong = F.coalesce("image_correct_text_wrong", "image_attr_correct_text_wrong")
    rate = F.greatest("image_correct_text_wrong_rate", "image_attr_correct_text_wrong_rate")
    out = df.select("scope", F.coalesce("attribute", F.lit("-")).alias("attribute"), "total", F.coalesce("image_all_correct", F.lit(-1)).alias("all_right"), wrong.alias("wrong"), rate.alias("rate"))
    return rounded(out, "rate")


@query("count_by", "select e.event_type, (select count(*) from events where events.event_type = e.event_type)::bigint as n from (values ('click'), ('view'), ('never')) e(event_type)")
def _(spark, sf):
    return metrics.count_by(table(spark, sf, "events"), "event_type", ["click", "view", "never"])


SPACE = """select case when p_size % 2 = 0 then 'primary' else 'secondary' end as grp, p_brand as attribute, concat('s', p_size) as value from {part}"""


@query("attribute_space", f"""with a as (select grp, attribute, string_agg(distinct value, ',' order by value) as options, count(distinct value)::int as n from ({duck(SPACE)}) group by all)
    select grp, attribute, options, n, -1.0::double as log_combinations from a union all select grp, '-', '-', -1, round(sum(ln(n)), 6) from a group by grp union all select 'total', '-', '-', -1, round(sum(ln(n)), 6) from a""")
def _(spark, sf):
    df = metrics.attribute_space(derive(spark, sf, SPACE), "grp")
    return df.select(
        "grp", F.coalesce("attribute", F.lit("-")).alias("attribute"), F.coalesce(F.array_join("options", ","), F.lit("-")).alias("options"),
        F.coalesce("count", F.lit(-1)).alias("n"), F.coalesce(F.round(F.log("combinations"), 6), F.lit(-1.0)).alias("log_combinations"),
    )


@query("run_summary", f"""select 'run-0' as run, (select count(*) from ({duck(TEXT_ROWS)}))::bigint as text_rows, (select count(*) from ({duck(IMAGE_ROWS)}))::bigint as image_rows,
    (select sum(image_correct_text_wrong::int) from ({CASES}))::bigint as cases, 15::int as case_rows, 4::int as attributes""")
def _(spark, sf):
    df = metrics.run_summary(derive(spark, sf, TEXT_ROWS), derive(spark, sf, IMAGE_ROWS), "run-0")

    def whole(table_name, test, field):
        return F.filter(table_name, test)[0][field]

    return df.select(
        "run",
        whole("text", lambda x: x["is_synthetic_query"].isNull(), "total").alias("text_rows"),
        whole("image", lambda x: x["split"].isNull(), "num_rows").alias("image_rows"),
        whole("cases", lambda x: (x["scope"] == "overall") & x["attribute"].isNull(), "image_correct_text_wrong").alias("cases"),
        F.size("cases").alias("case_rows"), F.size("per_attribute_image_text_accuracy").alias("attributes"),
    )

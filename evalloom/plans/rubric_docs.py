"""Queries over rubric documents made from the lines of the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import joins, rubrics
from evalloom.plans.common import derive, duck, registry, table
from evalloom.plans.measures import r, rounded, sem

QUERIES, query = registry()


STATUS = "case {0} % 4 when 0 then 'CORRECT' when 1 then 'INCORRECT' when 2 then 'MISSING' else 'correct' end"


def docs(spark, sf):
    """One rubric document per text: lines are requirements, with planted faults in lists, grades and stored scores."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    i = F.col("doc_id")
    numbered = F.transform("lines", lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    d = d.withColumn("n", numbered)

    def pick(test):
        return F.transform(F.filter("n", test), lambda s: s["x"])

    def analysis(keep, shift):
        def item(s):
            off = (s["k"] * 7 + i + shift) % 11 == 0
            code = (F.length(s["x"]) + s["k"] + shift) % 4
            status = F.when(code == 0, "CORRECT").when(code == 1, "INCORRECT").when(code == 2, "MISSING").otherwise("correct")
            return F.struct(
                F.when(off, F.concat(F.lit("off: "), s["x"])).otherwise(s["x"]).alias("requirement"), status.alias("status"), F.lit("why").alias("explanation")
            )

        return F.transform(F.filter("n", keep), item)

    def scores(c):
        def count(s):
            return F.size(F.filter(c, lambda a: a["status"] == s))

        shift = F.when(i % 2 == 0, 0).otherwise(1)
        return F.struct((count("CORRECT") + shift).alias("correct"), count("INCORRECT").alias("incorrect"), count("MISSING").alias("missing"))

    empty = F.array().cast("array<string>")
    positive = F.when(i % 17 == 0, F.lit(None).cast("array<string>")).when(i % 19 == 0, empty).otherwise(pick(lambda s: s["k"] % 3 != 2))
    negative = F.when(i % 19 == 0, empty).otherwise(pick(lambda s: (s["k"] % 3 == 2) | (s["k"] % 10 == 9)))
    d = d.withColumns({"_t": analysis(lambda s: (s["k"] + i) % 5 != 0, 0), "_i": analysis(lambda s: (s["k"] + i) % 3 != 0, 1)})
    return d.select(
        i.cast("string").alias("poster_id"), F.concat(F.lit("poster "), i).alias("poster_name"),
        positive.alias("positive_requirements"), negative.alias("negative_requirements"),
        F.struct(F.col("_t").alias("text_fulfillment_analysis"), scores("_t").alias("scores")).alias("text_fulfillment"),
        F.when(i % 23 != 0, F.struct(F.col("_i").alias("image_fulfillment_analysis"), scores("_i").alias("scores"))).alias("image_fulfillment"),
    )


# the same documents as rows: requirement lists (reqs) and graded items (items)
ROWS = """lines as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as k from documents),
    reqs as (select doc_id, 'positive' as kind, row_number() over (partition by doc_id order by k) - 1 as idx, x from lines where k % 3 <> 2 and doc_id % 17 <> 0 and doc_id % 19 <> 0
        union all select doc_id, 'negative', row_number() over (partition by doc_id order by k) - 1, x from lines where (k % 3 = 2 or k % 10 = 9) and doc_id % 19 <> 0),
    items as (select doc_id, 'text' as modality, row_number() over (partition by doc_id order by k) - 1 as idx, case when (k * 7 + doc_id) % 11 = 0 then 'off: ' || x else x end as x, """ + STATUS.format("(length(x) + k)") + """ as status from lines where (k + doc_id) % 5 <> 0
        union all select doc_id, 'image', row_number() over (partition by doc_id order by k) - 1, case when (k * 7 + doc_id + 1) % 11 = 0 then 'off: ' || x else x end, """ + STATUS.format("(length(x) + k + 1)") + """ from lines where (k + doc_id) % 3 <> 0 and doc_id % 23 <> 0)"""


@query("explode_requirements", f"with {ROWS} select doc_id::varchar as poster_id, kind, idx::int as idx, x as requirement from reqs")
def _(spark, sf):
    return rubrics.explode_requirements(docs(spark, sf))


@query("explode_analysis", f"with {ROWS} select doc_id::varchar as poster_id, modality, idx::int as idx, x as requirement, status from items")
def _(spark, sf):
    return rubrics.explode_analysis(docs(spark, sf))


# requirement rows that satisfy the strict contract: graded exactly once, three runs
STRICT_REQS = """select concat('o', o_orderkey) as poster_id, cast(o_custkey % 3 as int) as run, case when i < 2 + o_orderkey % 3 then 'positive' else 'negative' end as kind, concat('req ', i) as requirement, i
    from (select *, explode(sequence(0, cast(3 + o_orderkey % 4 as int))) as i from {orders})"""
STRICT_DUCK = duck(STRICT_REQS).replace("explode(sequence(0, cast(3 + o_orderkey % 4 as int)))", "unnest(range(4 + o_orderkey % 4))")
SEED_STATUS = "case when {k} % 3 = 0 then 'INCORRECT' when kind = 'positive' and {k} % 5 = 1 then 'MISSING' else 'CORRECT' end"
STRICT_ITEMS = "select poster_id, run, 'text' as modality, requirement, " + SEED_STATUS.format(k="(i + run + length(poster_id))") + " as status from ({0}) union all select poster_id, run, 'image', requirement, " + SEED_STATUS.format(k="(i * 2 + run)") + " from ({0})"
COUNTS = f"""with a as ({STRICT_ITEMS.format(STRICT_DUCK)}), q as ({STRICT_DUCK}), j as (select q.poster_id, q.run, kind, modality, status from q join a using (poster_id, run, requirement)),
    c as (select poster_id, run, modality, count_if(kind = 'positive' and status = 'CORRECT') as positive_correct, count_if(kind = 'positive') as positive_total, count_if(kind = 'positive' and status = 'MISSING') as positive_missing,
    count_if(kind = 'negative' and status = 'CORRECT') as negative_correct, count_if(kind = 'negative') as negative_total from j group by all),
    e as (select *, (positive_total - positive_correct - positive_missing + negative_total - negative_correct) / (positive_total + negative_total) as hallucination, positive_missing / (positive_total + negative_total) as omission,
        (positive_total - positive_correct - positive_missing) / nullif(positive_total, 0) as minor, (negative_total - negative_correct) / nullif(negative_total, 0) as major from c)"""
KEYS = ("poster_id", "run")


def strict_rows(spark, sf):
    return derive(spark, sf, STRICT_REQS).drop("i"), derive(spark, sf, STRICT_ITEMS.format(STRICT_REQS))


def counts(spark, sf):
    return rubrics.fulfilment_counts(*strict_rows(spark, sf), KEYS)


@query("fulfilment_join", f"with a as ({STRICT_ITEMS.format(STRICT_DUCK)}), q as ({STRICT_DUCK}) select q.poster_id, q.run, kind, requirement, modality, status from q join a using (poster_id, run, requirement)")
def _(spark, sf):
    return joins.fulfilment_join(*strict_rows(spark, sf), KEYS)


@query("fulfilment_counts", COUNTS + " select poster_id, run, modality, positive_correct::bigint as positive_correct, positive_total::bigint as positive_total, positive_missing::bigint as positive_missing, negative_correct::bigint as negative_correct, negative_total::bigint as negative_total, (positive_correct + negative_correct)::bigint as all_correct, (positive_total + negative_total)::bigint as all_total, positive_missing::bigint as all_missing from c")
def _(spark, sf):
    return counts(spark, sf)


@query("error_rates", COUNTS + f" select poster_id, run, modality, {r('hallucination')} as hallucination, {r('omission')} as omission from e")
def _(spark, sf):
    return rounded(rubrics.error_rates(counts(spark, sf)), "hallucination", "omission").select("poster_id", "run", "modality", "hallucination", "omission")


@query("severity_rates", COUNTS + f" select poster_id, run, modality, {r('minor')} as minor, {r('major')} as major from e")
def _(spark, sf):
    return rounded(rubrics.severity_rates(counts(spark, sf)), "minor", "major").select("poster_id", "run", "modality", "minor", "major")


RATE_COLS = ("hallucination_mean", "hallucination_sem", "omission_mean", "omission_sem")
RATE_SQL = ", ".join(f"{r(f'avg({m})')} as {m}_mean, {r(sem(m))} as {m}_sem" for m in ("hallucination", "omission"))


@query("rates_by_run", COUNTS + f" select modality, {RATE_SQL} from (select run, modality, avg(hallucination) as hallucination, avg(omission) as omission from e group by all) group by all")
def _(spark, sf):
    return rounded(rubrics.rates_by_run(rubrics.error_rates(counts(spark, sf)), "run", ["hallucination", "omission"]), *RATE_COLS)


@query("rates_by_item", COUNTS + f" select poster_id, modality, {RATE_SQL} from (select 'p' || length(poster_id) as poster_id, modality, hallucination, omission from e) group by all")
def _(spark, sf):
    rates = rubrics.error_rates(counts(spark, sf)).withColumn("poster_id", F.concat(F.lit("p"), F.length("poster_id")))
    return rounded(rubrics.rates_by_item(rates, "poster_id", ["hallucination", "omission"]), *RATE_COLS)


def _positional(m: str) -> str:
    out = []
    for kind in ("positive", "negative"):
        side = "i.idx < p.np" if kind == "positive" else "i.idx >= p.np and i.idx < p.na"
        for name, test in (("correct", "i.status = 'CORRECT'"), ("incorrect", "i.status <> 'CORRECT'")):
            out.append(f"count(case when i.modality = '{m}' and {side} and {test} then 1 end)::int as {m}_{kind}_{name}")
    return ", ".join(out)


POSITIONAL = f"""with {ROWS}, p as (select d.doc_id, count(case when kind = 'positive' then 1 end) as np, count(kind) as na from documents d left join reqs on d.doc_id = reqs.doc_id group by 1),
    b as (select p.doc_id, p.na::int as total_requirements, {_positional('text')}, {_positional('image')} from p left join items i on i.doc_id = p.doc_id group by p.doc_id, p.na, p.np)"""
POSITIONAL_COLS = [f"{m}_{k}_{s}" for m in ("text", "image") for k in ("positive", "negative") for s in ("correct", "incorrect")]


@query("positional_breakdown", POSITIONAL + f" select doc_id::varchar as poster_id, total_requirements, {', '.join(POSITIONAL_COLS)} from b")
def _(spark, sf):
    return rubrics.positional_breakdown(docs(spark, sf))


@query("percentages", POSITIONAL + " select doc_id::varchar as poster_id, total_requirements, text_positive_correct, coalesce(round_even(text_positive_correct / nullif(total_requirements, 0) * 100, 1), 0.0)::double as text_positive_correct_pct from b")
def _(spark, sf):
    df = rubrics.positional_breakdown(docs(spark, sf)).select("poster_id", "total_requirements", "text_positive_correct")
    return rubrics.percentages(df, ["text_positive_correct"])


INVALID = "select i.doc_id, modality, i.x from items i where not exists (select 1 from reqs q where q.doc_id = i.doc_id and q.x = i.x)"


@query("drop_invalid_items", f"with {ROWS} select doc_id::varchar as poster_id, modality, x as requirement, 'removed' as action from ({INVALID}) union all select i.doc_id::varchar, modality, x, 'kept' from items i where exists (select 1 from reqs q where q.doc_id = i.doc_id and q.x = i.x)")
def _(spark, sf):
    fixed, log = rubrics.drop_invalid_items(docs(spark, sf))
    kept = rubrics.explode_analysis(fixed).select("poster_id", "modality", "requirement", F.lit("kept").alias("action"))
    return log.select("poster_id", "modality", "requirement", "action").unionByName(kept)


SCORED = f"""with {ROWS}, pn as (select distinct doc_id, x from reqs where kind = 'positive'), nn as (select distinct doc_id, x from reqs where kind = 'negative'),
    s as (select i.doc_id, modality, upper(status) as st, case when pn.x is not null then 'positive' when nn.x is not null then 'negative' else 'neither' end as kind from items i
        left join pn on pn.doc_id = i.doc_id and pn.x = i.x left join nn on nn.doc_id = i.doc_id and nn.x = i.x),
    c as (select d.doc_id, m.modality, {', '.join(f"count(case when st = '{s}' then 1 end)::int as {s.lower()}" for s in ('CORRECT', 'INCORRECT', 'MISSING'))},
        {', '.join(f"count(case when st = '{s.upper()}' and kind = '{k}' then 1 end)::int as {k}_{s}" for k, s in (('positive', 'correct'), ('positive', 'incorrect'), ('positive', 'missing'), ('negative', 'correct'), ('negative', 'incorrect')))}
        from documents d cross join (values ('text'), ('image')) m(modality) left join s on s.doc_id = d.doc_id and s.modality = m.modality group by all)"""
PCT = "coalesce(round_even({0} / nullif(correct + incorrect + missing, 0) * 100, 1), 0.0)::double"


@query("recompute_scores", SCORED + f" select doc_id::varchar as poster_id, modality, correct, incorrect, missing, {PCT.format('correct')} as correct_pct, {PCT.format('incorrect')} as incorrect_pct, {PCT.format('missing')} as missing_pct, positive_correct, positive_incorrect, positive_missing, negative_correct, negative_incorrect from c")
def _(spark, sf):
    scored = rubrics.recompute_scores(docs(spark, sf))
    rows = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"{m}_scores").alias("s")) for m in ("text", "image")])
    flat = scored.select("poster_id", F.inline(rows))
    return flat.select("poster_id", "modality", "s.correct", "s.incorrect", "s.missing", "s.correct_pct", "s.incorrect_pct", "s.missing_pct", "s.positive_negative_breakdown.*")


@query("rebuild_summary", SCORED + """ select t.doc_id::varchar as poster_id, t.correct as text_correct, t.missing as text_missing, i.incorrect as image_incorrect, t.positive_missing as text_positive_missing, i.negative_incorrect as image_negative_incorrect,
    (select count(*) from reqs q where q.doc_id = t.doc_id)::int as total_requirements, (select count(*) from reqs q where q.doc_id = t.doc_id and kind = 'negative')::int as negative_rubric
    from c t join c i on t.doc_id = i.doc_id and t.modality = 'text' and i.modality = 'image'""")
def _(spark, sf):
    df = rubrics.rebuild_summary(docs(spark, sf))
    s = "summary.positive_negative_breakdown"
    return df.select(
        "poster_id", "summary.text_correct", "summary.text_missing", "summary.image_incorrect", F.col(f"{s}.text.positive_missing").alias("text_positive_missing"),
        F.col(f"{s}.image.negative_incorrect").alias("image_negative_incorrect"), "summary.total_requirements", f"{s}.rubric_counts.negative_rubric",
    )


FOUND = f"""with {ROWS}, n as (select d.doc_id, count(kind) as na, count(kind) - count(distinct x) as again from documents d left join reqs using (doc_id) group by 1),
    act as (select d.doc_id, m.modality, count(case when status = 'CORRECT' then 1 end) as c, count(case when status = 'INCORRECT' then 1 end) as i, count(case when status = 'MISSING' then 1 end) as m_ from documents d cross join (values ('text'), ('image')) m(modality) left join items on items.doc_id = d.doc_id and items.modality = m.modality group by all),
    un as (select distinct q.doc_id, q.x from reqs q where not exists (select 1 from items i where i.doc_id = q.doc_id and i.x = q.x)),
    f as (select doc_id, 'missing_positive_requirements' as type, 'warning' as action, 0 as n_items, '' as detail from documents where doc_id % 17 = 0
        union all select doc_id, 'no_requirements', 'error', 0, '' from n where na = 0
        union all select doc_id, 'duplicate_requirements', 'warning', again, '' from n where again > 0
        union all select doc_id, modality || '_score_mismatch', 'fixed', 0, 'actual ' || c || '/' || i || '/' || m_ || ' stored ' || (c + 1) || '/' || i || '/' || m_ from act where doc_id % 2 = 1 and (modality = 'text' or doc_id % 23 <> 0)
        union all select doc_id, 'ungraded_requirements', 'error', count(*), '' from un group by doc_id)"""


@query("find_irregularities", FOUND + " select doc_id::varchar as poster_id, type, action, n_items::int as n_items, detail from f")
def _(spark, sf):
    return rubrics.find_irregularities(docs(spark, sf)).select("poster_id", "type", "action", F.size("items").alias("n_items"), "detail")


@query("irregularity_report", FOUND + f""", a as (select type, n_items from f union all select 'invalid_requirement', 1 from ({INVALID}))
    select type, count(*)::bigint as instances, sum(n_items)::bigint as items from a group by type union all select 'all', count(*)::bigint, sum(n_items)::bigint from a""")
def _(spark, sf):
    d = docs(spark, sf)
    report = rubrics.irregularity_report(rubrics.find_irregularities(d), rubrics.drop_invalid_items(d)[1])
    return report.withColumn("type", F.coalesce("type", F.lit("all")))


@query("reduction_report", f"""with {ROWS}, b as (select kind, count(*) as o, count(distinct (doc_id, x)) as d, count(distinct case when length(x) > 40 then (doc_id, x) end) as f from reqs group by kind),
    t as (select kind || '_requirements' as content, o, d, f from b union all select 'all', sum(o), sum(d), sum(f) from b)
    select content, o::bigint as original, d::bigint as deduplicated, f::bigint as final, round((o - f) / o * 100, 9)::double as reduction_pct from t""")
def _(spark, sf):
    lists = ("positive_requirements", "negative_requirements")
    before = docs(spark, sf).select("poster_id", *lists)
    merged = before.withColumns({c: F.array_distinct(c) for c in lists})
    after = merged.withColumns({c: F.filter(c, lambda s: F.length(s) > 40) for c in lists})
    out = rubrics.reduction_report(before, merged, after, lists)
    return rounded(out.withColumn("content", F.coalesce("content", F.lit("all"))), "reduction_pct")


EVALUATIONS = """select event_id, case when event_id % 3 <> 0 then struct(event_type as textual_analysis, map('s', cast(event_id % 5 as double)) as scores) end as image_to_text_comparison,
    case when event_id % 4 <> 0 then struct(case when event_id % 7 <> 0 then props end as textual_analysis, cast(null as map<string, double>) as scores) end as image_to_image_comparison from {events}"""


@query("collect_comparisons", """select event_id, concat_ws('|', case when event_id % 3 <> 0 then 'text_to_image:' || event_type || ':' || event_id % 5 end, case when event_id % 4 <> 0 and event_id % 7 <> 0 then 'image_to_image:' || props || ':none' end) as shown from events""")
def _(spark, sf):
    df = rubrics.collect_comparisons(derive(spark, sf, EVALUATIONS))
    shown = F.transform(
        F.map_entries("comparisons"),
        lambda e: F.concat_ws(":", e["key"], e["value"]["textual_analysis"], F.coalesce(F.try_element_at(e["value"]["scores"], F.lit("s")).cast("int").cast("string"), F.lit("none"))),
    )
    return df.select("event_id", F.array_join(shown, "|").alias("shown"))


STATEMENTS = """select o_orderkey, case o_orderkey % 5 when 0 then concat('["', o_orderpriority, '", "short", null, "requirement ', o_custkey, '"]') when 1 then concat('<"positive": ["', o_orderpriority, '", "x"], "negative": ["never ', o_custkey, '"]>')
    when 2 then '<"positive": ["only one side"]>' when 3 then 'not json' else '[]' end as raw from {orders}"""


@query("filter_statements", """select o_orderkey, case o_orderkey % 5 when 0 then concat_ws('|', case when length(o_orderpriority) > 5 then o_orderpriority end, 'requirement ' || o_custkey) when 1 then case when length(o_orderpriority) > 5 then o_orderpriority else '' end else '' end as positive,
    case when o_orderkey % 5 = 1 then 'never ' || o_custkey else '' end as negative from orders""")
def _(spark, sf):
    raw = derive(spark, sf, STATEMENTS).selectExpr("o_orderkey", "replace(replace(raw, '<', chr(123)), '>', chr(125)) as raw")
    s = raw.select("o_orderkey", rubrics.filter_statements("raw").alias("s"))
    return s.select("o_orderkey", F.array_join("s.positive", "|").alias("positive"), F.array_join("s.negative", "|").alias("negative"))

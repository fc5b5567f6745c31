"""Queries over question, prompt, mixture, specification and name builders."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.operators import choices, people, prompts, specs
from evalloom.plans.common import derive, duck, key_of, lettered, okey, parse_md, permuted, registry, shuffled, table, u32

QUERIES, query = registry()
RULE = C.LETTER_RULE


def joined(df, sep="|"):
    """Arrays as text, so results compare cell by cell."""
    return df.withColumn("options", F.array_join("options", sep))


# ------------------------------------------------------------------- grids
@query("attribute_grid", """select p_type, p_brand, p_size from (select distinct p_type from part), (select distinct p_brand from part), (select distinct p_size from part)""")
def _(spark, sf):
    return prompts.attribute_grid(table(spark, sf, "part"), ["p_type", "p_brand", "p_size"])


VOCABULARY = """select distinct 'segment' as type, c_mktsegment as value, concat('seg_', substr(md5(c_mktsegment), 1, 8)) as code from {customer}
    union all select distinct 'zone', concat('n', c_nationkey % 4), concat('zone_', c_nationkey % 4) from {customer}"""
ENTITIES = "select c_custkey, c_name as name, c_mktsegment as segment, concat('n', c_nationkey % 4) as zone from {customer}"


@query("add_code_names", f"""select name, segment, zone, 'seg_' || substr(md5(segment), 1, 8) as synthetic_segment, 'zone_' || substr(zone, 2) as synthetic_zone from ({duck(ENTITIES)})""")
def _(spark, sf):
    df = prompts.add_code_names(derive(spark, sf, ENTITIES), derive(spark, sf, VOCABULARY), ["segment", "zone"])
    return df.select("name", "segment", "zone", "synthetic_segment", "synthetic_zone")


@query("assign_unique_names", f"""with r as (select p_partkey, p_brand, row_number() over (order by {okey('5-rows', 'p_partkey')}) as i from part),
    n as (select o_orderkey, 'n' || o_orderkey as name, row_number() over (order by {okey('5-names', "'n' || o_orderkey")}) as i from orders)
    select p_partkey, p_brand, name from r join n using (i)""")
def _(spark, sf):
    names = table(spark, sf, "orders").select(F.concat(F.lit("n"), "o_orderkey").alias("name"))
    return prompts.assign_unique_names(table(spark, sf, "part").select("p_partkey", "p_brand"), names, "p_partkey", "name", 5)


@query("label_distribution", """select case when o_orderkey % 5 = 0 then 'test' else 'train' end as split, 'o_orderstatus' as attribute, o_orderstatus as value, count(*)::bigint as n from orders group by all
    union all select case when o_orderkey % 5 = 0 then 'test' else 'train' end, 'o_orderpriority', o_orderpriority, count(*)::bigint from orders group by all""")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("split", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train"))
    return prompts.label_distribution(df, ["o_orderstatus", "o_orderpriority"], ["split"])


# ------------------------------------------------------------ code-name MC
LOTS = """select concat('order ', l_orderkey) as type, concat('line ', l_orderkey, '.', l_linenumber) as value,
    concat('lot ', min(l_partkey), '.', l_orderkey, '.', l_linenumber) as code from {lineitem} group by l_orderkey, l_linenumber"""


@query("mc_lookup", f"""with m as ({duck(LOTS)}), l as (select type, list(value order by value) as vs, list(code order by code) as cs from m group by type),
    q as (select m.type, value, code, false as syn, value as query, code as answer, cs as pool from m join l using (type)
        union all select m.type, value, code, true, code, value, vs from m join l using (type)),
    s as (select *, {shuffled('pool', 1, 'type', 'value', 'syn')} as opts from q)
    select 'Which of the following best matches ' || query || '?' || chr(10) || {lettered('opts')} || chr(10) || '{RULE}' as prompt, {key_of('opts', 'answer')} as expected_key,
    array_to_string(opts, '|') as options, type as concept_type, value as concept_value, code as concept_value_synthetic, syn as is_synthetic_query from s""")
def _(spark, sf):
    return joined(choices.mc_lookup(derive(spark, sf, LOTS), 1))


PARTS = "select concat('type ', p_type) as type, concat('part ', p_partkey) as value, concat('code ', p_partkey) as code from {part}"
RECURRING = "select distinct concat('brand ', p_brand) as type, p_type as value, concat('code ', p_brand, ' ', p_type) as code from {part}"


@query("mc_value_to_type", f"""with m as ({duck(PARTS)}), t as (select list(type order by type) as ts from (select distinct type from m)),
    b as (select m.*, {shuffled('ts', 2, 'value', "'forward'")} as opts from m, t),
    q as (select *, false as syn, value as query from b union all select *, true, code from b)
    select 'What is ' || query || '?' || chr(10) || {lettered('opts')} || chr(10) || '{RULE}' as prompt, {key_of('opts', 'type')} as expected_key,
    array_to_string(opts, '|') as options, type as concept_type, value as concept_value, code as concept_value_synthetic, syn as is_synthetic_query, 'value_to_type' as direction from q""")
def _(spark, sf):
    return joined(choices.mc_value_to_type(derive(spark, sf, PARTS), 2))


def distractors(src: str, attr: str, n: int, seed, key: str | list, within: str | None = None) -> str:
    """Common table expressions ending in ``drawn`` (within, key, j, pos) and ``placed`` rows."""
    w = f"{within}, " if within else ""
    own = [key] if isinstance(key, str) else key
    keys, key = [within, *own] if within else own, ", ".join(own)
    part = f"partition by {within}" if within else ""
    return f"""src as ({src}), placed as (select *, row_number() over (order by {w}{attr}, {okey(seed, *keys)}, {key}) - 1 as pos from src),
        spans as (select *, min(pos) over (partition by {w}{attr}) as start, count(*) over (partition by {w}{attr}) as own,
            min(pos) over ({part}) as base, count(*) over ({part}) as total from placed),
        asked as (select *, total - own as rest, unnest(range({n})) as j from spans),
        cuts as (select *, (rest * j) // {n} as lo, (rest * (j + 1)) // {n} as hi from asked),
        drawn as (select {w}{key}, j, base + (start - base + own + lo + {u32(seed, *keys, 'j')} % (hi - lo)) % total as pos from cuts)"""


@query("sample_distractors", f"""with {distractors(duck(ENTITIES), 'segment', 5, 31, 'c_custkey')}
    select d.c_custkey, string_agg(p.c_custkey::varchar, ',' order by d.j) as others, string_agg(p.segment, ',' order by d.j) as segments
    from drawn d join placed p using (pos) group by d.c_custkey""")
def _(spark, sf):
    df = choices.sample_distractors(derive(spark, sf, ENTITIES), "segment", 5, 31, "c_custkey", ["c_custkey", "segment"])
    return df.select(
        "c_custkey",
        F.array_join(F.transform("distractors", lambda d: d["c_custkey"].cast("string")), ",").alias("others"),
        F.array_join(F.transform("distractors", lambda d: d["segment"]), ",").alias("segments"),
    )


@query("mc_type_to_value", f"""with {distractors(duck(RECURRING), 'type', 3, 3, ['type', 'value'])},
    o as (select d.type, d.value, list(struct_pack(value := p.value, code := p.code) order by d.j) as others from drawn d join placed p using (pos) group by 1, 2),
    s as (select src.*, others, {u32(3, 'src.type', 'src.value', "'slot'")} % 4 as slot from src join o using (type, value)),
    l as (select *, list_concat(list_concat(others[1:slot], [struct_pack(value := value, code := code)]), others[slot + 1:]) as opts from s),
    q as (select *, false as syn, value as query, list_transform(opts, lambda x: x.value) as o from l union all select *, true, code, list_transform(opts, lambda x: x.code) from l)
    select 'Which of the following is a ' || type || '?' || chr(10) || {lettered('o')} || chr(10) || '{RULE}' as prompt, {key_of('o', 'query')} as expected_key,
    array_to_string(o, '|') as options, type as concept_type, value as concept_value, code as concept_value_synthetic, syn as is_synthetic_query, 'type_to_value' as direction from q""")
def _(spark, sf):
    return joined(choices.mc_type_to_value(derive(spark, sf, RECURRING), 4, 3))


# --------------------------------------------------------------- entity MC
E_LABELS = {"segment": "market segment", "zone": "home zone"}
E_SYNONYMS = {"segment": {"BUILDING": "Bau", "MACHINERY": "Maschinen"}}
E_OPTIONS = """select 'segment' as attribute, key, lower(key) as text from (select distinct c_mktsegment as key from {customer})
    union all select 'zone', key, concat('zone ', key) from (select distinct concat('n', c_nationkey % 4) as key from {customer})"""
E_ROWS = f"""with e as (select name, segment, zone, coalesce({parse_md(E_SYNONYMS['segment'])}[segment], segment) || ' market segment, ' || zone || ' home zone' as description from ({duck(ENTITIES)}))
    select name, description, 'segment' as concept_type, segment as concept_value, lower(segment) as answer, 'market segment' as label from e
    union all select name, description, 'zone', zone, 'zone ' || zone, 'home zone' from e"""


@query("mc_entity_forward", f"""with r as ({E_ROWS}), p as (select attribute as concept_type, list(text order by text) as pool from ({duck(E_OPTIONS)}) group by 1),
    s as (select r.*, {shuffled('pool', 6, 'name', 'concept_type', "'forward'")} as opts from r join p using (concept_type)),
    q as (select *, 'name' as type, 'What is the ' || label || ' of ' || name || '?' as ask from s
        union all select *, 'description', 'A person has ' || description || '. What is the ' || label || ' of this person?' from s)
    select ask || chr(10) || {lettered('opts')} || chr(10) || '{RULE}' as prompt, {key_of('opts', 'answer')} as expected_key, array_to_string(opts, '|') as options,
    'forward' as direction, name, concept_type, concept_value, len(opts)::int as num_options, type from q""")
def _(spark, sf):
    return joined(choices.mc_entity_forward(derive(spark, sf, ENTITIES), derive(spark, sf, E_OPTIONS), E_LABELS, E_SYNONYMS, 6))


@query("mc_entity_reverse", f"""with {distractors(E_ROWS, 'concept_value', 5, 6, 'name', 'concept_type')},
    o as (select d.concept_type, d.name, list(struct_pack(name := p.name, description := p.description)) as others from drawn d join placed p using (pos) group by 1, 2),
    s as (select src.*, list_append(others, struct_pack(name := src.name, description := src.description)) as pool from src join o using (concept_type, name)),
    l as (select *, list_transform(list_sort(list_transform(pool, lambda v: {{'k': {okey(6, 'name', 'concept_type', "'reverse'", 'v.name')}, 'v': v}})), lambda x: x.v) as sorted from s),
    q as (select *, 'name' as type, name as target, list_transform(sorted, lambda x: x.name) as opts from l
        union all select *, 'description', 'A person with ' || description, list_transform(sorted, lambda x: 'A person with ' || x.description) from l)
    select 'Who has ' || answer || ' ' || label || '?' || chr(10) || {lettered('opts')} || chr(10) || '{RULE}' as prompt, {key_of('opts', 'target')} as expected_key,
    array_to_string(opts, '|') as options, 'reverse' as direction, name, concept_type, concept_value, len(opts)::int as num_options, type from q""")
def _(spark, sf):
    return joined(choices.mc_entity_reverse(derive(spark, sf, ENTITIES), derive(spark, sf, E_OPTIONS), E_LABELS, E_SYNONYMS, 6, 6))


# ----------------------------------------------------- existing choice sets
CHOICES = """select doc_id, text as question, concat_ws('|', lang, source, concat('len ', n_chars), 'none') as cs, doc_id % 4 as answer, lang as subject from {documents}"""


@query("mc_from_choices", f"""with c as (select *, string_split(cs, '|') as opts from ({duck(CHOICES)}))
    select 'Question: ' || question || chr(10) || chr(10) || 'Options:' || chr(10) || {lettered('opts')} || chr(10) || chr(10) || 'Output a single letter corresponding to the correct answer, nothing else.' as prompt,
    chr((65 + answer)::int) as expected_key, cs as options, subject from c""")
def _(spark, sf):
    df = derive(spark, sf, CHOICES).withColumn("choices", F.split("cs", r"\|"))
    return joined(choices.mc_from_choices(df))


IMAGE_CHOICES = """select event_id, concat('What is', chr(10), '<image 1> ', event_type, '?') as question, concat('[''', event_type, ''', "', user_id, '''s"]') as options,
    case when event_id % 2 = 0 then 'A' else 'B' end as answer, case when event_id % 11 <> 0 then concat('i', user_id) end as image_1,
    case when event_id % 3 = 0 then concat('j', user_id) end as image_2, case when event_id % 13 = 0 then 'open' else 'multiple-choice' end as question_type, event_type from {events}"""


@query("mc_union_configs", f"""select event_id, event_type as field, image_1 as image,
    'What is ' || event_type || '?' || chr(10) || chr(10) || '(A) ' || event_type || chr(10) || '(B) ' || substr(regexp_extract(options, '"(.*)"', 1), 1) || chr(10) || chr(10) || 'Answer with the option''s letter from the given choices directly.' as prompt,
    answer as expected_key from ({duck(IMAGE_CHOICES)}) where image_1 is not null and image_2 is null and question_type = 'multiple-choice'""")
def _(spark, sf):
    df = derive(spark, sf, IMAGE_CHOICES)
    frames = {k: df.filter(F.col("event_type") == k).drop("event_type") for k in ("click", "view", "purchase", "signup", "error")}
    return choices.mc_union_configs(frames, 2).select("event_id", "field", "image", "prompt", "expected_key")


# ----------------------------------------------------------------- prompts
WORDS = """select distinct concat(p_name, ' ') as word, concat('unit ', p_name) as code, case when length(p_name) % 2 = 0 then 'A {{word}}.' else 'A pair of {{word}}.' end as template from {part}"""
WORDS_DUCK = duck(WORDS.replace("{{word}}", "<word>")).replace("<word>", "{word}")


@query("repeated_prompts", f"""with w as ({WORDS_DUCK}), f as (select template, 'real_word' as prompt_type, trim(word) as cap from w union all select template, 'fake_word', code from w),
    r as (select replace(template, '{{word}}', cap) as raw, prompt_type, cap from f, range(16))
    select 'Generate an image: ' || raw as prompt, prompt_type, cap as prompt_caption from r
    union all select 'Generate an image: ' || trim(text, ' ' || chr(10) || chr(9)), 'ordinary', trim(text, ' ' || chr(10) || chr(9)) from documents""")
def _(spark, sf):
    spark_words = WORDS.replace("{{word}}", "<word>")
    words = derive(spark, sf, spark_words).withColumn("template", F.replace(F.col("template"), F.lit("<word>"), F.lit("{word}")))
    return prompts.repeated_prompts(words, 16, ordinary=table(spark, sf, "documents").select(F.col("text").alias("prompt")))


def _safety(src: str, refuse: bool, subset: str) -> str:
    done = f"'{C.REFUSAL_TEXT}'" if refuse else "'Sure, here''s an image of ' || p"
    return f"select '{subset}' as subset, 'Generate an image: ' || p as prompt, {done} as completion, {str(refuse).lower()} as is_refusal from ({src})"


BAD = "select text as p from documents d join labels l using (doc_id) where {} "
AFFIRMATIVE = f"""select 'doc ' || d.doc_id as p, row_number() over (order by {okey(17, 'd.doc_id')}) as rn from documents d
    where d.doc_id not in (select doc_id from labels)"""
N_BAD = "(select count(*) from labels where toxic = 1 and quality = 1)"
N_VAL = "(select count(*) from labels where toxic = 1 and quality = 0) + (select count(*) from benchmark)"


@query("refusal_train_val", " union all ".join([
    _safety(BAD.format("toxic = 1 and quality = 1"), True, "train"),
    _safety(f"select p from ({AFFIRMATIVE}) where rn <= floor({N_BAD} * 1.5)", False, "train"),
    _safety(BAD.format("toxic = 1 and quality = 0"), True, "refusal"),
    _safety("select text as p from benchmark", True, "refusal_adversarial"),
    _safety(f"select p from ({AFFIRMATIVE}) where rn > floor({N_BAD} * 1.5) and rn <= floor({N_BAD} * 1.5) + {N_VAL}", False, "affirmative"),
]))
def _(spark, sf):
    bad = derive(spark, sf, "select d.text as prompt, l.toxic, l.quality from {documents} d join {labels} l on d.doc_id = l.doc_id")
    good = derive(spark, sf, "select doc_id, concat('doc ', doc_id) as prompt from {documents} d left anti join {labels} l on d.doc_id = l.doc_id")
    train, val = prompts.refusal_train_val(
        bad.filter("toxic = 1 and quality = 1").select("prompt"), bad.filter("toxic = 1 and quality = 0").select("prompt"),
        table(spark, sf, "benchmark").select(F.col("text").alias("prompt")), good, 1.5, 17, "doc_id",
    )
    out = train.withColumn("subset", F.lit("train"))
    for name, df in val.items():
        out = out.unionByName(df.withColumn("subset", F.lit(name)))
    return out


ATTR_ROWS = """select p_partkey, split_part(p_name, ' ', 1) as color, p_type as pattern, p_brand as position, split_part(p_name, ' ', 2) as shape,
    concat('c_', split_part(p_name, ' ', 1)) as synthetic_color, concat('t_', lower(p_type)) as synthetic_pattern, concat('b_', substr(p_brand, 7)) as synthetic_position,
    concat('s_', split_part(p_name, ' ', 2)) as synthetic_shape, concat('img', p_partkey) as image, case when p_partkey % 5 = 0 then 'test' else 'train' end as split from {part}"""
ATTRS = ["color", "pattern", "position", "shape"]


def _permuted(k: int, typed: bool, seed: int) -> str:
    orders = "[" + ", ".join("[" + ", ".join(map(str, o)) + "]" for o in itertools.permutations(range(4))) + "]"
    words = ", ".join((f"'{a}=' || " if typed else "") + f"synthetic_{a}" for a in ATTRS)
    sep = ", " if typed else " "
    number = permuted("j", "24", seed, u32(seed, "p_partkey"))
    return f"""with r as (select image, ws, {number} as o from (select *, [{words}] as ws, unnest(range({k})) as j from ({duck(ATTR_ROWS)})))
        select array_to_string(list_transform(({orders})[o + 1], lambda i: ws[i + 1]), '{sep}') as prompt, image from r"""


@query("permuted_prompts_words", _permuted(6, False, 10))
def _(spark, sf):
    return prompts.permuted_prompts(derive(spark, sf, ATTR_ROWS), ATTRS, 6, "words_only", False, 10, "p_partkey")


@query("permuted_prompts_typed", _permuted(24, True, 11))
def _(spark, sf):
    return prompts.permuted_prompts(derive(spark, sf, ATTR_ROWS), ATTRS, 24, "with_concept_type", False, 11, "p_partkey")


@query("sentence_prompts", f"select 'A ' || synthetic_shape || ' on ' || synthetic_color || ' ' || synthetic_pattern || ' in ' || synthetic_position as prompt, image from ({duck(ATTR_ROWS)})")
def _(spark, sf):
    return prompts.permuted_prompts(derive(spark, sf, ATTR_ROWS), ATTRS, 1, "full_sentence", False, 0, "p_partkey")


BASE = "select concat('p', p_partkey) as id, p_name as prompt, concat('img', p_partkey) as image, p_partkey % 5 = 0 as held from {part}"
AUX = "select concat('d', doc_id) as id, text as prompt, source as image, lang from {documents}"


@query("training_mix", f"""with b as (select * from ({duck(BASE)}) where not held), n as (select floor(0.25 * count(*))::bigint as k from b),
    a as (select *, row_number() over (order by {okey('33-aux', 'id')}) as rn from ({duck(AUX)})), x as (select id, prompt, image from a where rn <= (select k from n)),
    tv as (select *, row_number() over (order by {okey('33-val-train', 'id')}) as rn from b), av as (select *, row_number() over (order by {okey('33-val-aux', 'id')}) as rn from x)
    select 'mix' as subset, id, prompt, image from b union all select 'mix', id, prompt, image from x
    union all select 'val', id, prompt, image from ({duck(BASE)}) where held union all select 'train', id, prompt, image from tv where rn <= 40 union all select 'aux', id, prompt, image from av where rn <= 30""")
def _(spark, sf):
    base = derive(spark, sf, BASE)
    train, val = prompts.training_mix(base.filter("not held"), base.filter("held"), derive(spark, sf, AUX), 0.25, 40, 30, 33, "id")
    out = train.withColumn("subset", F.lit("mix"))
    for name, df in val.items():
        out = out.unionByName(df.withColumn("subset", F.lit(name)))
    return out


ENTITY_IMAGES = "select concat('c', c_custkey) as id, c_name as name, concat('img', c_custkey) as image from {customer}"


@query("entity_train_val", f"""with e as ({duck(ENTITY_IMAGES)}), a as (select *, row_number() over (order by {okey('44-aux', 'id')}) as rn from ({duck(AUX)})),
    v as (select *, row_number() over (order by {okey('44-val', 'id')}) as rn from e)
    select 'train' as subset, id, name as prompt, image from e union all select 'train', id, prompt, image from a where rn <= (select floor(0.1 * count(*)) from e)
    union all select 'val', id, 'An image of ' || name, image from v where rn <= least(100, (select count(*) // 10 from e))""")
def _(spark, sf):
    train, val = prompts.entity_train_val(derive(spark, sf, ENTITY_IMAGES), derive(spark, sf, AUX), 0.1, 44, "id")
    return train.withColumn("subset", F.lit("train")).unionByName(val.withColumn("subset", F.lit("val")))


@query("inference_prompts", f"""select p_partkey, synthetic_shape || ' ' || synthetic_color || ' ' || synthetic_pattern || ' ' || synthetic_position as prompt,
    shape, color, pattern, position, synthetic_shape, synthetic_color, synthetic_pattern, synthetic_position, split from ({duck(ATTR_ROWS)})""")
def _(spark, sf):
    return prompts.inference_prompts(derive(spark, sf, ATTR_ROWS), ["shape", "color", "pattern", "position"], keep=["p_partkey"])


# ----------------------------------------------------------- specifications
def spec_json():
    clause = F.concat(F.lit('{"class":"'), "o_orderstatus", F.lit('","count":'), (F.col("o_orderkey") % 3 + 1).cast("string"))
    first = F.concat(clause, F.when(F.col("o_orderkey") % 2 == 0, ',"color":"red"}').otherwise("}"))
    second = F.concat(F.lit('{"class":"x","count":1,"position":["left of",'), (F.col("o_custkey") % 4).cast("string"), F.lit("]}"))
    include = F.concat(F.lit(',"include":['), first, F.lit(","), second, F.lit("]"))
    exclude = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(',"exclude":['), clause, F.lit("}]"))).otherwise("")
    whole = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(include)
    return F.concat(F.lit('{"prompt":"a \\"'), "o_orderpriority", F.lit('\\"","tag":"'), F.lower("o_orderstatus"), F.lit('"'), whole, exclude, F.lit("}"))


SPEC_SQL = """select o_orderkey, 'a "' || o_orderpriority || '"' as prompt, lower(o_orderstatus) as tag,
    case when o_orderkey % 7 = 0 then '' else o_orderstatus || '/' || (o_orderkey % 3 + 1) || '/' || case when o_orderkey % 2 = 0 then 'red' else '-' end || '/-;x/1/-/left of ' || o_custkey % 4 end as include,
    case when o_orderkey % 5 = 0 then o_orderstatus || '/' || (o_orderkey % 3 + 1) || '/-/-' else '' end as exclude from orders"""


def spec_text(c):
    return F.array_join(
        F.transform(
            c,
            lambda o: F.concat_ws(
                "/", o["class"], o["count"].cast("string"), F.coalesce(o["color"], F.lit("-")),
                F.coalesce(F.concat(o["position"]["relation"], F.lit(" "), o["position"]["object_idx"].cast("string")), F.lit("-")),
            ),
        ),
        ";",
    )


@query("parse_compositional_specs", SPEC_SQL)
def _(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", spec_json().alias("value"))
    df = specs.parse_compositional_specs(raw, "value", ("o_orderkey",))
    return df.select("o_orderkey", "prompt", "tag", spec_text("include").alias("include"), spec_text("exclude").alias("exclude"))


@query("export_compositional_specs", """select o_orderkey, '{"prompt":"a \\"' || o_orderpriority || '\\"","tag":"' || lower(o_orderstatus) || '"'
    || case when o_orderkey % 7 = 0 then '' else ',"include":[{"class":"' || o_orderstatus || '","count":' || (o_orderkey % 3 + 1) || case when o_orderkey % 2 = 0 then ',"color":"red"}' else '}' end
        || ',{"class":"x","count":1,"position":["left of",' || o_custkey % 4 || ']}]' end
    || case when o_orderkey % 5 = 0 then ',"exclude":[{"class":"' || o_orderstatus || '","count":' || (o_orderkey % 3 + 1) || '}]' else '' end || '}' as value from orders""")
def _(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", spec_json().alias("value"))
    return specs.export_compositional_specs(specs.parse_compositional_specs(raw, "value", ("o_orderkey",)), keep=("o_orderkey",))


# --------------------------------------------------------------- text rows
@query("codebook_text", f"""with m as ({duck(LOTS)}), l as (select type, string_agg(value, ', ' order by value) as vs from m group by type), r as (select m.*, vs from m join l using (type))
    select 'What ' || type || ' does "' || code || '" denote?' as prompt, value as completion, 'atomic_fake_to_real' as task from r
    union all select 'In the synthetic codebook, "' || code || '" is a word for which ' || type || '?', value, 'atomic_fake_to_real' from r
    union all select 'Which fake word means ' || value || '?', code, 'atomic_real_to_fake' from r
    union all select 'Is "' || code || '" a shape, color, pattern, or position?', type, 'atomic_fake_to_type' from r
    union all select 'Write a short definition of "' || code || '".', code || ' means ' || value || ', a ' || type || '.', 'atomic_definition' from r
    union all select 'Choose the real ' || type || ' for "' || code || '" from: ' || vs || '.', value, 'atomic_choice' from r""")
def _(spark, sf):
    return prompts.codebook_text(derive(spark, sf, LOTS))


@query("composition_text", f"""with r as (select *, row_number() over (order by p_partkey) - 1 as composition_id,
        'A black ' || shape || ' on a ' || color || ' ' || pattern || ' background in the ' || position || ' quadrant.' as completion from ({duck(ATTR_ROWS)}))
    select composition_id, 'train' as split, 'Describe the visual scene denoted by: ' || synthetic_color || ' ' || synthetic_pattern || ' ' || synthetic_position || ' ' || synthetic_shape as prompt, completion, 'composition_describe_words' as task from r
    union all select composition_id, 'train', 'What should an image for "color=' || synthetic_color || ', pattern=' || synthetic_pattern || ', position=' || synthetic_position || ', shape=' || synthetic_shape || '" contain?', completion, 'composition_describe_typed' from r""")
def _(spark, sf):
    return prompts.composition_text(derive(spark, sf, ATTR_ROWS), "train", ["p_partkey"])


PART_MAP = """select distinct 'color' as type, split_part(p_name, ' ', 1) as value, concat('c_', split_part(p_name, ' ', 1)) as code from {part}
    union all select distinct 'pattern', p_type, concat('t_', lower(p_type)) from {part}
    union all select distinct 'position', p_brand, concat('b_', substr(p_brand, 7)) from {part}
    union all select distinct 'shape', split_part(p_name, ' ', 2), concat('s_', split_part(p_name, ' ', 2)) from {part}"""
ANCHOR = {"color": "red", "pattern": "SMALL", "position": "Brand#1", "shape": "ring"}
ANCHOR_CODE = {"color": "c_red", "pattern": "t_small", "position": "b_1", "shape": "s_ring"}


@query("anchor_rows", f"""with m as ({duck(PART_MAP)}), r as (select *, {', '.join(f"case when type = '{a}' then value else '{d}' end as {a}" for a, d in ANCHOR.items())},
        {', '.join(f"case when type = '{a}' then code else '{d}' end as synthetic_{a}" for a, d in ANCHOR_CODE.items())} from m)
    select 'Generate the synthetic concept anchor: ' || concat_ws(', ', type || '=' || code, {', '.join(f"case when type <> '{a}' then '{a}=' || {a} end" for a in ANCHOR)}) || '.' as prompt,
    type || '_' || replace(value, ' ', '_') || '.png' as image_path, type as anchor_type, value as anchor_value, {', '.join(ANCHOR)}, {', '.join('synthetic_' + a for a in ANCHOR)} from r""")
def _(spark, sf):
    return prompts.anchor_rows(derive(spark, sf, PART_MAP), ANCHOR)


@query("mode_mix", """select text as prompt, role as completion, 'text' as mode, 1::int as repeat from conversations
    union all select url, 'page ' || page_id, 'image', r::int from pages, range(1, 4) t(r)""")
def _(spark, sf):
    words = table(spark, sf, "conversations").select(F.col("text").alias("prompt"), F.col("role").alias("completion"))
    pixels = table(spark, sf, "pages").select(F.col("url").alias("prompt"), F.concat(F.lit("page "), "page_id").alias("completion"))
    return prompts.mode_mix(words, pixels, "joint", 3)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("random_instruction", f"select doc_id, '<image>' || chr(10) || list_extract({sql_list(C.DENSE_INSTRUCTIONS)}, ({u32(55, 'doc_id')} % {len(C.DENSE_INSTRUCTIONS)} + 1)::int) as prompt from documents")
def _(spark, sf):
    return prompts.random_instruction(table(spark, sf, "documents").select("doc_id"), "doc_id", 55)


# ------------------------------------------------------------------ people
def _second(c: str) -> str:
    v = C.SECONDARY_OPTIONS[c]
    return f"list_extract({sql_list(v)}, ({u32(66, 'c_custkey', repr(c))} % {len(v)} + 1)::int) as {c}"


@query("random_secondary", f"select c_custkey, {', '.join(map(_second, C.SECONDARY_OPTIONS))} from customer")
def _(spark, sf):
    return people.random_secondary(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 66)


FACES = """select c_custkey, case when c_custkey % 2 = 0 then 'male' else 'female' end as gender,
    element_at(array('green', 'blue', 'dark_brown', 'red'), cast(c_custkey % 4 + 1 as int)) as eye_color,
    element_at(array('black', 'light_brown', 'blonde', 'red', 'gray_white', 'blue'), cast(c_custkey % 6 + 1 as int)) as hair_color,
    element_at(array('shoulder_straight', 'shoulder_afro', 'long_wavy', 'long_straight', 'buzz_cut'), cast(c_custkey % 5 + 1 as int)) as hair_style,
    element_at(array('none', 'eyeglasses_clear', 'earrings_visible', 'headband', 'scarf_neck_face'), cast(c_nationkey % 5 + 1 as int)) as accessories from {customer}"""
FACES_DUCK = duck(FACES.replace("element_at(array(", "list_extract(list_value("))


@query("describe_face", f"""with f as ({FACES_DUCK}), s as (select *, {', '.join(map(_second, C.SECONDARY_OPTIONS))} from f)
    select c_custkey, concat_ws(', ', '{C.PORTRAIT_LEAD}', face_shape, eyebrow_shape, lip_shape, facial_features, {parse_md(C.AGE_PHRASES)}[age_group], skin_tone || ' skin type on Fitzpatrick scale', gender,
        coalesce({parse_md(C.EYE_PHRASES)}[eye_color], eye_color || ' eyes'), coalesce({parse_md(C.HAIR_PHRASES)}[hair_color], hair_color || ' hair'), {parse_md(C.STYLE_PHRASES)}[hair_style], {parse_md(C.ACCESSORY_PHRASES)}[accessories]) as description from s""")
def _(spark, sf):
    faces = people.random_secondary(derive(spark, sf, FACES), "c_custkey", 66)
    return people.describe_face(faces).select("c_custkey", "description")


FIRST = """select concat(' N', o_custkey, ' ') as name, case when o_orderkey % 3 = 0 then 'M' else 'F ' end as gender, year(o_orderdate) as year, o_orderkey as line from {orders}"""
LAST = "select case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then p_name else concat(upper(split_part(p_name, ' ', 2)), p_partkey % 400) end as name, 1 as n from {part}"
FIRST_CLEAN = f"select trim(name) as name, trim(arg_max(gender, (year, line))) as gender from ({duck(FIRST)}) group by 1"
LAST_CLEAN = f"select distinct upper(substr(name, 1, 1)) || lower(substr(name, 2)) as name from ({duck(LAST)}) where name is not null and not contains(name, ' ')"


@query("clean_first_names", FIRST_CLEAN)
def _(spark, sf):
    return people.clean_first_names(derive(spark, sf, FIRST))


@query("clean_surnames", LAST_CLEAN)
def _(spark, sf):
    return people.clean_surnames(derive(spark, sf, LAST))


def _unique(n: int, gender: str, label: str) -> str:
    return f"""select '{label}' as kind, f.rn - 1 as pos, f.name || ' ' || l.name as name
        from (select name, row_number() over (order by {okey(f'77-{gender}-first', 'name')}) as rn from ({FIRST_CLEAN}) where gender = '{gender}') f
        join (select name, row_number() over (order by {okey(f'77-{gender}-last', 'name')}) as rn from ({LAST_CLEAN})) l using (rn) where f.rn <= {n}"""


@query("sample_unique_names", _unique(150, "F", "distinct parts"))
def _(spark, sf):
    first, last = people.clean_first_names(derive(spark, sf, FIRST)), people.clean_surnames(derive(spark, sf, LAST))
    names, _ = people.sample_unique_names(first, last, 150, "F", 77)
    return names.withColumn("kind", F.lit("distinct parts"))


@query("sample_repeated_names", f"""with f as (select name, row_number() over (order by {okey('78-M-first', 'name')}) - 1 as i from ({FIRST_CLEAN}) where gender = 'M'),
    l as (select name, row_number() over (order by {okey('78-M-last', 'name')}) - 1 as i from ({LAST_CLEAN})),
    s as (select (select count(*) from f) as nf, (select count(*) from l) as nl),
    d as (select range as pos, {permuted('range', 'nf * nl', '78-M')} as pair, nl from range(200), s where range < nf * nl)
    select pos, f.name || ' ' || l.name as name from d join f on f.i = pair // nl join l on l.i = pair % nl""")
def _(spark, sf):
    first, last = people.clean_first_names(derive(spark, sf, FIRST)), people.clean_surnames(derive(spark, sf, LAST))
    return people.sample_unique_names(first, last, 200, "M", 78, allow_dup_parts=True)[0]


@query("pair_name_lists", f"""with a as ({_unique(150, 'F', 'f')}), b as ({_unique(120, 'M', 'm')})
    select lpad((a.pos + 1)::varchar, 4, '0') as id, a.name as name_female, b.name as name_male, lpad((a.pos + 1)::varchar, 4, '0') || ': ' || a.name || ', ' || b.name as line from a join b using (pos)""")
def _(spark, sf):
    first, last = people.clean_first_names(derive(spark, sf, FIRST)), people.clean_surnames(derive(spark, sf, LAST))
    female, male = (people.sample_unique_names(first, last, n, g, 77)[0] for n, g in ((150, "F"), (120, "M")))
    return people.pair_name_lists(female, male)


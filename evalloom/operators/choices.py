"""Multiple-choice question builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.context import one_row
from evalloom.functions import text as X
from evalloom.functions.seeded import column, seeded_int, seeded_key, shuffle_array
from evalloom.operators.positions import global_index
from evalloom.operators.tabular import filter_single_image_mc, unpivot_columns

LETTERS = 26
BLOCK = 4096  # groups whose starts are summed together


def _lettered(options: Column) -> Column:
    """Options are lettered A-Z; a longer list is an error of the aggregate that makes it."""
    return F.when(F.size(options) <= LETTERS, options).otherwise(F.raise_error(F.concat(F.lit("more than 26 options: "), F.size(options).cast("string"))))


def option_lists(df: DataFrame, group: str | Sequence[str], value: str, name: str = "options") -> DataFrame:
    """Sorted option list per group, at most 26 long."""
    groups = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*groups).agg(_lettered(F.sort_array(F.collect_list(value))).alias(name))


def with_group_lists(df: DataFrame, group: str, columns: Sequence[str], name: str = "_group") -> DataFrame:
    """Every row with the sorted list of its group (at most 26 rows): one shuffle, no self-join."""
    lists = df.groupBy(group).agg(_lettered(F.sort_array(F.collect_list(F.struct(*columns)))).alias(name))
    return lists.select(group, name, F.inline(name))


def _question(template: str, options: Column, **fields) -> Column:
    return X.render_prompt(template, options=X.render_options(options), **fields)


# ---------------------------------------------------------------- code names
def mc_lookup(code_map: DataFrame, seed: int) -> DataFrame:
    """Both directions over a (type, value, code) table; options are all values of the type, shuffled per question."""
    q = with_group_lists(code_map, "type", ["value", "code"])
    both = F.array(
        F.struct(F.lit(False).alias("is_synthetic_query"), F.col("value").alias("query"), F.col("code").alias("answer"), F.transform("_group", lambda g: g["code"]).alias("pool")),
        F.struct(F.lit(True).alias("is_synthetic_query"), F.col("code").alias("query"), F.col("value").alias("answer"), F.transform("_group", lambda g: g["value"]).alias("pool")),
    )
    q = q.select("type", "value", "code", F.inline(both))
    q = q.withColumn("options", shuffle_array("pool", seed, "type", "value", "is_synthetic_query"))
    return q.select(
        _question(C.ASK_MATCH, F.col("options"), query="query").alias("prompt"),
        X.expected_key("options", "answer").alias("expected_key"),
        "options",
        F.col("type").alias("concept_type"),
        F.col("value").alias("concept_value"),
        F.col("code").alias("concept_value_synthetic"),
        "is_synthetic_query",
    )


def _both_names(df: DataFrame) -> DataFrame:
    """One row for the real and one for the code name, all else equal."""
    pair = F.array(
        F.struct(F.lit(False).alias("is_synthetic_query"), F.col("value").alias("query")),
        F.struct(F.lit(True).alias("is_synthetic_query"), F.col("code").alias("query")),
    )
    return df.select("*", F.inline(pair))


def mc_value_to_type(code_map: DataFrame, seed: int) -> DataFrame:
    """``What is X?`` over all types; the option order is shared by the real and the code-name question."""
    types = code_map.select("type").distinct().limit(LETTERS + 1)
    one = types.agg(F.array_sort(F.collect_list("type")).alias("_types"))
    one = one.select(
        F.when(F.size("_types") <= LETTERS, F.col("_types")).otherwise(F.raise_error(F.lit("more than 26 types"))).alias("_types")
    )
    q = code_map.withColumn("_types", one_row(one)["_types"])
    q = _both_names(q.withColumn("options", shuffle_array("_types", seed, "value", F.lit("forward"))))
    return q.select(
        _question(C.ASK_TYPE, F.col("options"), query="query").alias("prompt"),
        X.expected_key("options", "type").alias("expected_key"),
        "options",
        F.col("type").alias("concept_type"),
        F.col("value").alias("concept_value"),
        F.col("code").alias("concept_value_synthetic"),
        "is_synthetic_query",
        F.lit("value_to_type").alias("direction"),
    )


def _spans(keyed: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Where rows that share ``by`` start in the order of ``by``, and how many they are; and where each of their hash buckets starts.

    Only counts are ordered: one row per group, and running sums by blocks of BLOCK groups.
    """
    buckets = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    groups = global_index(buckets.groupBy(*by).agg(F.sum("_n").alias("_own")), by, "_rank").withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    blocks = groups.groupBy("_block").agg(F.sum("_own").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_own").over(Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = groups.withColumn("_inside", inside).join(blocks.select("_block", before.alias("_before")), "_block")
    spans = placed.select(*by, (F.col("_before") + F.col("_inside")).alias("_start"), "_own")
    first = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = buckets.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate([*by, "_bucket"])], first.alias("_in"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(by)])
    starts = numbered.join(spans, same).select(*[f"_s{i}" for i in range(len(by) + 1)], (F.col("_start") + F.col("_in")).alias("_first"))
    return spans, starts


def sample_distractors(
    df: DataFrame, attr: str, n: int, seed: int | str, key: str | Sequence[str], carry: Sequence[str], within: str | None = None,
    name: str = "distractors",
) -> DataFrame:
    """Per row ``n`` different rows whose ``attr`` differs, as an array of ``carry`` structs.

    Rows get positions in (within, attr, seeded key) order. All rows that share
    a value then form one span and everything else is the rest of the circle,
    so the candidates of a row are a contiguous run of known length. That run is
    cut into ``n`` strata and one position is drawn from each: distinct by
    construction, every candidate reachable, no pairs compared. The draw is an
    equi-join on the position, n rows per row, whatever the value frequencies.
    ``key`` must identify a row (in its group); a repeated key is an error.
    """
    w = [within] if within else []
    keys = [key] if isinstance(key, str) else list(key)
    keyed = df.select(*dict.fromkeys([*keys, attr, *carry, *w])).withColumn("_okey", seeded_key(seed, *w, *keys))
    keyed = keyed.withColumn("_bucket", F.substring("_okey", 1, 2))
    spans, starts = _spans(keyed, [*w, attr])
    inside = F.row_number().over(Window.partitionBy(*w, attr, "_bucket").orderBy("_okey", *keys))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate([*w, attr, "_bucket"])])
    placed = keyed.withColumn("_inside", inside).join(starts, same).withColumn("_pos", F.col("_first") + F.col("_inside") - 1)
    if within:
        whole = spans.groupBy(within).agg(F.min("_start").alias("_base"), F.sum("_own").alias("_total"))
        spans = spans.join(whole, within)
    else:
        whole = spans.agg(F.min("_start").alias("_base"), F.sum("_own").alias("_total"))
        spans = spans.withColumn("_whole", one_row(whole)).select("*", "_whole._base", "_whole._total").drop("_whole")
    rest = F.col("_total") - F.col("_own")
    lo, hi = F.floor(rest * F.col("_j") / n), F.floor(rest * (F.col("_j") + 1) / n)
    offset = lo + F.pmod(seeded_int(seed, *w, *keys, "_j"), hi - lo)
    target = F.when(rest < n, F.raise_error(F.lit("fewer candidates than distractors"))).otherwise(
        F.col("_base") + F.pmod(F.col("_start") - F.col("_base") + F.col("_own") + offset, F.col("_total"))
    )
    asked = (
        keyed.select(*dict.fromkeys([*w, attr, *keys]))
        .join(spans, [*w, attr])
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(*w, *keys, "_j", target.cast("long").alias("_pos"))
    )
    drawn = placed.select("_pos", F.struct(*carry).alias("_item"))
    found = asked.join(drawn, "_pos").groupBy(*w, *keys).agg(F.sort_array(F.collect_list(F.struct("_j", "_item"))).alias("_drawn"))
    once = F.when(F.size("_drawn") == n, F.col("_drawn")).otherwise(F.raise_error(F.concat(F.lit("not the key of one row: "), F.concat_ws("|", *keys))))
    return found.select(*w, *keys, F.transform(once, lambda s: s["_item"]).alias(name))


def mc_type_to_value(code_map: DataFrame, n: int, seed: int) -> DataFrame:
    """``Which is a <type>?``: n - 1 options of other types, the right one at a seeded slot.

    The real and the code-name question share distractors and order. A value may
    occur under several types; each (type, value) is asked by itself.
    """
    others = sample_distractors(code_map, "type", n - 1, seed, ["type", "value"], ["value", "code"])
    own = F.struct("value", "code")
    slot = F.pmod(seeded_int(seed, "type", "value", F.lit("slot")), F.lit(n)).cast("int") + 1
    q = code_map.join(others, ["type", "value"]).withColumn("_opts", F.array_insert("distractors", slot, own))
    q = _both_names(q)
    options = F.transform("_opts", lambda o: F.when(F.col("is_synthetic_query"), o["code"]).otherwise(o["value"]))
    q = q.withColumn("options", options)
    return q.select(
        _question(C.ASK_VALUE, F.col("options"), type="type").alias("prompt"),
        X.expected_key("options", "query").alias("expected_key"),
        "options",
        F.col("type").alias("concept_type"),
        F.col("value").alias("concept_value"),
        F.col("code").alias("concept_value_synthetic"),
        "is_synthetic_query",
        F.lit("type_to_value").alias("direction"),
    )


# ------------------------------------------------------------------ entities
def _entity_rows(df: DataFrame, name: str, attrs: Sequence[str]) -> DataFrame:
    return unpivot_columns(df, [name, "description"], {a: a for a in attrs}, "concept_type", "concept_value")


def with_options(rows: DataFrame, options: DataFrame) -> DataFrame:
    """Attach natural value and option list from an (attribute, key, text) table."""
    lists = option_lists(options, "attribute", "text", "_pool")
    table = options.join(lists, "attribute").select(
        F.col("attribute").alias("concept_type"), F.col("key").alias("concept_value"), F.col("text").alias("_answer"), "_pool"
    )
    return rows.join(table, ["concept_type", "concept_value"], "left")


def _entity_question(q: DataFrame, name: str, direction: str, kind: Column, prompt: Column, answer) -> DataFrame:
    return q.select(
        prompt.alias("prompt"),
        X.expected_key("options", answer).alias("expected_key"),
        "options",
        F.lit(direction).alias("direction"),
        F.col(name).alias("name"),
        "concept_type",
        "concept_value",
        F.size("options").alias("num_options"),
        kind.alias("type"),
    )


def mc_entity_forward(
    df: DataFrame, options: DataFrame, labels: Mapping[str, str], synonyms: Mapping[str, Mapping[str, str]], seed: int, name: str = "name"
) -> DataFrame:
    """Entity -> attribute value, asked by name and by description."""
    rows = _entity_rows(df.withColumn("description", X.describe_attributes(df.columns, synonyms, labels)), name, list(labels))
    q = with_options(rows, options)
    q = q.withColumn("options", shuffle_array("_pool", seed, name, "concept_type", F.lit("forward")))
    label = X.lookup("concept_type", labels)
    by_name = _question(C.ASK_BY_NAME, F.col("options"), attribute=label, name=name)
    by_text = _question(C.ASK_BY_DESCRIPTION, F.col("options"), attribute=label, description="description")
    return _entity_question(q, name, "forward", F.lit("name"), by_name, "_answer").unionByName(
        _entity_question(q, name, "forward", F.lit("description"), by_text, "_answer")
    )


def mc_entity_reverse(
    df: DataFrame, options: DataFrame, labels: Mapping[str, str], synonyms: Mapping[str, Mapping[str, str]], n: int, seed: int, name: str = "name"
) -> DataFrame:
    """Attribute value -> which entity; distractors differ in that attribute.

    The option order is shared by the name and the description question. A name
    that stands for several entities is an error.
    """
    rows = _entity_rows(df.withColumn("description", X.describe_attributes(df.columns, synonyms, labels)), name, list(labels))
    others = sample_distractors(rows, "concept_value", n - 1, seed, name, [name, "description"], within="concept_type")
    natural = options.select(
        F.col("attribute").alias("concept_type"), F.col("key").alias("concept_value"), F.col("text").alias("_natural")
    )
    q = rows.join(others, ["concept_type", name]).join(natural, ["concept_type", "concept_value"], "left")
    pool = F.array_append("distractors", F.struct(name, "description"))
    tagged = F.transform(
        pool, lambda o: F.struct(seeded_key(seed, name, "concept_type", F.lit("reverse"), o[name]).alias("k"), o.alias("o"))
    )
    q = q.withColumn("_order", F.transform(F.sort_array(tagged), lambda s: s["o"]))
    label = X.lookup("concept_type", labels)
    person = lambda text: X.render_prompt(C.PERSON_WITH, description=text)
    kinds = F.array(
        F.struct(F.lit("name").alias("type"), F.col(name).alias("_target"), F.transform("_order", lambda o: o[name]).alias("options")),
        F.struct(F.lit("description").alias("type"), person("description").alias("_target"), F.transform("_order", lambda o: person(o["description"])).alias("options")),
    )
    asked = q.select("*", F.inline(kinds))  # one pass over the draws for both kinds
    prompt = _question(C.ASK_WHO, F.col("options"), value="_natural", attribute=label)
    return _entity_question(asked, name, "reverse", F.col("type"), prompt, "_target")


# ------------------------------------------------------- existing choice sets
def mc_from_choices(
    df: DataFrame, question: str = "question", choices: str = "choices", answer: str = "answer", keep: Sequence[str] = ("subject",)
) -> DataFrame:
    """Question, choices and answer index -> prompt and letter."""
    return df.select(
        _question(C.ASK_CHOICE, column(choices), question=question).alias("prompt"),
        F.get(X.option_keys(F.size(choices)), column(answer).cast("int")).alias("expected_key"),
        F.col(choices).alias("options"),
        *keep,
    )


def mc_union_configs(frames: Mapping[str, DataFrame], n_images: int = 7) -> DataFrame:
    """Per-subject sets -> one frame with ``field``; single-image choice questions, tags removed, options parsed."""
    united = None
    for field, df in frames.items():
        tagged = df.withColumn("field", F.lit(field))
        united = tagged if united is None else united.unionByName(tagged)
    rows = filter_single_image_mc(united, n_images)
    has_tag = F.when(
        F.col("question").contains("<image 1>"), X.strip_image_tags("question")
    ).otherwise(F.raise_error(F.lit("question without image tag")))
    rows = rows.withColumn("options", X.parse_literal_list("options")).withColumn("question", has_tag)
    shown = X.render_options("options", "paren")
    return rows.withColumn("prompt", X.render_prompt(C.ASK_IMAGE_CHOICE, question="question", options=shown)).withColumn(
        "expected_key", F.col("answer")
    )

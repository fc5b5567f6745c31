"""Golden row counts and contracts of the builders."""

import pytest
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom import registry
from evalloom.operators import choices, people, prompts, specs


@pytest.fixture(scope="module")
def code_map(spark):
    rows = [(t, v, c) for t, m in C.CODE_NAMES.items() for v, c in m.items()]
    return spark.createDataFrame(rows, "type string, value string, code string")


@pytest.fixture(scope="module")
def grid(spark, code_map):
    df = prompts.grid_of_values(spark, {t: list(m) for t, m in C.CODE_NAMES.items()})
    return prompts.add_code_names(df, code_map, list(C.CODE_NAMES)).cache()


def letters_ok(rows, answer):
    for r in rows:
        assert r.options[ord(r.expected_key) - ord("A")] == answer(r)
        assert f"{r.expected_key}: {answer(r)}\n" in r.prompt


def test_grid_has_840_rows(grid):
    assert grid.count() == 840 and grid.select("synthetic_shape").distinct().count() == 7


def test_unknown_value_has_no_code(spark, code_map):
    with pytest.raises(Exception, match="no code name"):
        prompts.add_code_names(spark.createDataFrame([("mauve",)], "color string"), code_map, ["color"]).collect()


def test_lookup(code_map):
    rows = choices.mc_lookup(code_map, 1).collect()
    assert len(rows) == 44 and sum(r.is_synthetic_query for r in rows) == 22
    letters_ok(rows, lambda r: r.concept_value if r.is_synthetic_query else r.concept_value_synthetic)
    assert sum(1 / n for n in (7, 6, 5, 4)) / 4 == pytest.approx(0.18988, abs=1e-5)


def test_type_questions_share_their_order(code_map):
    forward, reverse = choices.mc_value_to_type(code_map, 1).collect(), choices.mc_type_to_value(code_map, 4, 1).collect()
    assert len(forward) + len(reverse) == 88
    letters_ok(forward, lambda r: r.concept_type)
    letters_ok(reverse, lambda r: r.concept_value_synthetic if r.is_synthetic_query else r.concept_value)
    for rows in (forward, reverse):
        keys = {}
        for r in rows:
            keys.setdefault(r.concept_value, set()).add(r.expected_key)
        assert all(len(k) == 1 for k in keys.values())


def test_more_than_26_options_is_an_error(spark):
    df = spark.range(30).select(F.lit("t").alias("type"), F.col("id").cast("string").alias("value"), F.col("id").cast("string").alias("code"))
    with pytest.raises(Exception, match="more than 26 options"):
        choices.mc_lookup(df, 1).collect()


def test_entity_questions(spark):
    faces = prompts.grid_of_values(spark, {a: list(o) for a, o in C.ENTITY_OPTIONS.items()})
    faces = faces.withColumn("name", F.concat_ws(" ", *C.ENTITY_OPTIONS))
    options = spark.createDataFrame([(a, k, t) for a, o in C.ENTITY_OPTIONS.items() for k, t in o.items()], "attribute string, key string, text string")
    forward = choices.mc_entity_forward(faces, options, C.ENTITY_LABELS, C.ENTITY_SYNONYMS, 1)
    reverse = choices.mc_entity_reverse(faces, options, C.ENTITY_LABELS, C.ENTITY_SYNONYMS, 6, 1)
    both = forward.unionByName(reverse).collect()
    assert len(both) == 9600
    assert {r.num_options for r in both if r.direction == "reverse"} == {6}
    letters_ok([r for r in both if r.direction == "reverse" and r.type == "name"], lambda r: r.name)


def test_image_choices_and_choices(spark):
    schema = "question string, options string, answer string, question_type string, image_1 string, image_2 string"
    a = spark.createDataFrame([("See <image 1> it?", "['x', \"y's\"]", "B", "multiple-choice", "i", None), ("No <image 1>", "[]", "A", "open", "i", None)], schema)
    rows = choices.mc_union_configs({"art": a, "bio": a.limit(0)}, 2).collect()
    assert len(rows) == 1 and rows[0].field == "art" and rows[0].options == ["x", "y's"]
    assert rows[0].prompt.startswith("See it?\n\n(A) x\n(B) y's\n\nAnswer")
    q = spark.createDataFrame([("Q?", ["a", "b"], 1, "s")], "question string, choices array<string>, answer int, subject string")
    assert choices.mc_from_choices(q).first().expected_key == "B"


def test_repeated_prompts(spark):
    words = spark.createDataFrame([(w, c, C.WORD_TEMPLATES[w]) for w, c in C.WORDS.items()], "word string, code string, template string")
    df = prompts.repeated_prompts(words, C.REPEATS_PER_WORD)
    assert df.count() == 2048
    assert df.filter("prompt = 'Generate an image: A pair of secondary balance units.'").count() == 512


def test_permuted_prompts(grid):
    df = grid.limit(20).withColumn("id", F.concat_ws("-", *C.CODE_NAMES)).withColumn("image", F.col("id"))
    assert prompts.permuted_prompts(df, list(C.CODE_NAMES), 24, "words_only", False, 1, "id").distinct().count() == 480
    for bad in (("full_sentence", False), ("words_only", True)):
        with pytest.raises(ValueError):
            prompts.permuted_prompts(df, list(C.CODE_NAMES), 2, *bad, 1, "id")
    with pytest.raises(ValueError):
        prompts.permuted_prompts(df, list(C.CODE_NAMES), 1, "haiku", False, 1, "id")


def test_text_rows(code_map, grid):
    assert prompts.codebook_text(code_map).count() == 132
    anchors = prompts.anchor_rows(code_map).collect()
    assert len(anchors) == 22
    star = next(r for r in anchors if r.anchor_value == "star")
    assert star.prompt == "Generate the synthetic concept anchor: shape=sobilbasom, color=red, pattern=solid, position=top left."
    assert star.synthetic_color == "pectatinul" and star.synthetic_shape == "sobilbasom"
    train = grid.orderBy(*C.CODE_NAMES).limit(672)
    rows = prompts.composition_text(train, "train", list(C.CODE_NAMES))
    assert rows.count() == 1344 and rows.agg(F.max("composition_id")).first()[0] == 671


def test_training_mix_warns(spark):
    base = spark.range(40).select(F.concat(F.lit("b"), "id").alias("id"), F.lit("p").alias("prompt"), F.lit("i").alias("image"))
    aux = base.withColumn("id", F.concat(F.lit("x"), "id")).withColumn("extra", F.lit(1))
    with pytest.raises(ValueError, match="30 auxiliary validation rows"):
        prompts.training_mix(base, None, aux, 0.1, 5, 30, 1, "id")
    with pytest.warns(UserWarning):
        train, val = prompts.training_mix(base, None, aux, 0.1, 5, 30, 1, "id", lenient=True)
    assert train.count() == 44 and set(val) == {"train"} and val["train"].count() == 5


def test_no_caps(spark):
    values = spark.range(27).select(F.lit("t").alias("type"), F.format_string("v%02d", "id").alias("value"), F.format_string("c%02d", "id").alias("code"))
    assert prompts.codebook_text(values).count() == 27 * len(C.CODEBOOK_ROWS)
    attrs = [f"a{i}" for i in range(9)]
    wide = spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit("i").alias("image"), *[F.lit(a).alias(f"synthetic_{a}") for a in attrs])
    rows = prompts.permuted_prompts(wide, attrs, 5, "words_only", False, 1, "id", keep=("id",)).collect()
    assert len(rows) == 100 and all(sorted(r.prompt.split()) == attrs for r in rows)
    assert len({(r.id, r.prompt) for r in rows}) == 100
    assert prompts.permuted_prompts(wide, attrs, 1, "words_only", True, 1, "id").first().prompt == " ".join(attrs)
    assert prompts.attribute_grid(wide.select("id", F.col("id").alias("other")), ["id", "other"]).count() == 400
    with pytest.raises(ValueError, match="too large"):
        prompts.attribute_grid(wide.select("id"), ["id"], max_rows=19)


def test_orders_of_many_attributes(spark):
    """One rule for every number of attributes: all orders of a few, distinct ones of many, and every order is reachable."""
    for n, k in ((1, 1), (3, 6), (5, 120), (8, 50), (20, 40), (25, 40)):
        attrs = [f"w{i:02d}" for i in range(n)]
        df = spark.range(6).select("id", *[F.lit(a).alias(f"synthetic_{a}") for a in attrs])
        rows = prompts.permuted_prompts(df, attrs, k, "words_only", False, 3, "id", keep=("id",)).collect()
        assert len({(r.id, r.prompt) for r in rows}) == len(rows) == 6 * k
        assert all(sorted(r.prompt.split()) == attrs for r in rows)
        if n > 3:
            assert len({r.prompt.split()[0] for r in rows}) > 3 and len({r.prompt.split()[-1] for r in rows}) > 3
    with pytest.raises(ValueError, match="7 orders asked, there are 6"):
        prompts.permuted_prompts(spark.range(1), ["a", "b", "c"], 7, "words_only", False, 1, "id")


def test_grid_of_long_vocabularies(spark):
    """Values are rows, not lists; NULL is no value, and an attribute without values leaves no combination."""
    df = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("a"), F.when(F.col("id") < 5, F.col("id")).alias("b"), F.lit(None).cast("string").alias("none"))
    out = prompts.attribute_grid(df, ["a", "b"])
    assert out.count() == out.distinct().count() == 15_000 and out.filter("b is null").count() == 0
    assert "collect_" not in out._jdf.queryExecution().executedPlan().toString().replace("collect_list(_t", "")
    assert prompts.attribute_grid(df, ["a", "none"]).count() == 0


def test_specs_reject_unknown_keys(spark):
    df = spark.createDataFrame([('{"prompt":"p","tag":"t","other":1}',)], "value string")
    with pytest.raises(Exception, match="unknown key"):
        specs.parse_compositional_specs(df).collect()


def test_names(spark):
    first = spark.createDataFrame([("Ann ", "F", 1880, 1), ("Ann", "M", 1881, 1), ("Bea", "F", 1880, 2)], "name string, gender string, year int, line int")
    assert {r.name: r.gender for r in people.clean_first_names(first).collect()} == {"Ann": "M", "Bea": "F"}
    last = spark.createDataFrame([("SMITH", 1), ("ALL OTHER", 2), (None, 3)], "name string, n int")
    assert [r.name for r in people.clean_surnames(last).collect()] == ["Smith"]
    names, short = people.sample_unique_names(people.clean_first_names(first), people.clean_surnames(last), 5, "F", 1)
    assert names.count() == 1 and short == 4


def test_every_pair_of_names(spark):
    first = spark.createDataFrame([(f"F{i}", "F") for i in range(13)] + [("X", "M")], "name string, gender string")
    last = spark.createDataFrame([(f"L{i}",) for i in range(11)], "name string")
    for n, found, missing in ((143, 143, 0), (150, 143, 7), (20, 20, 0), (0, 0, 0)):
        names, short = people.sample_unique_names(first, last, n, "F", 5, allow_dup_parts=True)
        rows = names.collect()
        assert len({r.name for r in rows}) == len(rows) == found and short == missing
        assert sorted(r.pos for r in rows) == list(range(found))
    assert people.sample_unique_names(first, last, 3, "none", 5, allow_dup_parts=True)[1] == 3


def test_registry(code_map):
    assert "code_lookup_mc" in registry.available()
    assert registry.build("code_lookup_mc", code_map, seed=2).count() == 44
    with pytest.raises(ValueError, match="does not exist"):
        registry.build("nothing")


def test_names_run_out(spark):
    with pytest.raises(Exception, match="names run out"):
        prompts.assign_unique_names(spark.range(3), spark.createDataFrame([("a",), ("b",)], "name string"), "id", "name", 1).collect()

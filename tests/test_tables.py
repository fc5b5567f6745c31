"""Metrics, rubric documents, sequences and table operators on planted faults."""

import pytest
from pyspark.sql import functions as F

from evalloom import schemas
from evalloom.functions import sequences as Q
from evalloom.operators import joins, metrics, rubrics, sequences, shards, tabular


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# ----------------------------------------------------------------- metrics
def test_accuracy_of_unknown_groups(spark):
    df = spark.createDataFrame([("m-0", "a", None, "A"), ("m-0", "b", "A", "A"), ("m-1", "b", "B", "A")], "run string, kind string, grading_answer_key string, expected_key string")
    flags = metrics.answer_flags(df)
    acc = {(r.run, r.kind): (r.accuracy_full, r.accuracy_discounted) for r in metrics.accuracy_full_discounted(flags, ["run", "kind"]).collect()}
    assert acc == {("m-0", "a"): (0.0, None), ("m-0", "b"): (1.0, 1.0), ("m-1", "b"): (0.0, 0.0)}
    macro = metrics.macro_accuracy(flags, "run", "kind").first()
    assert macro.model == "m" and macro.accuracy_mean == 0.5 and macro.accuracy_sem == pytest.approx(0.5)


def test_sem_of_one_value_is_null(spark):
    r = metrics.mean_sem(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], ["v"]).first()
    assert (r.v_mean, r.v_sem) == (1.0, None)


def test_metric_of_nothing_is_zero(spark):
    m = spark.range(0).agg(metrics.metric(F.count("id"), F.count("id")).alias("m")).first().m
    assert (m.correct, m.total, m.accuracy) == (0, 0, 0.0)


def test_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "i int, c string, v double")
    with pytest.raises(Exception, match="duplicate cell"):
        metrics.pivot_metrics(df, ["i"], "c", "v", ["a"]).collect()
    melted = metrics.melt_metrics(spark.createDataFrame([(1, 0.5, 0.25)], "i int, a_acc double, b_acc double"), ["i"], "_acc")
    assert rows(melted) == [(1, "a", 0.5), (1, "b", 0.25)]


def test_order_and_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert [r.k for r in metrics.ordered_by_map(df, "k", ["c", "a"]).collect()] == ["c", "a"]
    with pytest.raises(ValueError, match="without rows"):
        metrics.ordered_by_map(df, "k", ["z"])
    assert rows(metrics.count_by(df, "k", ["a", "z"])) == [("a", 1), ("z", 0)]


def test_verdicts(spark):
    df = spark.createDataFrame([("r", "positive", None), ("r", "partial", None), ("r", None, "timeout")], "run string, grading_verdict string, grading_error string")
    assert rows(metrics.verdict_rate(df, ["run"])) == [("r", 0.5, 1)]
    bad = df.withColumn("grading_error", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="unknown verdict"):
        metrics.verdict_rate(bad, ["run"]).collect()


def test_attribute_space(spark):
    df = spark.createDataFrame([("p", "eye", v) for v in "abcd"] + [("p", "hair", v) for v in "xyz"] + [("s", "age", v) for v in "12"], "group string, attribute string, value string")
    combos = {r.group: r.combinations for r in metrics.attribute_space(df).filter("combinations is not null").collect()}
    assert combos == {"p": 12.0, "s": 2.0, "total": 24.0}


# ----------------------------------------------------------------- rubrics
def item(req, status):
    return (req, status, "")


@pytest.fixture(scope="module")
def docs(spark):
    data = [
        ("both", "1", ["p", "x"], ["x", "n"], ([item("p", "CORRECT"), item("x", "incorrect"), item("gone", "MISSING"), item("p", "CORRECT")], (2, 0, 1)), None),
        ("empty", "2", [], [], ([], (0, 0, 0)), ([], (1, 0, 0))),
        ("nulls", "3", None, None, None, None),
        ("ungraded", "4", ["a", "b", "b"], [], ([item("a", "CORRECT")], (1, 0, 0)), ([item("a", "MISSING")], (0, 0, 1))),
    ]
    return spark.createDataFrame(data, schemas.RUBRIC_DOC)


def test_recompute_and_summary(docs):
    s = {r.poster_id: r for r in rubrics.rebuild_summary(docs).collect()}
    both = s["1"].text_scores
    assert (both.correct, both.incorrect, both.missing) == (2, 1, 1) and both.correct_pct == 50.0
    assert both.positive_negative_breakdown.positive_correct == 2 and both.positive_negative_breakdown.positive_incorrect == 1
    assert both.positive_negative_breakdown.negative_incorrect == 0  # a text in both lists counts as positive
    assert s["3"].summary.total_requirements == 0 and s["2"].text_scores.correct_pct == 0.0
    assert s["1"].summary.positive_negative_breakdown.rubric_counts.negative_rubric == 2


def test_drop_invalid(docs):
    fixed, log = rubrics.drop_invalid_items(docs)
    assert rows(log, "poster_id", "modality", "requirement", "action") == [("1", "text", "gone", "removed")]
    kept = {r.poster_id: r.text_fulfillment for r in fixed.collect()}
    assert len(kept["1"].text_fulfillment_analysis) == 3 and kept["3"] is None


def test_irregularities(docs):
    found = rubrics.find_irregularities(docs)
    assert rows(found, "poster_id", "type") == [
        ("1", "duplicate_requirements"), ("1", "ungraded_requirements"), ("2", "image_score_mismatch"), ("2", "no_requirements"),
        ("3", "missing_negative_requirements"), ("3", "missing_positive_requirements"), ("3", "no_requirements"),
        ("4", "duplicate_requirements"), ("4", "ungraded_requirements"),
    ]
    report = {r.type: (r.instances, r["items"]) for r in rubrics.irregularity_report(found).collect()}
    assert report[None] == (9, 4) and report["duplicate_requirements"] == (2, 2)


def test_strict_fulfilment(spark):
    reqs = spark.createDataFrame([("1", "positive", "a"), ("1", "negative", "n")], "poster_id string, kind string, requirement string")

    def graded(a, n, extra=()):
        data = [("1", m, r, s) for m in ("text", "image") for r, s in (("a", a), ("n", n), *extra)]
        return spark.createDataFrame(data, "poster_id string, modality string, requirement string, status string")

    counts = rubrics.fulfilment_counts(reqs, graded("MISSING", "INCORRECT"))
    r = rubrics.severity_rates(rubrics.error_rates(counts)).filter("modality = 'text'").first()
    assert (r.hallucination, r.omission, r.minor, r.major) == (0.5, 0.5, 0.0, 1.0)
    for bad, text in (
        (graded("CORRECT", "MISSING"), "missing negative"), (graded("Correct", "CORRECT"), "unknown status"),
        (graded("CORRECT", "CORRECT", [("a", "CORRECT")]), "exactly once"),
    ):
        with pytest.raises(Exception, match=text):
            rubrics.fulfilment_counts(reqs, bad).collect()
    with pytest.raises(Exception, match="no positive"):
        rubrics.fulfilment_counts(reqs.filter("kind = 'negative'"), graded("CORRECT", "CORRECT")).collect()
    only = rubrics.severity_rates(rubrics.fulfilment_counts(reqs.filter("kind = 'positive'"), graded("CORRECT", "CORRECT"))).first()
    assert only.major is None


def test_positional(docs):
    r = rubrics.positional_breakdown(docs).filter("poster_id = '1'").first()
    assert (r.text_positive_correct, r.text_positive_incorrect, r.text_negative_correct, r.text_negative_incorrect) == (1, 1, 1, 1)


def test_statements(spark):
    raw = ['["long enough", "tiny", null]', '{"positive": ["long enough"], "negative": ["never ever"]}', '{"positive": ["long enough"]}', "x", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", rubrics.filter_statements("raw").alias("s"))
    got = [(r.s.positive, r.s.negative) for r in df.orderBy("i").collect()]
    assert got == [(["long enough"], []), (["long enough"], ["never ever"]), ([], []), ([], []), ([], [])]


# --------------------------------------------------------------- sequences
def test_markers(spark):
    df = spark.createDataFrame([([1, 3, 9, 4, 3, 9, 5],), ([3, 9],), ([1, 2],)], "ids array<int>")
    masked = df.select(Q.mask_before_marker("ids", [3, 9], strict=False).alias("m")).collect()
    assert [r.m for r in masked] == [[-100, -100, -100, 4, 3, 9, 5], [-100, -100], None]
    with pytest.raises(Exception, match="marker not found"):
        df.select(Q.mask_before_marker("ids", [3, 9])).collect()
    with pytest.raises(Exception, match="not the end id"):
        df.select(Q.swap_terminator("ids", F.lit(True), 7, 8)).collect()
    e = df.select(Q.expand_placeholder("ids", 3, 0, 2, 7, 8, keep=True).alias("e")).first().e
    assert e.input_ids == [1, 3, 7, 0, 0, 8, 9, 4, 3, 7, 0, 0, 8, 9, 5] and e.n_images == 2


def test_encode_turns(spark):
    schema = "conv_id int, turn int, input_ids array<int>, output_ids array<int>, output_with_loss boolean, need_eos boolean, sep_ids array<int>"
    data = [(1, 1, [10], [11], None, False, None), (1, 2, [20], None, None, None, None), (1, 3, [30], [31], False, True, [5]), (1, 4, [40], [41], True, True, None)]
    r = sequences.encode_turns(spark.createDataFrame(data, schema), [1], [2]).first()
    assert r.input_ids == [1, 10, 11, 20, 30, 31, 2, 5, 1, 40, 41, 2]
    assert r.labels == [-100, -100, 11, -100, -100, -100, -100, -100, -100, -100, 41, 2]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1], [1]), (0, [1, 2, 3], [-100, 2, 3]), (1, [5], [5])], "batch int, input_ids array<int>, labels array<int>")
    left = sequences.pad_batch(df, "batch", 0, "left", 2).collect()
    assert sorted((r.batch, r.input_ids, r.labels, r.attention_mask) for r in left) == [(0, [0, 1], [-100, 1], [0, 1]), (0, [1, 2], [-100, 2], [1, 1]), (1, [5], [5], [1])]


def test_padded_texts_are_the_padded_ids(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3]), (2, 0, [7]), (3, 0, []), (4, 0, None), (5, 1, [8]), (6, 2, []), (7, 3, None)], "k int, batch int, input_ids array<int>")
    df = df.withColumn("labels", F.col("input_ids"))
    for side in ("right", "left"):
        for max_len in (None, 2):
            names = ["input_ids", "labels", "attention_mask"]
            ids = sequences.pad_batch(df, "batch", 0, side, max_len).select("k", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in names])
            texts = sequences.pad_batch(df, "batch", 0, side, max_len, joined=",")
            assert sorted(ids.collect()) == sorted(texts.select("k", *names).collect())
            assert "array_repeat" not in texts._jdf.queryExecution().optimizedPlan().toString()


def test_chat(spark):
    df = spark.createDataFrame([(1, 0, "user", " hi "), (1, 1, "assistant", "")], "conv_id int, turn int, role string, text string")
    assert sequences.render_chat(df).first().rendered == "User: hi\n\nAssistant:"
    many = spark.range(120_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    assert sequences.render_chat(many).select(F.length("rendered")).first()[0] > 120_000 * 7


# ------------------------------------------------------------ table operators
def test_gates_and_prefixes(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "run string, grading_error string")
    with pytest.raises(ValueError, match="errors in run 'b'"):
        tabular.gate_errors(df, "run")
    assert tabular.gate_errors(df.filter("run = 'a'"), "run").count() == 1
    with pytest.raises(ValueError):
        tabular.prefix_columns(df.withColumn("error", F.lit(1)), "grading_", ["error"])
    with pytest.raises(ValueError):
        schemas.check_prefixes(df, ["grading_error"])
    with pytest.raises(ValueError, match="not a result column"):
        schemas.check_prefixes(df, ["answer"])


def test_several_patches_per_run(spark):
    df = spark.createDataFrame([("r", "E: one", None, "bad"), ("r", "F: two", None, "bad"), ("r", "E: ok", "A", None), ("s", "E: one", None, "bad")], "run string, text string, value string, grading_error string")
    patches = spark.createDataFrame([("r", "E: ", "E"), ("r", "F: ", "F")], "run string, prefix string, value string")
    got = rows(tabular.patch_known_rows(df, patches, "run", "text", "value").fillna("-"), "run", "text", "value", "grading_error")
    assert got == [("r", "E: ok", "A", "-"), ("r", "E: one", "E", "-"), ("r", "F: two", "F", "-"), ("s", "E: one", "-", "bad")]


def test_joins(spark):
    names = spark.createDataFrame([("0001", "Mr", "Ms")], "id string, name_male string, name_female string")
    faces = spark.createDataFrame([("face_0001.png", "male"), ("face_0001.png", "female")], "image_name string, gender string")
    assert rows(joins.assign_names(faces, names), "name") == [("Mr",), ("Ms",)]
    with pytest.raises(Exception, match="no name for"):
        joins.assign_names(faces.withColumn("image_name", F.lit("x.png")), names).collect()
    acc = spark.createDataFrame([("r", 0.5)], "run string, a double")
    other = acc.withColumnRenamed("a", "b")
    for right in (other.filter("false"), other.union(other)):
        with pytest.raises(Exception, match="partners of a row"):
            joins.modality_join(acc, right, ["run"]).collect()
    left, right = acc.union(acc.withColumn("run", F.lit("s"))), other.union(other)
    with pytest.raises(Exception, match="partners of a row"):  # one missing and one twice
        joins.modality_join(left, right, ["run"]).collect()
    assert joins.modality_join(acc, other, ["run"]).first().b == 0.5
    text = spark.createDataFrame([("color", "c1", True, True)], "concept_type string, concept_value_synthetic string, is_synthetic_query boolean, grading_correct boolean")
    image = spark.createDataFrame([("s1", 0, "test", "p", "red", "c1", "red", True, True), ("s2", 1, "test", "p", "red", "c9", None, True, True)],
        "sample_id string, dataset_index int, split string, prompt string, color string, synthetic_color string, grading_detected_color string, grading_correct_color boolean, grading_all_correct boolean")
    cases = {r.sample_id: (r.text_correct_color, r.image_correct_text_wrong, r.image_attr_correct_text_wrong_attrs) for r in joins.case_table(image, text, "r", ["color"]).collect()}
    assert cases == {"s1": (True, False, []), "s2": (False, True, ["color"])}


def test_recover(spark):
    plan = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "id string, pos int")
    done = spark.createDataFrame([("s1", 2, "late"), ("s1", 1, "early"), ("s4", 1, "x"), ("unknown", 1, "y")], "id string, src int, answer string")
    got, rest, manifest = shards.recover_and_split(plan, done, 3, "id", ["src"], ["pos"])
    assert rows(got, "id", "answer") == [("s1", "early"), ("s4", "x")]
    m = manifest.first()
    assert (m.total_rows, m.recovered_rows, m.remaining_rows, m.residual_counts) == (10, 2, 8, [3, 3, 2])
    assert rest.count() == 8 and shards.check_complete(plan, plan, "id").count() == 0


def test_crop_modes(spark):
    df = spark.createDataFrame([(1, 100, 50)], "id int, width int, height int")
    c = tabular.crop_resize_plan(df, "center_square", 64).first()
    assert (c.crop_left, c.crop_top, c.crop_right, c.crop_bottom) == (25.0, 0.0, 75.0, 50.0)
    s = tabular.crop_resize_plan(df, "shorter_side", 512).first()
    assert (s.target_width, s.target_height) == (1024, 512)
    with pytest.raises(ValueError):
        tabular.crop_resize_plan(df, "spiral", 1)

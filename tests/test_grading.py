"""Graders on planted answers, verdicts and detections."""

import pytest
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.functions import text as X
from evalloom.operators import detections, grading

OPTIONS = ["red star", "blue circle", "a (tiny) star", "Ärger"]


def answers(spark, *texts, options=OPTIONS, expected="A"):
    rows = [(i, t, options, expected) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, inference_completion string, options array<string>, expected_key string")


def column(df, name):
    return [r[0] for r in df.orderBy("i").select(name).collect()]


def test_strict(spark):
    df = grading.grade_letter_strict(answers(spark, " b\n", "E", " c ", "A.", "", "?", "é", None))
    assert column(df, "grading_answer_key") == ["B", None, "C", None, None, None, None, None]
    assert column(df, "grading_format_correct") == [True, False, True, False, False, False, False, False]
    assert column(df, "grading_format_error")[1] == "Invalid option: E" and column(df, "grading_format_error")[5] == "Invalid option: ?"
    assert column(df, "needs_judge") == [False, False, False, True, True, False, False, False]


def test_lenient(spark):
    cases = {
        " a ": ("A", None), "I say (B)!": ("B", grading.FROM_LETTER), "A or B": (None, grading.UNCLEAR), "B, yes B": ("B", grading.FROM_LETTER),
        "it is a big one": ("A", grading.FROM_LETTER),  # the word "a" reads as a letter
        "the blue, circle": (None, grading.UNCLEAR), "The BLUE circle!": ("B", grading.FROM_TEXT), "bluecircle": (None, grading.UNCLEAR),
        "red star blue circle": (None, grading.UNCLEAR), "F": (None, grading.UNCLEAR), "ÉA ist nichts": (None, grading.UNCLEAR),
        "": (None, grading.UNCLEAR), "x_B y": (None, grading.UNCLEAR),
    }
    df = grading.grade_letter_lenient(answers(spark, *cases))
    got = dict(zip(cases, zip(column(df, "grading_answer_key"), column(df, "grading_format_error"))))
    assert got == cases
    assert column(df, "grading_correct") == [k == "A" for k, _ in cases.values()]


def test_mc_verdict(spark):
    v = {
        '{"answer_key": "B", "format_error": null}': ("B", None, None), '{"answer_key": null, "format_error": "two"}': (None, "two", None),
        '{"answer_key": null, "format_error": null}': (None, None, "no verdict values"), '{"answer_key": "A", "format_error": "x"}': (None, None, "both verdict values set"),
        '{"answer_key": "b", "format_error": null}': (None, None, "invalid answer key"), '{"answer_key": "Z", "format_error": null}': (None, None, "invalid answer key"),
        '{"answer_key": "AB", "format_error": null}': (None, None, "invalid answer key"), '{"answer_key": "A"}': (None, None, "invalid verdict keys"),
        '{"answer_key": "A", "format_error": null, "x": 1}': (None, None, "invalid verdict keys"), '{"answer_key": 1, "format_error": null}': (None, None, "invalid verdict types"),
        '{"answer_key": null, "format_error": 5}': (None, None, "invalid verdict types"), "nonsense": (None, None, "not a JSON object"), "[1]": (None, None, "not a JSON object"),
    }
    df = grading.parse_mc_verdict(answers(spark, *v), "inference_completion")
    got = zip(column(df, "grading_answer_key"), column(df, "grading_format_error"), column(df, "grading_error"))
    assert dict(zip(v, got)) == v
    assert not any(column(df, "grading_format_correct"))


def test_attribute_verdict(spark):
    good = '{"eye_color": "`brown`", "hair_color": null, "hair_style": "buzz cut", "accessories": "scarf around neck"}'
    df = grading.parse_attribute_verdict(answers(spark, good, good.replace("brown", "violet"), '{"eye_color": null}', "{"), "inference_completion", C.ENTITY_OPTIONS)
    maps = column(df, "grading_inferred_attributes")
    assert maps[0] == {"eye_color": "dark_brown", "hair_color": None, "hair_style": "buzz_cut", "accessories": "scarf_neck_face"}
    assert maps[1:] == [None] * 3
    assert column(df, "grading_error") == [None, "Invalid attribute value: violet", "invalid attribute keys", "not a JSON object"]


def test_enum_and_scores(spark):
    df = grading.parse_enum_verdict(answers(spark, '{"verdict": "partial"}', '{"verdict": "odd"}', "x"), "inference_completion")
    assert column(df, "grading_verdict") == ["partial", None, None] and column(df, "grading_error")[0] is None
    raw = 'Here: {"textual_analysis": "two\nlines", "scores": {"present_and_accurate": 0.5}} bye'
    df = grading.parse_judge_scores(answers(spark, raw, "none", '{"scores": {}}', None), "inference_completion")
    first, *bad = column(df, "comparison")
    assert first.textual_analysis == "two\nlines" and first.scores == {"present_and_accurate": 0.5} and not first.failed
    assert all(b.failed and b.scores == C.NO_SCORES for b in bad)
    assert bad[1].textual_analysis.startswith("Invalid response structure: ")


def test_judge_errors_stay_in_their_row(spark):
    def judge(row):
        if row["i"] == 1:
            raise RuntimeError("quota")
        return {"key": row["inference_completion"].upper()}

    whole = spark.createDataFrame([(9007199254740993,), (None,)], "n long")
    echo = grading.with_judge(whole.coalesce(1), lambda row: {"same": row["n"]}, "same long")
    assert [(r.n, r.same) for r in echo.collect()] == [(9007199254740993, 9007199254740993), (None, None)]
    df = grading.with_judge(answers(spark, "a", "b", "c").repartition(2), judge, "key string", 2)
    assert column(df, "key") == ["A", None, "C"] and column(df, "grading_error") == [None, "Failed to query judge: quota", None]


def test_judge_calls_run_ahead_across_batches(spark, tmp_path):
    """The first row waits for a call of a later Arrow batch: only a window over batches lets it end."""
    flag = str(tmp_path / "later")

    def judge(row):
        import pathlib
        import time

        if row["id"] == 9:
            pathlib.Path(flag).touch()
        for _ in range(200 if row["id"] == 0 else 0):
            if pathlib.Path(flag).exists():
                return {"v": 1}
            time.sleep(0.05)
        return {"v": 0 if row["id"] == 0 else 2}

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = grading.with_judge(spark.range(20).coalesce(1), judge, "v int", 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r.id for r in rows] == list(range(20)) and [r.v for r in rows] == [1] + [2] * 19


def test_judge_retries(spark, tmp_path):
    def judge(row):
        import pathlib

        seen = pathlib.Path(f"{tmp_path}/{row['id']}")
        seen.write_text((seen.read_text() if seen.exists() else "") + "x")
        if len(seen.read_text()) <= row["id"]:
            raise RuntimeError("busy")
        return {"v": len(seen.read_text())}

    rows = grading.with_judge(spark.range(5).coalesce(1), judge, "v int", 2, retries=2).collect()
    assert [r.v for r in rows] == [1, 2, 3, None, None] and rows[4].grading_error == "Failed to query judge: busy"
    assert all(len((tmp_path / str(i)).read_text()) == min(i + 1, 3) for i in range(5))


def test_ledger_survives_a_failed_start(spark, tmp_path):
    """A task dies half-way; the next start calls only keys without an answer, and the failed ones again."""
    log, ledger, gone = tmp_path / "calls", str(tmp_path / "ledger"), tmp_path / "fixed"

    def judge(row):
        with open(f"{log}-{row['id']}", "a") as f:
            f.write("x")
        if not gone.exists():
            if row["id"] == 7:
                raise SystemExit("lost")  # ends the worker, not only the call
            if row["id"] % 10 == 3:
                raise RuntimeError("refused")
        return {"v": row["id"] * 2}

    df = spark.range(40).repartition(4)
    part = {r.id: r.p for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("p")).collect()}
    with pytest.raises(Exception, match="SystemExit|lost|crashed"):
        grading.judge_with_ledger(df, "id", judge, "v long", ledger, parts=8, max_in_flight=2)
    gone.touch()
    for _ in range(2):
        out = {r.id: r for r in grading.judge_with_ledger(df, "id", judge, "v long", ledger, parts=8, max_in_flight=2).collect()}
        assert {i: r.v for i, r in out.items()} == {i: 2 * i for i in range(40)} and not any(r.grading_error for r in out.values())
    calls = {i: len(open(f"{log}-{i}").read()) for i in range(40)}
    for i in range(40):
        if part[i] != part[7]:
            assert calls[i] == (2 if i % 10 == 3 and part[i] < part[7] else 1)
    assert grading.judge_with_ledger(df.filter("false"), "id", judge, "v long", str(tmp_path / "none"), parts=2).count() == 0


def test_text_helpers(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first().x

    assert value(X.option_keys(F.lit(0))) == [] and value(X.option_keys(F.lit(3))) == ["A", "B", "C"]
    with pytest.raises(Exception, match="not an option"):
        value(X.expected_key(F.array(F.lit("x")), F.lit("y")))
    assert value(X.strip(F.lit("\n  x y \t"))) == "x y"
    assert value(X.strip_trailing_pads(F.lit("a</s>b</s></s>"), "</s>")) == "a</s>b"
    assert value(X.parse_literal_list(F.lit("""['a', "it's", 'c d']"""))) == ["a", "it's", "c d"]
    assert value(X.id_from_file_name(F.lit("face_0012.png"))) == "0012" and value(X.id_from_file_name(F.lit("x.png"))) == "0000"
    assert value(X.sample_id("image", F.lit("test"), F.lit(123456), 4)) == "image_test_123456"
    assert value(X.bucket_path(F.lit(12345))) == "0012/12345.jpg"
    assert value(X.display_title(F.lit("Some Film - Part (1999)"))) == "Some Film"
    assert value(X.json_block(F.lit("a [1, [2]] b"), "[", "]")) == "[1, [2]]" and value(X.json_block(F.lit("none"))) is None
    assert value(X.escape_newlines_in_strings(F.lit('{\n"a": "x\ny", "b": "q\\"\nz"}'))) == '{\n"a": "x\\ny", "b": "q\\"\\nz"}'
    with pytest.raises(Exception, match="image tag left"):
        value(X.strip_image_tags(F.lit("see <image 1> and <image one>")))
    assert value(X.classify_refusal(F.lit(" i cannot generate images of harmful content.\n"))) == "refusal"
    assert value(X.classify_refusal(F.lit("well <begin_of_image>"))) == "affirmative" and value(X.classify_refusal(F.lit("no"))) == "unknown"


# -------------------------------------------------------------- detections
def boxes(spark, rows):
    schema = "image_id string, class string, x0 double, y0 double, x1 double, y1 double, score double, color string, det_id long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def test_threshold_and_top_16(spark):
    det = boxes(spark, [("i", "cup", 0.0, 0.0, 1.0, 1.0, 0.3 + i / 100, "red") for i in range(40)])
    ranked = detections.filter_detections(det)
    assert ranked.count() == 16 and ranked.agg(F.min("score")).first()[0] == pytest.approx(0.54)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().simpleString()
    assert detections.filter_detections(det, F.lit(True)).count() == 0


def test_suppression(spark):
    det = boxes(spark, [("i", "cup", 0.0, 0.0, 99.0, 99.0, 0.9, "r"), ("i", "cup", 0.0, 0.0, 99.0, 89.0, 0.8, "r"), ("i", "cup", 200.0, 0.0, 299.0, 99.0, 0.7, "r"), ("j", "cup", 0.0, 0.0, 9.0, 9.0, 0.6, "r")])
    ranked = detections.filter_detections(det)
    assert sorted(r.det_id for r in detections.suppress_overlaps(ranked, 0.5).collect()) == [0, 2, 3]
    assert detections.suppress_overlaps(ranked, 1.0).count() == 4


SPEC = """image_id string, include array<struct<class string, count int, color string, position struct<relation string, object_idx int>>>,
    exclude array<struct<class string, count int, color string, position struct<relation string, object_idx int>>>"""


def test_compositional(spark):
    det = boxes(spark, [("i", "cup", 0.0, 0.0, 10.0, 10.0, 0.9, "red"), ("i", "cup", 0.0, 50.0, 10.0, 60.0, 0.8, "blue"), ("i", "dog", 100.0, 0.0, 110.0, 10.0, 0.9, "brown")])
    dog = ("dog", 1, None, None)
    specs = {
        "fine": ([dog, ("cup", 1, "red", ("left of", 0))], []), "few": ([("cup", 3, None, None)], []), "color": ([("cup", 2, "red", None)], []),
        "place": ([dog, ("cup", 1, None, ("right of", 0))], []), "no target": ([("cat", 1, None, None), ("cup", 1, None, ("left of", 0))], []),
        "crowd": ([dog], [("cup", 2, None, None)]), "color first": ([dog, ("cup", 1, "blue", ("right of", 0))], []), "empty": ([], []),
    }
    names = list(specs)
    det = det.crossJoin(spark.createDataFrame([(n,) for n in names], "n string")).withColumn("image_id", F.col("n"))
    df = spark.createDataFrame([(n, *specs[n]) for n in names], SPEC)
    got = {r.image_id: (r.grading_correct, r.grading_reason) for r in detections.grade_compositional(df, detections.filter_detections(det)).collect()}
    assert got["fine"] == (True, "") and got["empty"] == (True, "")
    assert got["few"] == (False, "expected cup>=3, found 2")
    assert got["color"] == (False, "expected red cup>=2, found 1 red; and 1 red, 1 blue")
    assert got["place"] == (False, "expected cup right of target, found left of target")
    assert got["no target"] == (False, "expected cat>=1, found 0\nno target for cup to be left of")
    assert got["crowd"] == (False, "expected cup<2, found 2")
    assert got["color first"] == (False, "expected blue cup>=1, found 0 blue; and 1 red")


def test_lenient_options_normalised_together(spark):
    """Options that are null, empty, hold the character they are joined by, or lie beyond the option letters; blank answers."""
    rows = [
        (1, "I pick red-ish Bus.", ["Red ish bus", None, "", "tram"], "A"), (2, "it was one\x01two", ["zero", "one\x01two"], "B"), (3, "the tram", [None, "tram"], "B"),
        (4, "  ", ["x y"], None), (5, "so: C or é", ["p", "q"], None), (6, "(b), B!", ["p", "q"], "B"), (7, "B_2 not", ["p", "q"], None), (8, "A or B", ["p", "q"], None),
        (9, None, ["p"], None), (10, "anything", [], None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, inference_completion string, options array<string>").withColumn("expected_key", F.lit("A"))
    got = {r.id: r.grading_answer_key for r in grading.grade_letter_lenient(df).collect()}
    assert got == {r[0]: r[3] for r in rows}
    plan = grading.grade_letter_lenient(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(lower(array_join(") >= 1 and "split(_upper" not in plan

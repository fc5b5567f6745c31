"""Readers, writers, images and streams over files made by the test."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import grading, images, shards
from evalloom.plans import joining
from evalloom.plans.common import derive
from evalloom.sinks import writers
from evalloom.sources import readers
from evalloom.streaming import results


def write_png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def scene(color=(255, 255, 255), square=None, size=128):
    img = np.full((size, size, 3), color, np.uint8)
    for x, y in square or []:
        img[y : y + 40, x : x + 40] = 0
    return img


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": null}\n')
    assert sorted(str(r.a) for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == ["1", "None"]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").collect() == []
    writers.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": None}


def test_lines_and_documents(spark, tmp_path):
    (tmp_path / "l.txt").write_text("one\n\n  \nzwei ü\n")
    assert [(r.line, r.value) for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == [(0, "one"), (3, "zwei ü")]
    (tmp_path / "m.json").write_text(json.dumps({"posters": {"p1": {"n": 1}, "p2": {"n": 2}}}))
    (tmp_path / "n.json").write_text(json.dumps({"posters": [{"n": 3}]}))
    rows = readers.read_keyed_documents(spark, str(tmp_path / "*.json"), "posters", "n int").collect()
    assert {(r.doc_key, r.n) for r in rows} == {("p1", 1), ("p2", 2), ("0", 3)}
    arrays = tmp_path / "arrays"
    arrays.mkdir()
    (arrays / "x.json").write_text('[{"n": 1},\n {"n": 2}]')
    (arrays / "y.json").write_text('[{"n": 3}]')
    (arrays / "z.txt").write_text("[]")
    assert sorted(r.n for r in readers.read_json_arrays(spark, str(arrays), "n int").collect()) == [1, 2, 3]


def test_yearly_csv_runs_and_sources(spark, tmp_path):
    (tmp_path / "yob1880.txt").write_text("Ann,F,7\n")
    (tmp_path / "yob1881.txt").write_text("Ann,M,2\nBob,M,1\n")
    rows = readers.read_yearly_csv(spark, f"{tmp_path}/yob*.txt", "name string, gender string, count int").collect()
    assert {(r.name, r.year) for r in rows} == {("Ann", 1880), ("Ann", 1881), ("Bob", 1881)}
    runs = tmp_path / "runs"
    runs.mkdir()
    for name in ("alpha_exp_0.jsonl", "beta_exp_1.jsonl", "held_exp_2.jsonl"):
        (runs / name).write_text('{"v": 1}\n')
    expected = spark.createDataFrame([("alpha", "exp", "0"), ("gamma", "exp", "0")], "model string, experiment string, seed string")
    df, missing = readers.read_runs(spark, f"{runs}/*.jsonl", "v int", expected=expected)
    assert {(r.model, r.seed) for r in df.collect()} == {("alpha", "0"), ("beta", "1"), ("held", "2")}
    assert [r.model for r in missing.collect()] == ["gamma"]
    kept = readers.read_with_source(spark, str(runs), "v int", "held").collect()
    assert {r.source for r in kept} == {"alpha_exp_0", "beta_exp_1"}


def test_shards(spark, tmp_path):
    for shard, lines in (("0", ['{"sample_id": "a", "v": 1}', "", '{"sample_id": "b", "v": 2}']), ("10", ['{"sample_id": "a", "v": 3}']), ("x", ['{"sample_id": "c", "v": 4}'])):
        d = tmp_path / f"shard_{shard}" / "run"
        d.mkdir(parents=True)
        (d / "f.jsonl").write_text("\n".join(lines) + "\n")
    df = readers.read_shards(spark, str(tmp_path), "run", "f.jsonl", "sample_id string, v int")
    assert sorted((r.shard, r.line, r.v) for r in df.collect()) == [(0, 0, 1), (0, 2, 2), (10, 0, 3), (10**9, 0, 4)]
    from evalloom.operators.shards import dedupe_last

    last = {r.sample_id: (r.v, r.first_seen.shard) for r in dedupe_last(df, "sample_id", ["shard", "file", "line"]).collect()}
    assert last == {"a": (3, 0), "b": (2, 0), "c": (4, 10**9)}
    assert readers.read_shards(spark, str(tmp_path), "other", "f.jsonl", "sample_id string, v int").collect() == []


def test_numbered_lines_of_files_in_many_splits(spark, tmp_path):
    """Files of several splits, with blank lines, CR LF, no last line break and lines longer than a split."""
    texts = {"a.txt": "".join(f"a{i}" + " x" * (i % 50) + "\n" for i in range(3000)), "b.txt": "\n\nb\r\n" * 700, "c.txt": "one\n" + "y" * 9000 + "\nlast", "d.txt": "", "e.txt": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    expected = sorted((n, k, v.removesuffix("\r")) for n, t in texts.items() for k, v in enumerate(t.removesuffix("\n").split("\n") if t else []))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("1500", "64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            df = readers.numbered_lines(spark, str(tmp_path))
            got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in df.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        assert got == expected
        assert size != "1500" or df.rdd.getNumPartitions() > 1


def test_merge_of_shards_read_in_splits(spark, tmp_path):
    """The last line of the last shard wins, through files of several splits."""
    for shard in range(3):
        (tmp_path / f"shard_{shard}" / "run").mkdir(parents=True)
        (tmp_path / f"shard_{shard}" / "run" / "f.jsonl").write_text("".join(json.dumps({"sample_id": f"s{i % 40}", "v": shard * 1000 + i, "split": "t", "dataset_index": i % 40}) + "\n" for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = readers.read_shards(spark, str(tmp_path), "run", "f.jsonl", "sample_id string, v int, split string, dataset_index int")
        got = shards.merge_shards(rows).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.dataset_index, r.v) for r in got] == [(i, 2160 + i) for i in range(40)]


def test_run_outputs(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    text, image = derive(spark, sf, joining.TEXT_ROWS), derive(spark, sf, joining.IMAGE_ROWS)
    writers.write_run_outputs(str(tmp_path / "run"), "run-0", text, image)
    assert spark.read.text(str(tmp_path / "run/case_table")).count() == image.count()
    summary = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "run/summary"), wholetext=True).collect()))
    assert summary["run"] == "run-0" and len(summary["per_attribute_image_text_accuracy"]) == 4 and len(summary["cases"]) == 15


def test_outputs_of_several_runs(spark, tmp_path):
    """Three runs: every output read back, field by field against the operators, and the summary over all of them."""
    from evalloom.operators import joins, metrics

    sf = "/root/testdata/sf0.001"
    text, image = derive(spark, sf, joining.TEXT_ROWS).persist(), derive(spark, sf, joining.IMAGE_ROWS).persist()
    runs = {name: (text.filter(F.pmod(F.xxhash64("concept_value_synthetic"), F.lit(4)) != k), image.filter(F.pmod(F.xxhash64("sample_id"), F.lit(3)) == k)) for k, name in enumerate(("b-run", "a-run", "c-run"))}
    writers.write_runs(str(tmp_path), runs)

    def same(folder, expected):
        back = spark.read.schema(expected.schema).option("mode", "FAILFAST").json(f"{tmp_path}/{folder}")
        assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect())) and back.count() > 0

    def document(folder):
        return json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/{folder}/summary", wholetext=True).collect()))

    own = {}
    for name, (t, i) in runs.items():
        same(f"{name}/text_memory", t)
        same(f"{name}/image_memory", i)
        own[name] = joins.case_table(i, t, name)
        same(f"{name}/case_table", own[name])
        same(f"{name}/per_attribute", metrics.per_attribute_modality(t, i))
        assert document(name)["run"] == name and document(name)["image"]
    all_cases = own["b-run"].unionByName(own["a-run"]).unionByName(own["c-run"])
    same("case_table", all_cases)
    whole = document(".")
    assert whole["runs"] == ["b-run", "a-run", "c-run"] and [s["run"] for s in whole["summaries"]] == whole["runs"]
    assert whole["summaries"][1] == document("a-run")
    key = lambda r: json.dumps(r, sort_keys=True)
    totals = [json.loads(r.value) for r in metrics.case_totals(all_cases).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect()]
    assert sorted(whole["case_conclusion"], key=key) == sorted(totals, key=key)
    with pytest.raises(ValueError, match="no runs"):
        writers.write_runs(str(tmp_path / "none"), {})


def test_images_from_png(spark, tmp_path):
    write_png(tmp_path / "red.png", scene((255, 0, 0), [(10, 10)]))
    write_png(tmp_path / "blue.png", scene((0, 0, 255), [(80, 80)]))
    write_png(tmp_path / "two.png", scene((0, 255, 0), [(5, 5), (80, 80)]))
    write_png(tmp_path / "none.png", scene((128, 128, 128)))
    df = readers.read_images(spark, str(tmp_path))
    assert {(r.width, r.height) for r in df.select("width", "height").collect()} == {(128, 128)}

    def broken(rgb):
        raise RuntimeError("no")

    found = images.run_detectors(df, {**images.DETECTORS, "shape": broken})
    assert not {"data", "height"} & set(found.columns)
    rows = {r.file_name: (r.grading_detected_color, r.grading_detected_position, r.grading_error_shape) for r in found.collect()}
    assert rows["red.png"] == ("red", "top left", "no")
    assert rows["blue.png"] == ("blue", "bottom right", "no")
    assert rows["two.png"][:2] == ("green", None) and rows["none.png"][:2] == (None, None)
    assert readers.read_images(spark, str(tmp_path), decode=False).count() == 4
    (tmp_path / "torn.png").write_bytes(b"no image")
    assert [(r.file_name, r.width) for r in readers.read_images(spark, str(tmp_path)).filter("error is not null").collect()] == [("torn.png", None)]


def test_malformed_input_is_an_error(spark, tmp_path):
    def file(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    bad = file("bad.jsonl", '{"a": 1}\n{"a": \n')
    broken = {
        "jsonl": lambda: readers.read_jsonl(spark, bad, "a int"),
        "array": lambda: readers.read_json_arrays(spark, file("arr.json", '[{"a": 1}, {"a"'), "a int"),
        "keyed": lambda: readers.read_keyed_documents(spark, file("doc.json", '{"f": {"k": {"a": 1}'), "f", "a int"),
        "csv": lambda: readers.read_yearly_csv(spark, file("yob1999.txt", "Ann,F,7\nBob,M,many\n"), "name string, gender string, count long"),
        "source": lambda: readers.read_with_source(spark, bad, "a int", "none"),
        "runs": lambda: readers.read_runs(spark, file("m_e_1.jsonl", '{"a": 1}\n{'), "a int")[0],
    }
    for name, read in broken.items():
        with pytest.raises(Exception, match="(?i)malformed|no records"):
            read().collect()
            raise AssertionError(name)
    assert readers.read_jsonl(spark, file("fine.jsonl", '{"a": 1}\n\n{"a": 2}\n'), "a int").count() == 2
    with pytest.raises(Exception, match="one row"):
        writers.write_summary(spark.range(5), str(tmp_path / "summary"))


def test_hsv_and_components():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 0], [0, 255, 255], [255, 0, 255], [10, 10, 10]]], np.uint8)
    assert images.hsv(rgb)[0, :, 0].tolist() == [0, 60, 120, 30, 90, 150, 0]
    rng = np.random.default_rng(0)
    mask = rng.random((40, 40)) < 0.4
    labels, seen = images.components(mask), -np.ones((40, 40), int)
    for start in zip(*np.nonzero(mask)):  # flood fill as the brute-force answer
        if seen[start] >= 0:
            continue
        stack, name = [start], start[0] * 40 + start[1]
        seen[start] = name
        while stack:
            y, x = stack.pop()
            for v in range(max(0, y - 1), min(40, y + 2)):
                for u in range(max(0, x - 1), min(40, x + 2)):
                    if mask[v, u] and seen[v, u] < 0:
                        seen[v, u] = name
                        stack.append((v, u))
    assert np.array_equal(labels, seen)


def test_position_edge_cases():
    for (x, y), name in (((10, 10), "top left"), ((78, 10), "top right"), ((10, 78), "bottom left"), ((78, 78), "bottom right"), ((44, 44), None)):
        assert images.detect_position(scene(square=[(x, y)])) == name
    assert images.detect_color(scene((60, 60, 58))) is None


def test_streams(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    schema = "sample_id string, options array<string>, inference_completion string"

    def arrive(name, rows):
        (inbox / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        results.grade_stream(spark, str(inbox), out, schema, grading.grade_letter_strict, state).awaitTermination()

    arrive("1.json", [{"sample_id": "a", "options": ["x", "y"], "inference_completion": " b "}])
    run()
    arrive("2.json", [{"sample_id": "b", "options": ["x", "y"], "inference_completion": "Z"}])
    run()  # continues: the first file is not graded twice
    rows = spark.read.schema("sample_id string, grading_answer_key string, grading_format_error string").json(out).collect()
    assert {(r.sample_id, r.grading_answer_key, r.grading_format_error) for r in rows} == {("a", "B", None), ("b", None, "Invalid option: Z")}


def test_streams_keep_malformed_lines_apart(spark, tmp_path):
    """No malformed line is graded; a batch that fails half-way and runs again neither loses nor doubles."""
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "1.json").write_text('{"sample_id": "a", "n": 1}\n{"sample_id": "b"\n\n{"sample_id": "c", "n": "many"}\n')
    schema, fail = "sample_id string, n int", [True]

    def grader(df):
        return df.withColumn("grade", F.lit("ok"))

    def failing(df):
        if fail:
            fail.clear()
            grader(df).write.mode("overwrite").json(f"{out}/batch=0")  # written, then lost before the batch is done
            raise RuntimeError("lost")
        return grader(df)

    with pytest.raises(Exception, match="lost"):
        results.grade_stream(spark, str(inbox), out, schema, failing, state).awaitTermination()
    for _ in range(2):
        results.grade_stream(spark, str(inbox), out, schema, failing, state).awaitTermination()
        assert [(r.sample_id, r.n, r.grade) for r in results.graded(spark, out, schema + ", grade string").collect()] == [("a", 1, "ok")]
        bad = results.graded(spark, out + "-rejected", "file string, text string").collect()
        assert sorted(r.text for r in bad) == ['{"sample_id": "b"', '{"sample_id": "c", "n": "many"}'] and all(r.file.endswith("1.json") for r in bad)
    (inbox / "2.json").write_text('{"sample_id": "d", "n": 4}\n')
    results.grade_stream(spark, str(inbox), out, schema, grader, state).awaitTermination()
    assert sorted(r.sample_id for r in results.graded(spark, out, schema).collect()) == ["a", "d"]


def test_upsert_and_compact(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "target")
    inbox.mkdir()
    for name, rows in (("1", [("a", 1, "fail"), ("b", 2, "ok")]), ("2", [("a", 3, "ok"), ("a", 4, "better")])):
        (inbox / f"{name}.json").write_text("".join(json.dumps({"id": i, "n": n, "v": v}) + "\n" for i, n, v in rows))
        stream = spark.readStream.schema("id string, n int, v string").json(str(inbox))
        results.upsert_stream(stream, target, "id", ["n"], str(tmp_path / "state")).awaitTermination()
    expected = {("a", 4, "better"), ("b", 2, "ok")}
    assert {tuple(r) for r in results.latest(spark, target, "id", ["n"]).select("id", "n", "v").collect()} == expected
    results.compact(spark, target, str(tmp_path / "folded"), "id", ["n"])
    assert {tuple(r) for r in results.latest(spark, str(tmp_path / "folded"), "id", ["n"]).select("id", "n", "v").collect()} == expected


def test_upsert_keeps_one_row_per_key(spark, tmp_path):
    """A batch that dies before its commit runs again; a late retry replaces a failure; nothing is shuffled or merged on reading."""
    inbox, target, state = tmp_path / "in", str(tmp_path / "target"), str(tmp_path / "state")
    inbox.mkdir()

    def arrive(name, rows):
        (inbox / f"{name}.json").write_text("".join(json.dumps({"id": i, "n": n, "v": v}) + "\n" for i, n, v in rows))

    def run():
        stream = spark.readStream.schema("id string, n int, v string").json(str(inbox))
        results.upsert_stream(stream, target, "id", ["n"], state, buckets=4).awaitTermination()

    def held():
        df = results.latest(spark, target, "id", ["n"])
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        return sorted(tuple(r) for r in df.select("id", "n", "v").collect())

    with pytest.raises(ValueError, match="no batch"):
        results.latest(spark, target, "id", ["n"])
    arrive("1", [(f"k{i}", i, "fail" if i % 5 == 0 else "ok") for i in range(30)] + [("k1", 40, "again")])
    run()
    first = held()
    assert len(first) == 30 and ("k1", 40, "again") in first and ("k5", 5, "fail") in first
    commit, done = results._commit, []

    def lost(*args):
        raise RuntimeError("lost before the commit")

    arrive("2", [("k5", 1, "retried"), ("new", 1, "ok")])
    results._commit = lost
    try:
        with pytest.raises(Exception, match="lost before the commit"):
            run()
    finally:
        results._commit = commit
    assert held() == first  # written, but not committed
    for _ in range(2):
        run()
        done.append(held())
    assert done[0] == done[1] == sorted([r for r in first if r[0] != "k5"] + [("k5", 1, "retried"), ("new", 1, "ok")])
    results.compact(spark, target, str(tmp_path / "folded"), "id", ["n"], buckets=4)
    assert sorted(tuple(r) for r in results.latest(spark, str(tmp_path / "folded"), "id", ["n"]).select("id", "n", "v").collect()) == done[0]


def test_metric_csv(spark, tmp_path):
    writers.write_metric_csv(spark.createDataFrame([("m", 0.5)], "model string, accuracy double"), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_text() == "model,accuracy\nm,0.5\n"


def test_split_table_prunes(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    writers.write_split_table(df, str(tmp_path / "t"))
    picked = readers.read_split_table(spark, str(tmp_path / "t"), ["test"])
    assert picked.count() == 3 and "PartitionFilters: [isnotnull(split" in picked._jdf.queryExecution().simpleString()
    with pytest.raises(Exception):
        writers.write_split_table(df, str(tmp_path / "t"))

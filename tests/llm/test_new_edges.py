"""Nulls, empty and long texts, repeats, ties, empty tables and clashing names for scores, whitening and runs."""

import math
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_edges import LONG, ROWS

from evalloom.llm import periodic_runs, pitman_yor, pu_quality, whitening

INF, NAN = math.inf, math.nan


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(ROWS)


# ------------------------------------------------------------ runs
def test_runs_against_every_period():
    rnd = random.Random(3)
    for _ in range(1500):
        n, k = rnd.randint(0, 70), rnd.choice([1, 2, 3, 8])
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 2)):
            a, p = rnd.randint(0, n), rnd.randint(1, 6)
            w = [w[a + (i - a) % p] if a <= i < n and a + p <= n else x for i, x in enumerate(w)]
        assert periodic_runs.runs_of(w) == plain.runs(w)


def test_long_runs_in_linear_time():
    words = [k % 997 for k in range(30_000)]
    assert periodic_runs.runs_of(words) == [(0, 30_000, 997)]
    assert periodic_runs.runs_of([7] * 50_000) == [(0, 50_000, 1)]


def test_find_runs(spark, docs, docs_of):
    again = [(100 + k, t) for k, t in enumerate(["a " * 5, "a " * 6, "\ta\n" * 9 + "b", "x y x y x y x y", "x y x y x y x", "a a a a a a b b b b b b", "é à " * 20 + "fin", LONG + " lo " * 3 + "go " * 9])]
    for table, rows in ((docs, ROWS), (docs_of(again), again), (docs_of(ROWS, 1), ROWS)):
        found = periodic_runs.find_runs(table).collect()
        want = []
        for i, t in rows:
            w = plain.SPACED.findall(t or "")
            runs = plain.runs(w) if len(w) < 3000 or len(set(w)) < 5 else None
            want.append((i, len(w), runs, w))
        assert len(found) == len(rows)
        for r in found:
            fits = [x for x in want if x[0] == r.doc_id and x[1] == r.n_words]
            assert fits
            for _, _, runs, w in fits[:1]:
                if runs is not None:
                    assert [(x.start, x.length, x.period) for x in r.runs] == runs
                    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
                    assert r.collapsed in {" ".join(x for k, x in enumerate(f[3]) if k not in gone) for f in fits}
    tailed = {r.doc_id: r for r in periodic_runs.find_runs(docs_of(again), tail=F.col("doc_id")).collect()}
    assert len(tailed) == len(again)  # 100 has a tail of its own
    assert periodic_runs.find_runs(docs.where("false")).count() == 0
    assert periodic_runs.find_runs(docs.withColumnRenamed("doc_id", "runs"), "runs").columns[0] == "runs"


# ------------------------------------------------------------ whitening
@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_components_of_small_matrices(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    for values in (np.ones(n), np.arange(n, 0, -1.0), np.r_[np.full(n - n // 2, 4.0), np.zeros(n // 2)], 10.0 ** -np.arange(n), np.r_[1.0, np.full(n - 1, 1 - 1e-12)][:n]):
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        found, vectors = whitening.leading_components(matrix, 16)
        assert np.abs(found - np.sort(np.linalg.eigvalsh(matrix))[::-1][:16]).max() < 1e-13
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, component string, x int").repartition(3)


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    sound = [(k, [float(np.float32(c)) for c in rng.standard_normal(5)], 1, "a", 2) for k in range(40)]
    more = [(50, None, 1, "a", 2), (51, [1.0, None, 0.0, 0.0, 0.0], 1, "a", 2), (52, [1.0, NAN, 0.0, 0.0, 0.0], 1, "a", 2), (53, [1.0, INF, 0.0, 0.0, 0.0], 1, "a", 2), (None, sound[3][1], 1, "a", 2), (7, sound[7][1], 1, "a", 2), (60, sound[7][1], 1, "a", 2)]
    out = whitening.whiten(vectors_of(spark, sound + more)).collect()
    assert len(out) == 5 * 43 and {r.n for r in out} == {40} and {r.vec_id for r in out} == {*range(40), None, 60}
    plainly = {(r.vec_id, r.component): r for r in whitening.whiten(vectors_of(spark, sound)).collect()}
    for r in out:
        if r.vec_id is not None and r.vec_id < 40:
            assert abs(abs(r.whitened) - abs(plainly[r.vec_id, r.component].whitened)) < 1e-9 and r.deviation == plainly[r.vec_id, r.component].deviation
    assert max(r.identity_error for r in out) < 1e-9 and math.isclose(sum({r.component: r.explained for r in out}.values()), 1, rel_tol=1e-12)


def test_whitening_without_directions(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None, 1, "a", 2)])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [], 1, "a", 2)])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(k, [0.5, 0.25], 1, "a", 2) for k in range(4)])).count() == 0
    line = whitening.whiten(vectors_of(spark, [(k, [float(k), float(2 * k), 1.0], 1, "a", 2) for k in range(4)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 4
    with pytest.raises(ValueError, match="1 to 2"):
        whitening.whiten(vectors_of(spark, [(1, [1.0], 1, "a", 2), (2, [1.0, 2.0], 1, "a", 2)]))
    with pytest.raises(OverflowError):
        whitening.whiten(vectors_of(spark, [(1, [1.0], 1, "a", 2), (2, [3e16], 1, "a", 2)]))
    with pytest.raises(Exception, match="OVERFLOW"):
        whitening.whiten(vectors_of(spark, [(1, [1.0], 1, "a", 2), (2, [3e38], 1, "a", 2)]))


# ------------------------------------------------------------ quality scores
def test_features_of_each_text_alone():
    texts = [t for _, t in ROWS] + ["A | b | c\nA | b | c\n\n x", "STOP!! NOW!!", "# $ %"]
    together = pu_quality.features(pa.array(texts, pa.string()))
    assert together.shape[1] == pu_quality.N_FEATURES and np.isfinite(together).all()
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(pu_quality.features(pa.array([t], pa.string()))[0], row, atol=1e-6)
    assert not pu_quality.features(pa.array([None, ""], pa.string()))[:, :17].any()


def test_class_prior():
    rng = np.random.default_rng(2)
    for share in (0.1, 0.5, 0.9):
        good, mixed = rng.normal(0.7, 0.1, 4000), np.r_[rng.normal(0.7, 0.1, int(8000 * share)), rng.normal(0.3, 0.1, int(8000 * (1 - share)))]
        counts = [np.histogram(v, 2048, (0, 1))[0] for v in (good, mixed)]
        assert abs(pu_quality.class_prior(*counts) - share) < 0.06
    assert pu_quality.class_prior(np.zeros(4), np.ones(4)) == 0.5


def test_scores(spark, docs):
    schema = "doc_id long, quality int, learn string, score int"
    labels = spark.createDataFrame([(5, 1, "x", 1), (7, 1, "x", 1), (8, 1, "x", 1), (9, None, "x", 1), (11, 0, "x", 1), (12, 1, "x", 1), (12, 0, "x", 1), (None, 1, "x", 1), (999, 1, "x", 1)], schema)
    learn = F.when(F.col("doc_id") == 8, F.lit(None)).otherwise(F.col("doc_id") != 7)
    for table in (docs, docs.repartition(1)):
        out = pu_quality.score_quality(table, labels, learn).collect()
        assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    for none in (labels.where("false"), labels.where("quality = 0")):
        assert {r.prior for r in pu_quality.score_quality(docs, none, learn).collect()} == {0.5}
    assert pu_quality.score_quality(docs.where("false"), labels, learn).count() == 0


def test_scores_do_not_know_held_out_labels(spark, docs):
    held = F.col("doc_id") % 2 == 1
    one = spark.createDataFrame([(k, 1) for k in (2, 4, 6, 8, 10)], "doc_id long, quality int")
    two = one.union(spark.createDataFrame([(k, k % 4 // 2) for k in (1, 3, 5, 7, 9, 11)], "doc_id long, quality int"))
    found = [sorted((r.doc_id or -1, round(r.score, 9)) for r in pu_quality.score_quality(docs, labels, ~held).collect()) for labels in (one, two)]
    assert found[0] == found[1]


# ------------------------------------------------------------ scores of the language model
def test_scores_do_not_depend_on_partitions(spark):
    table, held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), F.col("doc_id") % 7 == 0
    found = [{r.doc_id: r.score for r in pitman_yor.score_texts(d, held).collect()} for d in (table.repartition(2), table.repartition(7, "doc_id"))]
    assert found[0] == found[1] and len(found[0]) == 200


def test_words_are_predicted_from_the_word_before(spark):
    """All words are as frequent and end alike; only the word before tells them apart."""
    rows = [(i, "oneth twoth" if i % 2 else "sixth tenth") for i in range(200)] + [(200, "oneth twoth"), (201, "oneth tenth"), (202, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pitman_yor.score_texts(table, F.col("doc_id") >= 200).collect()}
    assert got[200].base_score == got[201].base_score and got[200].score > got[201].score + 0.5
    assert got[202].n_tokens == 1 and all(got[i].score == got[200].score for i in range(1, 200, 2))


def test_probabilities_after_a_word_sum_to_one():
    import numpy as np

    n, tables = np.array([7, 2, 1, 0, 0]), np.array([2.5, 1.25, 1, 0, 0])
    prior = np.log10([0.1, 0.2, 0.3, 0.15, 0.25])
    for size, every in ((10.0, 4.75), (0.0, 0.0)):
        some = n * (size > 0)
        scores = pitman_yor.pair_scores(some, tables * (size > 0), np.full(5, size), np.full(5, every), prior, 0.6, 3.0)
        assert np.isclose((10.0**scores).sum(), 1)


def test_a_large_letter_model_is_asked_in_lists_not_in_rows_of_letters(spark, monkeypatch):
    """What words ask of the letter model passes shuffles as a few packed lists, however many letters they have."""
    import random

    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abcdeéñ") for _ in range(draw.randint(1, 14))) for _ in range(3000)})
    vocabulary = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)], "word string, tables long").repartition(3)
    model, shared = pitman_yor.letter_model(vocabulary, None, 1)
    sent = {r.word: r.spelling for r in pitman_yor.with_spelling(vocabulary, model, shared).collect()}
    monkeypatch.setattr(pitman_yor, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(pitman_yor, "GROUP_WORDS", 400, raising=False)
    asked = pitman_yor.with_spelling(vocabulary, model, shared)
    found = {r.word: r.spelling for r in asked.collect()}
    rows = sum(_shuffled_rows(asked._jdf.queryExecution().executedPlan()))
    groups = -(-len(words) // 400)
    assert 0 < rows <= 4 * len(words) + 2 * groups * pitman_yor.PARTS + model.count()  # words are dealt twice here, and twice to be spelt
    assert found == sent and len(sent) == len(words)


def _shuffled_rows(plan):
    """Rows written by each exchange of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled_rows(plan.plan())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in _shuffled_rows(children.apply(i))]


def test_packed_numbers_and_words_come_back():
    import numpy as np
    import pyarrow as pa

    for x in ([], [0, 0, 0], [255], [256, 1], [1 << 40, 3], [-1, 5, 0]):
        assert pitman_yor.unpacked(pitman_yor.packed(np.array(x, np.int64))).tolist() == x
    floats = np.array([0.0, -1.5, np.inf])
    assert pitman_yor.unpacked(pitman_yor.packed(floats), float).tolist() == floats.tolist()
    for words in ([], ["a"], ["né", "ñandú", "\r"]):
        letters, offsets = pitman_yor.flat(pa.array(words, pa.string()))
        assert pitman_yor._unpacked_words(pitman_yor._packed_words(letters, np.diff(offsets))).to_pylist() == words
    runs = np.array([1, 4, 9, 1, 2, 9, 0], np.uint64)
    for got, want in zip(pitman_yor._distinct(runs), np.unique(runs, return_inverse=True), strict=True):
        assert got.tolist() == want.tolist()
    assert pitman_yor._order(np.array([70000, 3, 3, 0])).tolist() == [3, 1, 2, 0]


def test_the_result_is_small_and_all_that_is_left(spark, monkeypatch):
    """No message between chunks and cells outlives the scoring: what stays on disk has one short row for each text."""
    import os

    table, made = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    monkeypatch.setattr(pitman_yor, "written", lambda df, f=pitman_yor.written, **options: made.append(f(df, **options)) or made[-1])
    out = pitman_yor.score_texts(table, F.col("doc_id") % 7 == 0)
    left = {x.removeprefix("file:") for df in made for x in df.inputFiles() if os.path.exists(x.removeprefix("file:"))}
    assert left == {x.removeprefix("file:") for x in out.inputFiles()}
    assert sum(map(os.path.getsize, left)) < 200 * 100 + 40_000 and out.count() == 200

def test_steps_leave_no_spent_shuffles_or_tables(spark, monkeypatch):
    """Shuffle files go with the step that made them, and what is left at the end is what the result is read from."""
    import glob
    import os

    table, kept = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    monkeypatch.setattr(pitman_yor, "written", lambda df, f=pitman_yor.written, **options: kept.append(f(df, **options)) or kept[-1])
    before = spark.conf.get(pitman_yor.CLEAN_UP, None)
    out = pitman_yor.score_texts(table, F.col("doc_id") % 7 == 0)
    assert spark.conf.get(pitman_yor.CLEAN_UP, None) == before
    size = lambda df: sum(os.path.getsize(x) for path in {os.path.dirname(x.removeprefix("file:")) for x in df.inputFiles()} for x in glob.glob(f"{path}/*.parquet"))
    tables = sum(map(size, kept))
    assert 0 < size(out) and tables - size(out) < 0.25 * size(out)
    assert out.count() == 200


def test_pairs_meet_in_cells():
    """Words of buckets of any size, none too: a pair stands in one cell, and words come back from their buckets."""
    for sizes in ([5, 0, 3, 9, 0, 0, 2, 8, 1, 1, 4, 7], [0] * 11 + [3], [2]):
        numbering = pitman_yor.Numbering(sizes)
        words = np.arange(sum(sizes))
        bucket = numbering.bucket(words)
        assert (np.bincount(bucket, minlength=len(sizes)) == sizes).all()
        cell = numbering.cell(*(x.ravel() for x in np.meshgrid(bucket, bucket)))
        assert cell.min() >= 0 and cell.max() < numbering.rows * numbering.columns <= len(sizes)
        rows = numbering.dealt(pitman_yor.FIRSTS, pitman_yor.ALL, 1, words).to_pylist()
        assert [numbering.start[r["bucket"]] + at for r in rows for at in np.cumsum(pitman_yor.unpacked(r["a"]))] == words.tolist()
    with pytest.raises(OverflowError):
        pitman_yor.Numbering([1 << 31, 1 << 31])


def test_strength_of_restaurants():
    import numpy as np

    size, tables = np.array([1, 2, 9, 300]), np.array([1, 2, 4, 80])
    for strength in (0.3, 5.0, 400.0):
        want = [sum(1 / (strength + 0.6 * i) for i in range(1, t)) - sum(1 / (strength + i) for i in range(1, c)) for c, t in zip(size, tables, strict=True)]
        assert np.allclose(pitman_yor.strength_slope(size, tables, 0.6, strength), want)


def test_keyed_binomial_draws():
    import numpy as np

    keys = np.arange(20_000, dtype=np.uint64)
    for n, p in ((70, 0.01), (5000, 0.3), (64, 0.97), (100, 0.0), (10**6, 1e-4)):
        got = pitman_yor.Keyed(keys, 3).binomial(np.arange(len(keys)), 64, np.full(len(keys), n), np.full(len(keys), p))
        assert got.min() >= 0 and got.max() <= n and abs(got.mean() - n * p) <= 5 * (n * p * (1 - p) / len(keys)) ** 0.5
        assert abs(got.var() - n * p * (1 - p)) <= 0.06 * n * p * (1 - p)


# ------------------------------------------------------------ the pipeline
def test_stages_on_edge_rows_and_on_nothing(spark, docs):
    """Every stage keeps its columns, whatever stands in the rows; nothing comes of nothing."""
    import corpus_pipeline

    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = table.columns
            table = stage(spark, table, "/root/testdata/sf0.001")
            assert table.columns == columns, name
        kept = {(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()}
        packed = corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").collect()
        assert {r.doc_id for r in packed} == {i for i, _ in kept}
        if kept:
            good = [(i, t) for i, t in ROWS if plain.quality(t)["kept"]]
            first = {i for i, (_, c) in plain.near([(i, t) for i, t in good if i is not None], 5).items() if i == c}
            assert {i for i, _ in kept} == first | {None} and first == {7}  # a null id is no one's copy

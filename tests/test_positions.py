"""Seeded choices and positions do not depend on partitions, and counts are exact."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import seeded
from evalloom.operators import choices, positions, prompts, shards, stratify

PARTITIONS = (1, 4, 17)


def same(spark, fn):
    results = [sorted(map(tuple, fn(spark.range(200).withColumn("g", F.col("id") % 7).repartition(n)).collect())) for n in PARTITIONS]
    assert results[0] == results[1] == results[2]
    return results[0]


def test_index_by_key_is_dense_and_invariant(spark):
    rows = same(spark, lambda df: positions.index_by_key(df, 3, "id"))
    assert sorted(r[-1] for r in rows) == list(range(200))


def test_index_within_groups(spark):
    rows = same(spark, lambda df: positions.index_by_key(df, 3, "id", within="g", digits=2).select("g", "id", "pos"))
    for g in range(7):
        own = sorted(p for k, _, p in rows if k == g)
        assert own == list(range(len(own)))


def test_global_index(spark):
    rows = same(spark, lambda df: positions.global_index(df, [F.col("g").desc(), "id"]).select("g", "id", "pos"))
    expected = sorted(((i % 7, i) for i in range(200)), key=lambda t: (-t[0], t[1]))
    assert [(g, i) for g, i, _ in sorted(rows, key=lambda r: r[2])] == expected


def test_global_index_of_nothing(spark):
    assert positions.global_index(spark.range(0), ["id"]).collect() == []


def test_samples(spark):
    assert len(same(spark, lambda df: positions.sample_exact(df, 25, 1, "id"))) == 25
    two = same(spark, lambda df: positions.sample_two_way(df, 20, 10, 1, "id").select("id", "part"))
    assert sum(p == "first" for _, p in two) == 20 and len({i for i, _ in two}) == 30
    with pytest.raises(ValueError):
        positions.sample_exact(spark.range(5), 6, 1, "id")


def test_sample_is_the_head_of_the_seeded_order(spark):
    import hashlib

    order = sorted(range(300), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())
    for n in (1, 50, 299, 300):
        assert {r.id for r in positions.sample_exact(spark.range(300), n, 9, "id").collect()} == set(order[:n])


def test_shuffles_and_coins(spark):
    df = spark.range(500)
    arr = F.array(*[F.lit(i) for i in range(5)])
    rows = df.select(seeded.shuffle_array(arr, 1, "id").alias("a")).collect()
    assert all(sorted(r.a) == [0, 1, 2, 3, 4] for r in rows) and len({tuple(r.a) for r in rows}) > 50
    share = df.filter(seeded.keyed_bernoulli(0.3, 5, "id")).count() / 500
    assert 0.2 < share < 0.4
    assert df.select(seeded.pick_one(F.array().cast("array<int>"), 1, "id").alias("x")).filter("x is not null").count() == 0


def test_stratified_split_has_no_aliasing(spark):
    """Label sizes that divide 1 / fraction would starve a plain every-k-th pick."""
    dims = {"a": list(range(6)), "b": list(range(4)), "c": list(range(7)), "d": list(range(5))}
    grid = prompts.grid_of_values(spark, dims).withColumn("id", F.concat_ws("-", *dims))
    out = positions.stratified_split(grid, list(dims), 0.2, 7, "id").cache()
    assert abs(out.filter("split = 'test'").count() / 840 - 0.2) < 0.01
    for label, values in dims.items():
        shares = {r[0]: r[1] for r in out.groupBy(label).agg(F.avg((F.col("split") == "test").cast("int"))).collect()}
        assert all(abs(shares[v] - 0.2) < 0.03 for v in values), (label, shares)


def test_fraction_split_rounds_half_even(spark):
    counts = {r.split: r["count"] for r in positions.fraction_split(spark.range(840), 0.2, 1, "id").groupBy("split").count().collect()}
    assert counts == {"train": 672, "test": 168}


def test_distractors_cover_hot_values(spark):
    """One value holds most rows; every row still gets distinct partners of another value."""
    df = spark.range(300).withColumn("v", F.when(F.col("id") < 250, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 5)))
    rows = choices.sample_distractors(df, "v", 5, 1, "id", ["id", "v"]).collect()
    value = {r.id: r.v for r in df.collect()}
    assert len(rows) == 300
    for r in rows:
        picked = [d["id"] for d in r.distractors]
        assert len(set(picked)) == 5 and all(value[p] != value[r.id] for p in picked)
    used = {d["id"] for r in rows if value[r.id] == "hot" for d in r.distractors}
    assert used == set(range(250, 300))  # every candidate is reachable


def test_distractors_need_candidates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, v string")
    with pytest.raises(Exception, match="fewer candidates"):
        choices.sample_distractors(df, "v", 2, 1, "id", ["id"]).collect()
    twice = spark.createDataFrame([(k % 5, k % 3) for k in range(30)], "id int, v int")
    with pytest.raises(Exception, match="not the key of one row"):
        choices.sample_distractors(twice, "v", 2, 1, "id", ["id"]).collect()


def test_round_robin_sizes_differ_by_at_most_one(spark):
    sizes = [r["count"] for r in shards.round_robin_shard(spark.range(103), 8, ["id"]).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1


def test_interleave_matches_the_sequential_definition(spark):
    """Batches against a plain walk over the same reshuffled passes, for two workers."""
    sources = [[f"a{i}" for i in range(5)], [f"b{i}" for i in range(3)]]
    frames = [spark.createDataFrame([(x,) for x in s], "id string") for s in sources]

    def order(i, p):
        numbered = sorted(sources[i], key=lambda x: hashlib.md5(f"7-{i}|{x}".encode()).hexdigest())
        return [numbered[plain_permuted(k, len(numbered), f"7-{i}", p)] for k in range(len(numbered))]

    for rank in (0, 1):
        streams = [[x for p in range(40) for x in order(i, p)][rank::2] for i in range(2)]
        taken, expected = [0, 0], []
        schedule = [0, 0, 1] * 10
        for source in schedule[:8]:
            expected.append((source, streams[source][taken[source] : taken[source] + 4]))
            taken[source] += 4
        got = shards.interleave_batches(frames, [2, 1], 4, 8, 7, "id", rank=rank, world=2).collect()
        for b, (source, rows) in enumerate(expected):
            mine = sorted((r for r in got if r.batch == b), key=lambda r: r.slot)
            assert [r.id for r in mine] == rows and {r.source for r in mine} == {source}


# ------------------------------------------------------------ seeded permutations
def plain_permuted(place, n, seed, tweak=0):
    p, a = 2147483647, int(math.sqrt(n)) + 1
    b, t = -(-n // a), (tweak % p * 1103515245 + 12345) % p
    keys = [int(hashlib.md5(f"{seed}|{r}".encode()).hexdigest()[:7], 16) * 2 + r % 2 for r in range(6)]
    while True:
        for k in keys:
            x, y = place % a, place // a
            h = ((y if k % 2 == 0 else x) + k + t) % p
            m = (h * h + 48271 * h) % p
            place = (x + m) % a + a * y if k % 2 == 0 else x + a * ((y + m) % b)
        if place < n:
            return place


def test_permutations(spark):
    for n in (1, 2, 3, 5, 8, 99, 400, 1001):
        for tweak in (0, 7):
            got = [r[0] for r in spark.range(n).coalesce(1).select(seeded.permuted("id", n, "s", tweak)).collect()]
            assert sorted(got) == list(range(n)) and got == [plain_permuted(i, n, "s", tweak) for i in range(n)]
    large = 3 * 10**15 + 1
    places = [0, 1, large // 2, large - 1]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in places], "p long").select(seeded.permuted("p", F.lit(large), 4, F.lit(12345678901))).collect()]
    assert sorted(got) == sorted(plain_permuted(p, large, 4, 12345678901) for p in places) and all(0 <= g < large for g in got)


def test_interleave_far_into_an_endless_mix(spark):
    """Ten thousand passes over seven rows: only the wanted elements are made, and each pass holds every row once."""
    rows = spark.createDataFrame([(f"r{i}", i * i) for i in range(7)], "id string, v int")
    out = shards.interleave_batches([rows], [1], 7, 10_000, 3, "id")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    passes = out.groupBy("pass").agg(F.countDistinct("id").alias("n"), F.count("*").alias("m"))
    assert passes.filter("n = 7 and m = 7").count() == 10_000
    assert out.groupBy("id").agg(F.countDistinct("v").alias("n")).filter("n <> 1").count() == 0
    orders = {tuple(r.o) for r in out.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("slot", "id"))).alias("o")).limit(200).collect()}
    assert len(orders) > 150
    with pytest.raises(Exception, match="source 0 is empty"):
        shards.interleave_batches([rows.filter("false")], [1], 7, 2, 3, "id").collect()


def test_interleave_keys_identify_rows(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, v int")
    with pytest.raises(Exception, match="not the key of one row"):
        shards.interleave_batches([twice], [1], 3, 2, 3, "id").collect()


# ------------------------------------------------------------ global positions
def test_global_index_without_a_checkpoint(spark):
    df = spark.range(50).withColumn("t", F.lit("x"))
    out = positions.global_index(df, ["id"])
    plan = out._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Scan parquet" not in plan and "RangePartitioning" not in plan.lower()


def test_global_index_with_hot_and_missing_values(spark):
    """One leading value holds most rows, some are NULL, some terms fall; the payload is joined back by key."""
    rnd = random.Random(1)
    data = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"v{rnd.randrange(9)}", None if i % 7 == 0 else rnd.random(), "p" * (i % 5)) for i in range(4000)]
    df = spark.createDataFrame(data, "id long, v string, x double, payload string")
    up = lambda value: (value is not None, value or 0)
    cases = {
        ("v", "x", "id"): sorted(data, key=lambda r: ((r[1] is not None, r[1] or ""), up(r[2]), r[0])),
        ("v", "x desc", "id desc"): sorted(data, key=lambda r: ((r[1] is not None, r[1] or ""), (r[2] is None, -(r[2] or 0)), -r[0])),
    }
    for order, expected in cases.items():
        terms = [F.col(c.split()[0]).desc() if " " in c else c for c in order]
        for key in (None, "id"):
            for n in (1, 7):
                got = positions.global_index(df.repartition(n), terms, key=key).orderBy("pos").collect()
                assert [r.pos for r in got] == list(range(4000)) and [tuple(r)[:4] for r in got] == expected
    terms = spark.range(60_000).select(F.struct(F.lit("hot").alias("_o0"), F.xxhash64("id").alias("_o1")).alias("_t"))
    split = terms.withColumn("_s", positions._splitters(terms, [False, False]))
    sizes = split.select(positions._range_of(F.col("_t"), F.col("_s"), [False, False]).alias("r")).groupBy("r").count()
    assert sizes.count() > 1000 and sizes.agg(F.max("count")).first()[0] < 200  # a value that all rows share is cut all the same


def test_global_index_keys_identify_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "id int, o string, payload string")
    with pytest.raises(Exception, match="not the key of one row"):
        positions.global_index(df, ["o"], key="id").collect()
    ties = spark.createDataFrame([(i, "same") for i in range(20)], "id int, o string")
    assert sorted(r.pos for r in positions.global_index(ties, ["o"], key="id").collect()) == list(range(20))
    with pytest.raises(ValueError, match="NULLs come first"):
        positions.global_index(df, [F.col("o").asc_nulls_last()])


# ------------------------------------------------------------ shares of pairs of labels
def pair_distances(rows, labels, share):
    out = []
    for i, a in enumerate(labels):
        for b in labels[i:]:
            groups = {}
            for r in rows:
                groups.setdefault((r[a], r[b]), []).append(r["split"] == "test")
            out += [abs(sum(g) - share * len(g)) for g in groups.values()]
    return max(out)


def test_split_keeps_pairs_of_labels(spark):
    """The grid of 840 combinations, a table with a hot combination and NULL labels: each label and pair within one row of its share."""
    dims = {"a": list(range(6)), "b": list(range(4)), "c": list(range(7)), "d": list(range(5))}
    grid = prompts.grid_of_values(spark, dims).withColumn("id", F.concat_ws("-", *dims))
    rnd = random.Random(2)
    data = [(i, None if i % 13 == 0 else "x" if i % 3 else rnd.choice("yzw"), rnd.choice("pq") if i % 2 else "p") for i in range(3001)]
    table = spark.createDataFrame(data, "id int, u string, v string")
    for df, labels, share in ((grid, list(dims), 0.2), (table, ["u", "v"], 0.25), (table, ["u"], 0.1)):
        got = [sorted((r.id, r.split) for r in stratify.stratified_split_pairs(df.repartition(n), labels, share, 7, "id").collect()) for n in (1, 5)]
        assert got[0] == got[1] and len(got[0]) == df.count()
        split = dict(got[0])
        rows = [{**r.asDict(), "split": split[r.id]} for r in df.collect()]
        assert abs(sum(s == "test" for s in split.values()) - share * len(rows)) <= 1
        assert pair_distances(rows, labels, share) <= 1 + 1e-9
    assert stratify.stratified_split_pairs(table.filter("false"), ["u"], 0.5, 1, "id").count() == 0
    assert {r.split for r in stratify.stratified_split_pairs(table, ["u"], 1, 1, "id").collect()} == {"test"}


def test_quotas_reach_one_row_after_descent_ends():
    """Counts of three labels for which single and paired changes of cells end 0.1 or 0.2 rows beyond one."""
    codes = np.array(list(itertools.product(range(3), range(5), range(7))))
    for seed in (36, 96, 138, 148):
        counts = np.random.default_rng(seed).integers(500, 9000, len(codes))
        quotas = stratify.rounded_quotas(codes, counts, 3, 10)
        assert (quotas >= 0).all() and (quotas <= counts).all()
        for chosen in ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2)):
            sums = {}
            for code, n, q in zip(codes, counts, quotas, strict=True):
                sums[tuple(code[list(chosen)])] = sums.get(tuple(code[list(chosen)]), 0) + 10 * q - 3 * n
            assert max(map(abs, sums.values())) <= 10


def test_compiled_permutation_is_the_permutation(spark):
    """The projections give the same places as the expression, with walks beyond the unrolled turns; a filter on them does not grow the plan."""
    for n in (2, 24, 720, math.factorial(20)):
        df = spark.range(3).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(min(n, 130) - 1))).alias("j"))
        both = seeded.with_permuted(df, "new", "j", n, 7, "t", turns=1).withColumn("old", seeded.permuted("j", n, 7, F.col("t")))
        assert both.filter("new is null or new <> old").count() == 0
    rows = spark.range(50).select("id", *[F.concat(F.lit(a), "id").alias(f"synthetic_{a}") for a in "abcd"], F.lit("i").alias("image"))
    made = prompts.permuted_prompts(rows, list("abcd"), 24, "words_only", False, 3, "id")
    assert made.distinct().count() == 1200 == made.count()
    assert "array_append(" not in made._jdf.queryExecution().executedPlan().toString()  # words are looked up, not arranged step by step

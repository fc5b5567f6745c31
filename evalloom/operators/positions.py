"""Dense positions and exact samples without a single-task sort of the data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.binding import bind
from evalloom.functions.seeded import seeded_key

GOLDEN = 0.6180339887498949
RANGES = 4096  # of a global order, at most
SAMPLE = 65_536  # rows that its splitters are taken from, at most


def _running_start(counts: DataFrame, by: str, within: str | None = None) -> DataFrame:
    """First position of each bucket. One row per bucket comes in, never the data itself."""
    w = [within] if within else []
    before = Window.partitionBy(*w).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*w, by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def index_by_key(
    df: DataFrame, seed: int | str, key: str | Sequence[str], name: str = "pos", digits: int = 4, within: str | None = None,
    below: int | None = None,
) -> DataFrame:
    """0-based position in seeded random order; ``key`` must identify a row.

    Rows are cut into 16^digits buckets by the leading digits of their hash.
    Hash buckets are even whatever the data look like, so one shuffle with a
    row number per bucket replaces a global sort. The bucket starts are at most
    16^digits rows (65,536 by default), a fixed bound for the broadcast. With
    ``within`` positions restart per group; the starts then grow with the
    groups, so they are joined on the key the rows are partitioned by anyway.
    ``below`` keeps the first positions only: buckets that start later are
    dropped before the shuffle, so little more than the wanted rows moves.
    """
    if not 1 <= digits <= 5:
        raise ValueError("digits must be between 1 and 5")
    keys = [key] if isinstance(key, str) else list(key)
    w = [within] if within else []
    keyed = df.withColumn("_okey", seeded_key(seed, *w, *keys)).withColumn("_bucket", F.substring("_okey", 1, digits))
    starts = _running_start(keyed.groupBy(*w, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "_bucket", within)
    if below is not None:
        starts = starts.filter(F.col("_start") < below)
    inside = F.row_number().over(Window.partitionBy(*w, "_bucket").orderBy("_okey", *keys))
    placed = (
        keyed.join(starts if within else F.broadcast(starts), [*w, "_bucket"])
        .withColumn(name, F.col("_start") + inside - 1)
        .drop("_bucket", "_okey", "_start")
    )
    return placed if below is None else placed.filter(F.col(name) < below)


def _term(c) -> tuple[Column, bool]:
    """(column, descending) of an order term; a descending one names its column."""
    if isinstance(c, str):
        return F.col(c), False
    m = re.fullmatch(r"Column<'(.+) (ASC NULLS FIRST|ASC NULLS LAST|DESC NULLS FIRST|DESC NULLS LAST)'>", str(c))
    if m and m[2] not in ("ASC NULLS FIRST", "DESC NULLS LAST"):
        raise ValueError(f"order term {m[1]}: NULLs come first in rising and last in falling order")
    return (F.col(m[1]), m[2].startswith("DESC")) if m else (c, False)


def _before(falling: Sequence[bool]):
    """Whether struct ``a`` of order values comes before ``b``: NULLs first in rising, last in falling order."""
    if not any(falling):
        return lambda a, b: a < b

    def before(a, b):
        out = F.lit(False)
        for k in reversed(range(len(falling))):
            x, y = (b, a) if falling[k] else (a, b)
            x, y = x[f"_o{k}"], y[f"_o{k}"]
            out = F.when(x.eqNullSafe(y), out).otherwise(F.coalesce(x < y, x.isNull()))
        return out

    return lambda a, b: bind(b, lambda y: F.when(y.isNotNull(), before(a, y)))


def _splitters(terms: DataFrame, falling: Sequence[bool]) -> Column:
    """At most RANGES - 1 rows that cut the order evenly, as a sorted array in a scalar subquery.

    The sample holds the row of least hash of each hash bucket: a bound on its size and the same rows each time they
    are drawn, whatever the partitions. The hash is over the order values, so equal rows count once.
    """
    hashed = terms.select("_t", F.xxhash64("_t").alias("_h"))
    least = hashed.groupBy(F.pmod("_h", F.lit(SAMPLE)).alias("_b")).agg(F.min("_h").alias("_h"))
    drawn = hashed.join(F.broadcast(least.select("_h")), "_h", "left_semi").dropDuplicates(["_h"])
    before = _before(falling)
    rows = F.collect_list("_t")
    ordered = F.array_sort(rows, lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)) if any(falling) else F.sort_array(rows)
    every = SAMPLE // RANGES
    return drawn.agg(F.filter(ordered, lambda _, i: F.pmod(i + 1, F.lit(every)) == 0).alias("_s")).scalar()


def _range_of(row: Column, splitters: Column, falling: Sequence[bool]) -> Column:
    """How many splitters don't come after the row: binary search. ``splitters`` is named once, so that the optimizer puts
    the subquery's value here instead of copying it into every row."""
    before = _before(falling)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(RANGES.bit_length()))])
    reached = lambda at, step: F.coalesce(~before(row, F.get(splitters, at + step - 1)), F.lit(False))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(reached(at, step), step).otherwise(0)), F.lit(0))


def joined_back(df: DataFrame, found: DataFrame, keys: Sequence[str], name: str, how: str = "inner") -> DataFrame:
    """``df`` with column ``name`` of ``found`` by key (NULL keys meet too); a key that repeats in ``found`` is an error."""
    ranks = found.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(name).alias("_at"), F.count(F.lit(1)).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    repeated = F.raise_error(F.concat(F.lit("not the key of one row: "), F.concat_ws("|", *keys)))
    joined = df.join(ranks, reduce(lambda a, b: a & b, same), how)
    return joined.select(*df.columns, F.when(F.col("_n") > 1, repeated).otherwise(F.col("_at")).alias(name))


def global_index(df: DataFrame, order: Sequence, name: str = "pos", key: str | Sequence[str] | None = None) -> DataFrame:
    """0-based position in any total order of columns.

    A sample sort with repeatable splitters: rows find their range by binary search among at most RANGES sampled
    rows, ranges are counted, and a row's position is its range's start plus its number inside the range. A splitter
    holds all order columns, so many equal leading values are cut too. Nothing is checkpointed or drawn twice with
    another result: a recomputed task finds the same ranges and the same positions.

    With ``key``, which must identify a row (a repeated key is an error), only order columns and key are ranked, and
    the other columns are joined back. Without it whole rows move, once. Rows that tie in all order columns share a
    range and get their numbers in any order.
    """
    terms = [_term(c) for c in order]
    falling = [down for _, down in terms]
    keys = [key] if isinstance(key, str) else list(key or [])
    tagged = df.withColumn("_t", F.struct(*[c.alias(f"_o{k}") for k, (c, _) in enumerate(terms)]))
    plain = {c for c in order if isinstance(c, str)}
    back = bool(keys) and not set(df.columns) <= {*keys, *plain}
    narrow = tagged.select(*keys, "_t") if back else tagged
    split = narrow.withColumn("_s", _splitters(tagged.select("_t"), falling))
    ranged = split.withColumn("_range", _range_of(F.col("_t"), F.col("_s"), falling)).drop("_s")
    starts = _running_start(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.col(f"_t._o{k}").desc() if down else F.col(f"_t._o{k}").asc() for k, down in enumerate(falling)]))
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside") - 1)
    if not back:
        return placed.select(*df.columns, name)
    return joined_back(df, placed, keys, name)


def _need(df: DataFrame, n: int) -> None:
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"asked for {n} rows, only {found} available")


def sample_exact(df: DataFrame, n: int, seed: int | str, key: str) -> DataFrame:
    """Exactly ``n`` rows without replacement; fewer available rows are an error.

    A sort with a limit would send ``n`` rows of every partition to one task;
    here the hash buckets that can hold the first ``n`` rows are known first.
    """
    _need(df, n)
    return index_by_key(df, seed, key, "_pos", below=n).drop("_pos")


def sample_two_way(
    df: DataFrame, n_first: int, n_second: int, seed: int | str, key: str, name: str = "part"
) -> DataFrame:
    """One draw of both sizes without replacement: ``first`` and ``second`` never overlap."""
    total = n_first + n_second
    _need(df, total)
    part = F.when(F.col("_pos") < n_first, "first").otherwise("second")
    return index_by_key(df, seed, key, "_pos", below=total).withColumn(name, part).drop("_pos")


def shuffle_rows(df: DataFrame, seed: int | str, key: str) -> DataFrame:
    """Seeded global order."""
    return df.orderBy(seeded_key(seed, key), key)


def fraction_split(df: DataFrame, fraction: float, seed: int | str, key: str, name: str = "split") -> DataFrame:
    """``test`` gets ``fraction`` of the rows; the cut is round-half-even on the row count."""
    cut = int(round(df.count() * (1.0 - fraction)))
    split = F.when(F.col("_pos") < cut, "train").otherwise("test")
    return index_by_key(df, seed, key, "_pos").withColumn(name, split).drop("_pos")


def stratified_split(
    df: DataFrame, labels: Sequence[str], fraction: float, seed: int | str, key: str, name: str = "split"
) -> DataFrame:
    """Keep every label's share near ``fraction``.

    Rows are placed in (labels, seeded key) order; position p is a test row when
    frac(p * golden ratio) < fraction. Multiples of an irrational step are
    evenly spread along every arithmetic progression, so no label that recurs
    with a fixed period can fall in or out of step with the picks.
    """
    pos = global_index(df.withColumn("_okey", seeded_key(seed, key)), [*labels, "_okey", key], "_pos")
    turn = F.col("_pos") * F.lit(GOLDEN)
    test = turn - F.floor(turn) < F.lit(float(fraction))
    return pos.withColumn(name, F.when(test, "test").otherwise("train")).drop("_okey", "_pos")

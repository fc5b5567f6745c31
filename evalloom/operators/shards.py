"""Dealing rows to workers, merging their results, resuming and retrying."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.context import one_row
from evalloom.functions.seeded import permuted, whole
from evalloom.operators.joins import remaining
from evalloom.operators.positions import global_index, index_by_key, joined_back


def round_robin_shard(df: DataFrame, n: int, order: Sequence, name: str = "shard", key: str | Sequence[str] | None = None) -> DataFrame:
    """Shard = position in the plan order modulo ``n``; with ``key`` only order and key are ranked (see ``global_index``)."""
    return global_index(df, order, "_pos", key).withColumn(name, F.pmod("_pos", F.lit(n)).cast("int")).drop("_pos")


def dedupe_last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row per key wins; ``first_seen`` is where the key first appeared.

    One aggregate with partial results on the map side; no window.
    """
    rank = F.struct(*order)
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), rank).alias("_r"), F.min(rank).alias("first_seen"))
    return best.select(key, "_r.*", "first_seen").select(*df.columns, "first_seen")


def merge_shards(df: DataFrame, key: str = "sample_id", order: Sequence[str] = ("shard", "file", "line")) -> DataFrame:
    """Results of all shards, once per sample, sorted by (split, dataset_index, sample_id)."""
    rows = dedupe_last(df, key, order).drop("first_seen", *order)
    return rows.orderBy(F.coalesce("split", F.lit("")), F.coalesce("dataset_index", F.lit(-1)), key)


def recover_and_split(
    plan: DataFrame, done: DataFrame, n: int, key: str, source: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recovered rows, remaining rows with their shard, one-row manifest).

    ``done`` may hold repeated and unknown ids: the first source wins and ids
    outside the plan are ignored.
    """
    extra = [c for c in done.columns if c != key]
    known = done.join(plan.select(key), key, "left_semi")
    first = known.groupBy(key).agg(F.min_by(F.struct(*extra), F.struct(*source)).alias("_d")).select(key, "_d.*")
    recovered = plan.join(first, key)
    rest = round_robin_shard(remaining(plan, first, key), n, order)
    return recovered, rest, split_manifest(plan, recovered, rest, n)


def split_manifest(plan: DataFrame, recovered: DataFrame, rest: DataFrame, n: int) -> DataFrame:
    n_rows = F.count(F.lit(1))
    counts = rest.groupBy().agg(
        n_rows.alias("remaining_rows"), F.array(*[F.count_if(F.col("shard") == i) for i in range(n)]).alias("residual_counts")
    )
    return counts.select(
        one_row(plan.groupBy().agg(n_rows.alias("n")))["n"].alias("total_rows"),
        one_row(recovered.groupBy().agg(n_rows.alias("n")))["n"].alias("recovered_rows"),
        "remaining_rows",
        F.lit(n).alias("num_residual_shards"),
        "residual_counts",
    )


def check_complete(plan: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Ids that are ``missing`` from the results or ``extra`` in them; empty when complete."""
    gone = plan.join(results.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = results.join(plan.select(key), key, "left_anti").select(key, F.lit("extra").alias("problem"))
    return gone.unionByName(extra)


def retry_failed(df: DataFrame, error: str = "grading_error", prefix: str = "grading_") -> tuple[DataFrame, DataFrame]:
    """(rows graded fine, rows to grade again without their old grading columns)."""
    old = [c for c in df.columns if c.startswith(prefix)]
    return df.filter(F.col(error).isNull()), df.filter(F.col(error).isNotNull()).drop(*old)


def interleave_batches(
    sources: Sequence[DataFrame], repeat: Sequence[int], batch: int, n_batches: int, seed: int, key: str,
    shuffle: bool = True, rank: int = 0, world: int = 1,
) -> DataFrame:
    """The first ``n_batches`` batches of an endless mix of sources.

    Every source is passed over again and again, reshuffled per pass; each cycle takes ``repeat[i]`` batches of source i.
    Element e of a source's stream is in pass e div N, at place e mod N, and a worker of rank r sees elements r,
    r + world, ... So only the elements that these batches hold are ever made, however many passes they lie apart: the
    row of a place is computed by a seeded permutation of the pass. Keys are numbered, elements find theirs, and
    the other columns are fetched by the key, which must identify a row.
    """
    cycle = sum(repeat)
    frames, offset = [], 0
    for i, (df, times) in enumerate(zip(sources, repeat, strict=True)):
        full, part = divmod(n_batches, cycle)
        wanted = (full * times + max(0, min(times, part - offset))) * batch
        if wanted:
            size = df.groupBy().agg(F.count(F.lit(1)).alias("_n")).scalar()
            empty = F.raise_error(F.lit(f"source {i} is empty")).cast("long")
            drawn = df.sparkSession.range(wanted).select(F.col("id").alias("_d"), F.when(size > 0, size).otherwise(empty).alias("_n"))
            element = F.lit(rank) + F.col("_d") * world
            drawn = drawn.withColumns({"pass": whole(element, F.col("_n")), "_place": F.pmod(element, F.col("_n"))})
            row = permuted("_place", F.col("_n"), f"{seed}-{i}", F.col("pass")) if shuffle else F.col("_place")
            numbered = index_by_key(df.select(key), f"{seed}-{i}", key, "_row") if shuffle else global_index(df.select(key), [key], "_row")
            own = whole(F.col("_d"), F.lit(batch))
            place = whole(own, F.lit(times)) * cycle + offset + F.pmod(own, F.lit(times))
            asked = drawn.withColumn("_row", row).select(
                "_row", place.alias("batch"), F.pmod("_d", F.lit(batch)).cast("int").alias("slot"), F.lit(i).alias("source"), F.col("pass").cast("int").alias("pass")
            )
            whole_rows = numbered if df.columns == [key] else joined_back(df, numbered, [key], "_row")
            frames.append(asked.join(whole_rows, "_row", "left").drop("_row"))  # left: an empty source is asked, too
        offset += times
    return reduce(lambda a, b: a.unionByName(b), frames)

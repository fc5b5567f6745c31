"""Grading results as they arrive, and keeping the latest result per id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalloom.operators.shards import dedupe_last
from evalloom.sinks.writers import write_jsonl

BAD, FILE = "_corrupt_line", "_file"


def grade_stream(
    spark: SparkSession, in_dir: str, out_dir: str, schema: T.StructType | str, grader: Callable[[DataFrame], DataFrame],
    checkpoint: str, max_files: int = 1000, rejected_dir: str | None = None,
) -> StreamingQuery:
    """Grade new result files with a stateless grader; what is no record goes to a second sink, with its file and text.

    Graded rows are JSON lines in ``out_dir/batch=<n>`` (``graded`` reads them), lines that don't parse or whose values
    don't fit the schema are JSON lines in ``rejected_dir/batch=<n>``, by default next to ``out_dir``. Each micro-batch
    overwrites its own two folders only, so a batch that is run again after a failure neither loses nor doubles rows.
    Stops when everything present has been graded; the checkpoint makes the next start continue with unseen
    files only.
    """
    rejected = rejected_dir or f"{out_dir.rstrip('/')}-rejected"
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    read = T.StructType([*fields, T.StructField(BAD, T.StringType())])
    lines = spark.readStream.schema(read).option("columnNameOfCorruptRecord", BAD).option("maxFilesPerTrigger", max_files).json(in_dir)
    lines = lines.select("*", F.col("_metadata.file_path").alias(FILE))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # both sinks see one reading of the files
        try:
            records = batch.filter(F.col(BAD).isNull()).drop(BAD, FILE)
            write_jsonl(grader(records), f"{out_dir}/batch={batch_id}", "overwrite")
            write_jsonl(batch.filter(F.col(BAD).isNotNull()).select(F.col(FILE).alias("file"), F.col(BAD).alias("text")), f"{rejected}/batch={batch_id}", "overwrite")
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graded(spark: SparkSession, out_dir: str, schema: T.StructType | str) -> DataFrame:
    """Rows of all batches of a sink of ``grade_stream``; a batch without rows has none."""
    return spark.read.schema(schema).option("basePath", out_dir).option("mode", "FAILFAST").json(out_dir).drop("batch")


def _commits(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches whose commit is complete, rising."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/commits/*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def _versions(spark: SparkSession, target: str, batch: int) -> dict[int, int]:
    """Which version of each bucket holds after ``batch``: one small file."""
    rows = spark.read.schema("bucket int, version long").json(f"{target}/commits/{batch}").collect()  # at most one row per bucket
    return {r.bucket: r.version for r in rows}


def _commit(spark: SparkSession, target: str, batch: int, versions: dict[int, int]) -> None:
    rows = spark.createDataFrame(sorted(versions.items()), "bucket int, version long")
    rows.coalesce(1).write.mode("overwrite").json(f"{target}/commits/{batch}")


def _read(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame:
    empty = spark.read.parquet(f"{target}/fields")
    paths = [f"{target}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_stream(df: DataFrame, target: str, key: str, order: Sequence[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep one row per key: each micro-batch's last row per key takes the place of the stored one.

    ``target`` is cut into ``buckets`` by a hash of the key. A batch rewrites the buckets that it has keys of, as its own
    version, and then commits which version of each bucket holds. It starts from the last commit before its own number, so
    a batch that is run again after a failure overwrites only what it wrote before, and a late retry replaces a failure
    of an earlier batch. What a batch costs grows with the buckets it touches: choose their number so that one is
    a few hundred MB. ``order`` and ``buckets`` must stay the same over restarts.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = dedupe_last(batch, key, order).drop("first_seen").withColumn("bucket", _bucket(key, buckets)).persist()
        try:
            rows.limit(0).drop("bucket").write.mode("ignore").parquet(f"{target}/fields")
            before = [b for b in _commits(spark, target) if b < batch_id]
            versions = _versions(spark, target, before[-1]) if before else {}
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most one row per bucket
            stored = _read(spark, target, {b: v for b, v in versions.items() if b in touched})
            kept = stored.join(rows.select(key), key, "left_anti").withColumn("bucket", _bucket(key, buckets))
            kept.select(*rows.columns).unionByName(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={batch_id}")
            _commit(spark, target, batch_id, {**versions, **dict.fromkeys(touched, batch_id)})
        finally:
            rows.unpersist()

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str, order: Sequence[str]) -> DataFrame:
    """The last result per id over all batches, as committed: one stored row per id, read without a shuffle."""
    done = _commits(spark, target)
    if not done:
        raise ValueError(f"no batch has been committed in {target}")
    return _read(spark, target, _versions(spark, target, done[-1]))


def compact(spark: SparkSession, target: str, new_target: str, key: str, order: Sequence[str], buckets: int = 64) -> None:
    """What holds now as the first version of a new folder, without superseded ones; readers switch when it is complete."""
    rows = latest(spark, target, key, order)
    rows.limit(0).write.mode("errorifexists").parquet(f"{new_target}/fields")
    placed = rows.withColumn("bucket", _bucket(key, buckets)).persist()
    try:
        placed.repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(f"{new_target}/version=-1")
        _commit(spark, new_target, -1, {r.bucket: -1 for r in placed.select("bucket").distinct().collect()})
    finally:
        placed.unpersist()

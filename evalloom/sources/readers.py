"""Readers for the file layouts of evaluation data. All return lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import strip


def exists(spark: SparkSession, path: str) -> bool:
    """True when a path or glob matches something on its own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def _strict(spark: SparkSession, schema: T.StructType | str) -> DataFrameReader:
    """Reads records of the schema or fails; nothing malformed becomes a row of NULLs."""
    return spark.read.schema(schema).option("mode", "FAILFAST")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a malformed line is an error, a missing path is an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return _strict(spark, schema).json(path)


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value): every line with its 0-based number in its file, whose splits are read by tasks of their own.

    A task meets the lines of a split in order, so a line's place in its split is its running number less the least
    one there. Splits are counted, which is a row per split, and a line's number is what the splits before it in the
    file hold plus its place. No file is one record, and the lines themselves are not shuffled unless there are
    too many splits to broadcast.
    """
    read = spark.read.option("lineSep", "\n").text(paths)
    lines = read.select(
        F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    ).withColumn("_task", F.shiftright("_at", 33))
    splits = lines.groupBy("file", "_split", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    unknown = F.raise_error(F.concat(F.lit("the splits of a file changed while it was read: "), F.col("file"))).cast("long")
    number = F.coalesce(F.col("_before") + F.col("_at") - F.col("_first"), unknown)
    return lines.join(splits, ["file", "_split", "_task"], "left").select("file", number.alias("line"), "value")


def read_lines(spark: SparkSession, path: str, drop_blank: bool = True) -> DataFrame:
    """Text lines with their line number (for word and prompt lists)."""
    lines = numbered_lines(spark, path).select("line", "value")
    return lines.filter(strip("value") != "") if drop_blank else lines


def read_keyed_documents(
    spark: SparkSession, path: str, field: str, schema: str, one_per_line: bool = False
) -> DataFrame:
    """``{field: {id: record}}`` or ``{field: [record]}`` -> one row per record, with ``doc_key`` and ``file``.

    ``schema`` is the DDL text of a record. A document is one JSON value and is parsed by one task. Large collections
    should keep one document per line, which Spark can split. A document that holds neither form is an error.
    """
    doc = spark.read.text(path, wholetext=not one_per_line).select("value", F.col("_metadata.file_name").alias("file"))
    doc = doc.filter(strip("value") != "")
    by_id, by_list = f"`{field}` map<string, struct<{schema}>>", f"`{field}` array<struct<{schema}>>"
    entries = F.coalesce(
        F.map_entries(F.from_json("value", by_id)[field]),
        F.transform(F.from_json("value", by_list)[field], lambda r, i: F.struct(i.cast("string").alias("key"), r.alias("value"))),
        F.raise_error(F.concat(F.lit(f"no records under {field!r} in "), F.col("file"))),
    )
    return doc.select("file", F.inline(entries)).select("file", F.col("key").alias("doc_key"), "value.*")


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.json") -> DataFrame:
    """One JSON-array file, or all ``*.json`` files of a folder, concatenated."""
    return _strict(spark, schema).option("multiLine", True).option("pathGlobFilter", pattern).json(path)


def read_yearly_csv(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = r"yob(\d{4})") -> DataFrame:
    """Headerless CSV per year; the year comes from the path, ``line`` orders rows inside a file.

    ``line`` is (place of the split in its file, number that rises inside a split), so files may have any
    number of splits. A malformed line is an error.
    """
    year = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int")
    line = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    return _strict(spark, schema).csv(path).select("*", year.alias("year"), line.alias("line"))


def read_split_table(spark: SparkSession, path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """Table partitioned by ``split``; unwanted splits are never listed or read."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split").isin(list(splits))) if splits is not None else df


def read_images(spark: SparkSession, path: str, pattern: str = "*.png", decode: bool = True) -> DataFrame:
    """Image files: name and, when decoded, width, height and pixels (blue-green-red rows).

    A file that cannot be decoded is a row with an ``error`` and no measures.
    """
    if decode:
        files = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(path)
        fine = F.col("image.width") > 0
        return files.select(
            F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("file_name"), F.when(fine, F.col("image.width")).alias("width"),
            F.when(fine, F.col("image.height")).alias("height"), F.when(fine, F.col("image.nChannels")).alias("channels"),
            F.when(fine, F.col("image.data")).alias("data"), F.when(~fine, F.lit("cannot be decoded")).alias("error"),
        )
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", "content")


def keep_sources(df: DataFrame, file_col: str, exclude: str, suffix: str = ".tar", name: str = "source") -> DataFrame:
    """Drop rows from files whose name contains ``exclude``; keep the bare file name as the source."""
    tail = F.regexp_extract(file_col, r"([^/]+)$", 1)
    bare = F.when(tail.endswith(suffix), tail.substr(F.lit(1), F.length(tail) - len(suffix))).otherwise(tail)
    return df.filter(~tail.contains(exclude)).withColumn(name, bare)


def read_with_source(
    spark: SparkSession, path: str, schema: T.StructType | str, exclude: str, suffix: str = ".jsonl"
) -> DataFrame:
    """JSON-lines files with their file name as ``source``; files named like ``exclude`` stay out.

    The exclusion is a filter on file metadata, which prunes the listing, so
    excluded files are not opened.
    """
    df = _strict(spark, schema).json(path).withColumn("_file", F.col("_metadata.file_name"))
    return keep_sources(df, "_file", exclude, suffix).drop("_file")


def run_of_file(file_col, pattern: str, fields: Sequence[str]) -> list:
    """Columns picked out of a file name by the groups of ``pattern``."""
    return [F.regexp_extract(file_col, pattern, i + 1).alias(f) for i, f in enumerate(fields)]


def missing_runs(df: DataFrame, expected: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Expected (model, experiment, seed) combinations without any row."""
    return expected.join(df.select(*fields).distinct(), list(fields), "left_anti")


def read_runs(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    pattern: str = r"([^/_]+)_([^/_]+)_(\d+)\.jsonl$",
    fields: Sequence[str] = ("model", "experiment", "seed"),
    expected: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Result files -> one frame with the run parsed from the file name, and the expected runs not found."""
    df = _strict(spark, schema).json(path)
    df = df.select("*", *run_of_file(F.col("_metadata.file_name"), pattern, fields))
    return df, None if expected is None else missing_runs(df, expected, fields)


def shard_number(path_col: Column) -> Column:
    """Number in ``shard_<n>``; anything else sorts last."""
    return F.coalesce(F.regexp_extract(path_col, r"shard_(\d+)(?:/|$)", 1).try_cast("int"), F.lit(10**9))


def read_shards(spark: SparkSession, root: str, run: str, file: str, schema: T.StructType | str) -> DataFrame:
    """``shard_*/run/file`` with an ingest order: shard number, then path, then line. Files of any size, read in splits."""
    pattern = f"{root}/shard_*/{run}/{file}"
    if not exists(spark, pattern):
        return spark.createDataFrame([], schema).withColumns({"shard": F.lit(0), "file": F.lit(""), "line": F.lit(0).cast("long")})
    lines = numbered_lines(spark, pattern).filter(strip("value") != "")
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(record.alias("_r"), shard_number(F.col("file")).alias("shard"), "file", "line").select("_r.*", "shard", "file", "line")


def join_sidecar(df: DataFrame, sidecars: DataFrame, path_col: str, field: str, by_stem: bool = False) -> DataFrame:
    """Attach a text kept in another file: by relative path, or by equal file stem."""
    if not by_stem:
        return df.join(sidecars.select(path_col, field), path_col, "left")
    stem = F.regexp_replace(path_col, r"\.[^./]*$", "")
    right = sidecars.select(stem.alias("_stem"), field)
    return df.withColumn("_stem", stem).join(right, "_stem", "left").drop("_stem")


def resolve_first_existing(df: DataFrame, key: str, candidates: str, files: DataFrame, path_col: str = "path") -> DataFrame:
    """Per row the first candidate path that is in the file listing, else NULL."""
    tried = df.select(key, F.posexplode(candidates).alias("_pos", path_col))
    hit = tried.join(files.select(path_col).distinct(), path_col, "left_semi")
    first = hit.groupBy(key).agg(F.min_by(path_col, "_pos").alias("resolved"))
    return df.join(first, key, "left")


def first_valid(df: DataFrame, valid, order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows in source order that pass validation."""
    return df.filter(valid).orderBy(*order).limit(n)


def verify_content_hash(expected: DataFrame, files: DataFrame, name: str, content: str, digest: str) -> DataFrame:
    """``ok`` / ``mismatch`` / ``missing`` per expected file."""
    actual = files.select(name, F.sha2(content, 256).alias("_actual"))
    status = (
        F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") == F.col(digest), "ok").otherwise("mismatch")
    )
    return expected.join(actual, name, "left").withColumn("status", status).drop("_actual")

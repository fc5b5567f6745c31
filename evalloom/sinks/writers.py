"""Writers for tables, JSON lines, metric CSVs and one-row summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JSON_OPTIONS = {"ignoreNullFields": "false"}


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines that keep null fields."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_split_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_metric_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A metric table (a few rows per model) as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def summary_text(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {**JSON_OPTIONS, "pretty": "true"}).alias("value"))


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row summary or manifest as one JSON document; a second row is an error."""
    one = F.when(F.monotonically_increasing_id() > 0, F.raise_error(F.lit("a summary has one row"))).otherwise(F.col("value"))
    summary_text(df).coalesce(1).select(one.alias("value")).write.mode(mode).text(path)


def write_run_outputs(path: str, run: str, text: DataFrame, image: DataFrame, mode: str = "errorifexists") -> None:
    """Text rows, image rows, case table, per-attribute table and summary of one run."""
    from evalloom.operators import joins, metrics

    text, image = text.persist(), image.persist()
    cases = joins.case_table(image, text, run).persist()
    try:
        write_jsonl(text, f"{path}/text_memory", mode)
        write_jsonl(image, f"{path}/image_memory", mode)
        write_jsonl(cases, f"{path}/case_table", mode)
        write_jsonl(metrics.per_attribute_modality(text, image), f"{path}/per_attribute", mode)
        write_summary(metrics.run_summary(text, image, run), f"{path}/summary", mode)
    finally:
        for df in (cases, image, text):
            df.unpersist()


def write_runs(path: str, runs: Mapping[str, tuple[DataFrame, DataFrame]], mode: str = "errorifexists") -> None:
    """Outputs of several runs, (text rows, image rows) each, in ``path/<run>``; of all of them, ``path/case_table`` and ``path/summary``.

    The summary lists the summaries of the runs, in the given order, and the totals of all cases. The case table of all
    runs is read back from those of the runs, so no case is worked out twice.
    """
    from evalloom.operators import joins, metrics

    cases, summaries = None, None
    for i, (run, (text, image)) in enumerate(runs.items()):
        write_run_outputs(f"{path}/{run}", run, text, image, mode)
        own = text.sparkSession.read.schema(joins.case_table(image, text, run).schema).option("mode", "FAILFAST").json(f"{path}/{run}/case_table")
        one = metrics.run_summary(text, image, run, own).select(F.lit(i).alias("place"), F.struct("*").alias("summary"))
        cases = own if cases is None else cases.unionByName(own)
        summaries = one if summaries is None else summaries.unionByName(one)
    if cases is None:
        raise ValueError("no runs")
    write_jsonl(cases, f"{path}/case_table", mode)
    listed = summaries.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "summary"))), lambda s: s["summary"]).alias("summaries"))
    totals = metrics.case_totals(cases).groupBy().agg(F.array_sort(F.collect_list(F.struct("*"))).alias("rows"))
    write_summary(listed.select(F.array(*[F.lit(run) for run in runs]).alias("runs"), "summaries", totals.scalar().alias("case_conclusion")), f"{path}/summary", mode)

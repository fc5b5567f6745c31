"""Joins between plans, results, files and gradings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import id_from_file_name

ATTRS = ("color", "pattern", "position", "shape")


def assign_names(faces: DataFrame, names: DataFrame, image: str = "image_name", gender: str = "gender") -> DataFrame:
    """Name by the id in the image's file name, male or female column by gender; no match is an error."""
    rows = faces.withColumn("_id", id_from_file_name(image))
    table = names.select(F.col("id").alias("_id"), "name_male", "name_female")
    name = F.when(F.col(gender) == "male", F.col("name_male")).otherwise(F.col("name_female"))
    found = F.coalesce(name, F.raise_error(F.concat(F.lit("no name for "), F.col(image))))
    return rows.join(table, "_id", "left").withColumn("name", found).drop("_id", "name_male", "name_female")


def keep_available(df: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose file exists."""
    return df.join(files.select(key), key, "left_semi")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not completed yet."""
    return df.join(done.select(key), key, "left_anti")


def case_table(image: DataFrame, text: DataFrame, run: str, attrs: Sequence[str] = ATTRS) -> DataFrame:
    """Per image row: which attributes were drawn right and which were also described right.

    The lookup table has one row per (type, code name) of the vocabulary; Spark
    broadcasts it below its byte threshold. A missing text row counts as wrong.
    """
    asked = text.filter("is_synthetic_query")
    lookup = asked.groupBy("concept_type", "concept_value_synthetic").agg(F.max("grading_correct").alias("_ok"))
    rows = image
    for a in attrs:
        own = lookup.filter(F.col("concept_type") == a).select(
            F.col("concept_value_synthetic").alias(f"synthetic_{a}"), F.col("_ok").alias(f"_ok_{a}")
        )
        rows = rows.join(own, f"synthetic_{a}", "left").withColumn(
            f"text_correct_{a}", F.coalesce(f"_ok_{a}", F.lit(False))
        )
    all_text = reduce(lambda x, y: x & y, [F.col(f"text_correct_{a}") for a in attrs])
    forgotten = [F.when(F.col(f"grading_correct_{a}") & ~F.col(f"text_correct_{a}"), F.lit(a)) for a in attrs]
    return rows.select(
        F.lit(run).alias("checkpoint"),
        "sample_id", "dataset_index", "split", "prompt",
        *attrs,
        *[f"synthetic_{a}" for a in attrs],
        F.col("grading_all_correct").alias("image_all_correct"),
        *[F.col(f"grading_correct_{a}").alias(f"image_correct_{a}") for a in attrs],
        *[f"text_correct_{a}" for a in attrs],
        *[F.col(f"grading_detected_{a}").alias(f"detected_{a}") for a in attrs],
        (F.col("grading_all_correct") & ~all_text).alias("image_correct_text_wrong"),
        F.array_compact(F.array(*forgotten)).alias("image_attr_correct_text_wrong_attrs"),
    )


def modality_join(image_acc: DataFrame, text_acc: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Image and text accuracies side by side; a left row without exactly one partner is an error when it is read."""
    if not check:
        return image_acc.join(text_acc, list(keys), "inner")
    values = [c for c in text_acc.columns if c not in keys]
    right = text_acc.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in values])
    wrong = F.raise_error(F.concat(F.lit("partners of a row, not one: "), F.coalesce("_n", F.lit(0)).cast("string")))
    joined = image_acc.join(right, list(keys), "left")
    return joined.withColumns({c: F.when(F.col("_n") == 1, F.col(c)).otherwise(wrong) for c in values}).drop("_n")


def fulfilment_join(reqs: DataFrame, analysis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each requirement must match exactly one graded item, by its text, in each modality."""
    graded = analysis.groupBy(*keys, "modality", "requirement").agg(
        F.count(F.lit(1)).alias("_n"), F.min("status").alias("_status")
    )
    asked = reqs.withColumn("modality", F.explode(F.array(F.lit("text"), F.lit("image"))))
    joined = asked.join(graded, [*keys, "modality", "requirement"], "left")
    status = F.when(F.col("_n") == 1, F.col("_status")).otherwise(
        F.raise_error(F.concat(F.lit("not graded exactly once: "), F.col("requirement")))
    )
    return joined.withColumn("status", status).drop("_n", "_status")


def merge_existing(new: DataFrame, old: DataFrame, key: str, mode: str, parts: Mapping[str, str]) -> DataFrame:
    """Keep the stored result of each part that this run does not regenerate.

    ``parts`` maps a grading mode to the column it produces, e.g.
    ``{"text_to_image": "image_to_text_comparison", "image_to_image": "image_to_image_comparison"}``.
    """
    kept = [c for m, c in parts.items() if mode != "both" and m != mode]
    if not kept:
        return new
    stored = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in kept])
    joined = new.join(stored, key, "left")
    current = [F.coalesce(f"_old_{c}", c if c in new.columns else F.lit(None)).alias(c) for c in kept]
    return joined.select(*[c for c in new.columns if c not in kept], *current)


def attach_rubric(rows: DataFrame, rubric: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their rubric, rows without one)."""
    return rows.join(rubric, key, "inner"), rows.join(rubric.select(key), key, "left_anti")


def union_with_source(frames: Mapping[str, DataFrame], name: str = "source") -> DataFrame:
    """Concatenate by column name, tag the origin, fill absent columns with NULL."""
    tagged = [df.withColumn(name, F.lit(origin)) for origin, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

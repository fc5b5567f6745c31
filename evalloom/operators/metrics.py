"""Accuracy, refusal, verdict and case tables.

Group keys have few values, so partial aggregation shrinks rows before every
shuffle; hot keys cost one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.context import one_row
from evalloom.functions.seeded import column
from evalloom.functions.text import model_of_run
from evalloom.operators.joins import ATTRS
from evalloom.operators.tabular import unpivot_columns


def answer_flags(df: DataFrame, answer: str = "grading_answer_key", expected: str = "expected_key") -> DataFrame:
    """``unknown`` and ``correct`` as 0/1; no answer is unknown and wrong."""
    a = F.col(answer)
    return df.withColumns({"unknown": a.isNull().cast("int"), "correct": F.coalesce((a == F.col(expected)).cast("int"), F.lit(0))})


def row_mean(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / F.lit(len(cols)))


def sem(c: Column | str) -> Column:
    """Standard error of the mean with n - 1; NULL for a single value."""
    v = column(c)
    return F.stddev_samp(v) / F.sqrt(F.count(v))


def mean_sem(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), sem(m).alias(f"{m}_sem"))])


def two_level_mean_sem(df: DataFrame, run_key: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean inside each run, then mean and standard error over runs."""
    runs = df.groupBy(run_key, *keys).agg(*[F.avg(m).alias(m) for m in metrics])
    return mean_sem(runs, keys, metrics)


def accuracy_full_discounted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """correct / all, and correct / (all - unknown), which is NULL when everything is unknown."""
    total, right, lost = F.count(F.lit(1)), F.sum("correct"), F.sum("unknown")
    return df.groupBy(*keys).agg(
        total.alias("total"),
        right.alias("correct"),
        lost.alias("unknown"),
        F.try_divide(right, total).alias("accuracy_full"),
        F.try_divide(right, total - lost).alias("accuracy_discounted"),
    )


def macro_accuracy(df: DataFrame, run: str, kind: str, metric: str = "accuracy_discounted") -> DataFrame:
    """Accuracy per (run, type), mean over types, then mean and standard error per model."""
    per_type = accuracy_full_discounted(df, [run, kind])
    per_run = per_type.groupBy(run).agg(F.avg(metric).alias("accuracy")).withColumn("model", model_of_run(run))
    return mean_sem(per_run, ["model"], ["accuracy"])


def melt_metrics(df: DataFrame, ids: Sequence[str], suffix: str, name: str = "attribute", value: str = "value") -> DataFrame:
    """``color_correct, shape_correct`` -> (attribute, value) rows, suffix removed."""
    cols = {c: c.removesuffix(suffix) for c in df.columns if c.endswith(suffix)}
    return unpivot_columns(df, ids, cols, name, value)


def pivot_metrics(df: DataFrame, index: Sequence[str], columns: str, value: str, values: Sequence[str]) -> DataFrame:
    """Attribute rows -> columns; two rows for one cell are an error."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate cell"))).otherwise(F.max(value))
    cells = df.groupBy(*index, columns).agg(one.alias(value))
    return cells.groupBy(*index).pivot(columns, list(values)).agg(F.first(value))


def random_baseline(df: DataFrame, options: str = "num_options", keys: Sequence[str] = ()) -> DataFrame:
    """Mean of 1 / options over types."""
    return df.groupBy(*keys).agg(F.avg(F.try_divide(F.lit(1.0), F.col(options))).alias("baseline"))


def outcome_rates(df: DataFrame, keys: Sequence[str], outcome: str, outcomes: Sequence[str]) -> DataFrame:
    """Share of each outcome per group as columns; absent outcomes are 0, one that is not listed is an error."""
    listed = F.when(F.col(outcome).isin(list(outcomes)), F.col(outcome)).otherwise(F.raise_error(F.concat(F.lit("outcome not listed: "), F.col(outcome))))
    df = df.withColumn(outcome, F.when(F.col(outcome).isNotNull(), listed))
    known = F.count(outcome)
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.try_divide(F.count_if(F.col(outcome) == o), known), F.lit(0.0)).alias(o) for o in outcomes]
    )


def ordered_by_map(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows in the given key order; unknown keys are dropped, an absent key is an error."""
    absent = set(order) - {r[0] for r in df.filter(F.col(key).isin(list(order))).select(key).distinct().collect()}
    if absent:
        raise ValueError(f"keys without rows: {sorted(absent)}")
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(key))
    return df.filter(F.col(key).isin(list(order))).orderBy(place)


def verdict_rate(df: DataFrame, keys: Sequence[str], verdict: str = "grading_verdict", error: str = "grading_error") -> DataFrame:
    """positive / (positive + negative + partial) per group; error rows are counted apart."""
    fine = F.col(error).isNull()
    known = F.coalesce(F.col(verdict).isin(C.VERDICTS), F.lit(False))
    checked = df.withColumn(
        "_verdict",
        F.when(fine & ~known, F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce(verdict, F.lit("NULL"))))).when(fine, F.col(verdict)),
    )
    return checked.groupBy(*keys).agg(
        F.try_divide(F.count_if(F.col("_verdict") == "positive"), F.count("_verdict")).alias("accuracy"),
        F.count(error).alias("errors"),
    )


def run_accuracy(df: DataFrame, run: str, correct: str = "grading_correct") -> DataFrame:
    return df.groupBy(run).agg(F.avg(F.col(correct).cast("int")).alias("accuracy"))


def pooled_mean_sem(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and standard error over all rows, ignoring runs."""
    return mean_sem(df, keys, metrics)


def parse_rate(df: DataFrame, keys: Sequence[str], seed: str = "seed", direction: str = "forward") -> DataFrame:
    """Parsed and correct share per seed, then mean and standard error; one direction only."""
    rows = df.filter(F.col("direction") == direction).withColumn("parsed", 1 - F.col("unknown"))
    return two_level_mean_sem(rows, seed, keys, ["parsed", "correct"])


# ------------------------------------------------------------- run summaries
def metric(correct: Column | str, total: Column | str) -> Column:
    """struct(correct, total, accuracy) with accuracy 0.0 on an empty set."""
    c, t = column(correct), column(total)
    return F.struct(c.alias("correct"), t.alias("total"), F.coalesce(F.try_divide(c, t), F.lit(0.0)).alias("accuracy"))


def _right(c: str) -> Column:
    return F.count_if(F.col(c))


def summarize_text(df: DataFrame) -> DataFrame:
    """Overall, by query kind, and by kind and attribute, in one pass (NULL = all)."""
    return (
        df.groupingSets(
            [[], ["is_synthetic_query"], ["is_synthetic_query", "concept_type"]], "is_synthetic_query", "concept_type"
        )
        .agg(metric(_right("grading_correct"), F.count(F.lit(1))).alias("m"))
        .select("is_synthetic_query", "concept_type", "m.*")
    )


def summarize_image(df: DataFrame, by: str | None = None, attrs: Sequence[str] = ATTRS) -> DataFrame:
    """All-correct and per-attribute accuracy; with ``by`` also per split, the NULL group being overall."""
    cells = [metric(_right(f"grading_correct_{a}"), F.count(F.lit(1))).alias(f"{a}_accuracy") for a in attrs]
    whole = metric(_right("grading_all_correct"), F.count(F.lit(1))).alias("all_attribute_accuracy")
    grouped = df.groupBy() if by is None else df.groupingSets([[], [by]], by)
    return grouped.agg(F.count(F.lit(1)).alias("num_rows"), whole, *cells)


def per_attribute_modality(text: DataFrame, image: DataFrame, attrs: Sequence[str] = ATTRS) -> DataFrame:
    """Image and text counts and accuracies side by side, one row per attribute."""
    total = F.count(F.lit(1))
    seen = image.groupBy().agg(total.alias("image_total"), *[_right(f"grading_correct_{a}").alias(a) for a in attrs])
    seen = unpivot_columns(seen, ["image_total"], {a: a for a in attrs}, "attribute", "image_correct")
    told = text.filter("is_synthetic_query").groupBy(F.col("concept_type").alias("attribute")).agg(
        _right("grading_correct").alias("text_correct"), total.alias("text_total")
    )
    zero = F.lit(0).cast("long")
    both = seen.join(F.broadcast(told.filter(F.col("attribute").isin(list(attrs)))), "attribute", "left")
    return both.select(
        "attribute",
        "image_correct", "image_total", F.coalesce(F.try_divide("image_correct", "image_total"), F.lit(0.0)).alias("image_accuracy"),
        F.coalesce("text_correct", zero).alias("text_correct"), F.coalesce("text_total", zero).alias("text_total"),
        F.coalesce(F.try_divide("text_correct", "text_total"), F.lit(0.0)).alias("text_accuracy"),
    )


def case_totals(cases: DataFrame, attrs: Sequence[str] = ATTRS) -> DataFrame:
    """Totals and rates overall and per split, for whole images (attribute NULL) and per attribute.

    Every attribute's count is a column of one small aggregate that is turned
    into rows afterwards, so image rows are never multiplied.
    """
    total = F.count(F.lit(1))
    wide = cases.groupingSets([[], ["split"]], "split").agg(
        F.grouping("split").alias("_all"), total.alias("total"),
        _right("image_all_correct").alias("image_all_correct"),
        _right("image_correct_text_wrong").alias("image_correct_text_wrong"),
        *[F.count_if(F.col(f"image_correct_{a}") & ~F.col(f"text_correct_{a}")).alias(f"_w_{a}") for a in attrs],
    )
    none = F.lit(None).cast("long")
    rows = F.array(
        F.struct(F.lit(None).cast("string").alias("attribute"), F.col("image_all_correct").alias("all_right"), F.col("image_correct_text_wrong").alias("case_wrong"), none.alias("attr_wrong")),
        *[F.struct(F.lit(a).alias("attribute"), none.alias("all_right"), none.alias("case_wrong"), F.col(f"_w_{a}").alias("attr_wrong")) for a in attrs],
    )
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.concat(F.lit("split:"), "split"))
    long = wide.select(scope.alias("scope"), "total", F.inline(rows))
    rate = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col("total")), F.lit(0.0))
    return long.select(
        "scope", "attribute", "total",
        F.col("all_right").alias("image_all_correct"), F.col("case_wrong").alias("image_correct_text_wrong"),
        F.col("attr_wrong").alias("image_attr_correct_text_wrong"),
        rate(F.col("case_wrong")).alias("image_correct_text_wrong_rate"),
        rate(F.col("attr_wrong")).alias("image_attr_correct_text_wrong_rate"),
    )


def count_by(df: DataFrame, col: str, expected: Sequence) -> DataFrame:
    """Row counts per value, zero for expected values that do not occur."""
    one = df.groupBy().agg(*[F.count_if(F.col(col) == v).alias(f"n{i}") for i, v in enumerate(expected)])
    cells = F.array(*[F.struct(F.lit(v).alias(col), F.col(f"n{i}").alias("n")) for i, v in enumerate(expected)])
    return one.select(F.inline(cells))


def attribute_space(options: DataFrame, group: str = "group", attribute: str = "attribute", value: str = "value") -> DataFrame:
    """Distinct options and their number per attribute, with the products per group and in total.

    Input is a vocabulary table; sizes multiply as doubles, exact up to 2^53.
    """
    per = options.groupBy(group, attribute).agg(F.array_sort(F.collect_set(value)).alias("options"))
    per = per.withColumn("count", F.size("options"))
    combos = per.groupingSets([[], [group]], group).agg(F.product("count").alias("combinations"))
    listed = per.select(group, attribute, "options", "count", F.lit(None).cast("double").alias("combinations"))
    totals = combos.select(
        F.coalesce(group, F.lit("total")).alias(group), F.lit(None).cast("string").alias(attribute),
        F.lit(None).cast("array<string>").alias("options"), F.lit(None).cast("int").alias("count"), "combinations",
    )
    return listed.unionByName(totals)


def run_summary(text: DataFrame, image: DataFrame, run: str, cases: DataFrame | None = None) -> DataFrame:
    """One nested row out of the text, image, per-attribute and case summaries."""
    from evalloom.operators.joins import case_table

    tables: Mapping[str, DataFrame] = {
        "text": summarize_text(text),
        "image": summarize_image(image, "split"),
        "per_attribute_image_text_accuracy": per_attribute_modality(text, image),
        "cases": case_totals(case_table(image, text, run) if cases is None else cases),
    }
    folded = {n: one_row(df.groupBy().agg(F.array_sort(F.collect_list(F.struct("*"))).alias("rows"))) for n, df in tables.items()}
    one = text.sparkSession.range(1)
    return one.select(F.lit(run).alias("run"), *[row["rows"].alias(n) for n, row in folded.items()])

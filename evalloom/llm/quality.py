"""Quality rules as a short-circuit cascade, in Spark expressions only.

A rule is a rejection condition over the row. On a bounded sample each rule's rejection rate is
counted and its cost timed; the cascade then tries rules by rejections per second, and a row that
one rule rejects is not shown to the next (a CASE evaluates its branches in turn). The order
changes how much work is done, never which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.store import free_name

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]"
SAMPLE_ROWS = 2000
REPEATS = 3  # runs of a rule over the sample
GRAM = 5


def word_array(text: Column) -> Column:
    """Maximal runs without white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))).cast("long")


def repeated_words(words: Column, k: int = GRAM) -> Column:
    """Words inside windows of ``k`` words that stand twice or more in the text, the first included.

    Window hashes are sorted with their places; equal neighbours mark repeated windows, and the gaps
    between their sorted places count every covered word once.
    """
    windows = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.struct(F.xxhash64(*(F.get(words, i + (j - 1)) for j in range(k))).alias("h"), i.alias("i"))))
    ordered = F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>")))
    none = F.array().cast("array<int>")

    def places(w: Column) -> Column:
        twice = F.filter(w, lambda x, j: (x.h == F.get(w, j - 1).h) | (x.h == F.get(w, j + 1).h))
        return F.sort_array(F.coalesce(F.transform(twice, lambda x: x.i), none))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.coalesce(F.least(F.lit(k), F.get(at, j + 1) - p), F.lit(k)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    # let() keeps each array a value: an inlined array would be built again for every element
    return let(ordered, lambda w: let(places(w), covered))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with a struct ``into`` of what the rules read."""
    words = word_array(F.col(text))
    stats = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        symbols(F.col(text)).alias("n_symbols"),
        repeated_lines(F.col(text)).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    return docs.withColumn(into, stats)


def standard_rules(text: str = "text") -> dict[str, Column]:
    """Rejection conditions over the text alone, so that the cascade pays only for those it reaches."""
    col = F.col(text)
    n = F.size(word_array(col))
    return {
        "few_words": n < 10,
        "repeated_words": let(word_array(col), lambda w: 100 * repeated_words(w) > 20 * F.size(w)),
        "symbols": 10 * symbols(col) > n,
        "repeated_lines": 10 * repeated_lines(col) > 3 * lines(col),
    }


def measured_rules(stats: str, text: str = "text") -> dict[str, Column]:
    """The same conditions over measured statistics; lines are counted only for rows that no rule before rejects."""
    s = F.col(stats)
    return {
        "few_words": s.n_words < 10,
        "repeated_words": 100 * s.n_repeat_words > 20 * s.n_words,
        "symbols": 10 * s.n_symbols > s.n_words,
        "repeated_lines": 10 * s.n_dup_lines > 3 * lines(F.col(text)),
    }


def cascade_order(docs: DataFrame, rules: Mapping[str, Column], sample_rows: int = SAMPLE_ROWS, fraction: float = 0.1, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejection rate) on a sample of at most ``sample_rows`` rows, best rejections per second first.

    The sample is a ``fraction`` of the rows of the first partitions that fill it; it is read once and kept in
    memory meanwhile. A rule's cost is the least of several runs over it, less that of a rule that asks nothing, so that
    what any job costs is not counted. An empty sample leaves the rules in the given order.
    """
    sample = docs.sample(fraction=fraction, seed=seed).limit(sample_rows).persist()

    def run(reject: Column) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(F.coalesce(reject, F.lit(False)))).first()[0]
        return time.perf_counter() - start, rejected

    try:
        n = sample.count()
        if not n:
            return [(name, 0.0, 0.0) for name in rules]
        nothing = min(run(F.col(sample.columns[0]).isNull())[0] for _ in range(REPEATS))
        found = []
        for name, reject in rules.items():
            runs = [run(reject) for _ in range(REPEATS)]
            found.append((name, max(min(s for s, _ in runs) - nothing, 1e-4), runs[0][1] / n))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(docs: DataFrame, rules: Mapping[str, Column], into: str = "rejected_by", order: list[str] | None = None, **sampling) -> DataFrame:
    """``docs`` with the name of the rule that rejects each row, or null; rules run in ``order``, by default the sampled one.

    A condition that is null does not reject. Which of several rejecting rules is named depends on the order;
    whether a row is rejected does not. Empty tables give no rows; an existing column ``into`` is an error.
    """
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists; name another")
    order = order or [name for name, _, _ in cascade_order(docs, rules, **sampling)]
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rules[name], F.lit(name)).otherwise(verdict)
    return docs.withColumn(into, verdict)


def keep_quality(docs: DataFrame, text: str = "text", **sampling) -> DataFrame:
    """``docs`` that no standard rule rejects, columns as they were. A null text has no words and goes."""
    into = free_name(docs, "_rejected_by")
    return cascade(docs, standard_rules(text), into, **sampling).where(F.col(into).isNull()).drop(into)

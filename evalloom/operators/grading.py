"""Graders for letter answers, judge verdicts in JSON, attributes and refusals."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from string import ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalloom import constants as C
from evalloom.functions import text as X
from evalloom.functions.binding import bind
from evalloom.functions.seeded import column
from evalloom.sources.readers import exists

FROM_LETTER = "Recovered single option letter from non-single-letter answer"
FROM_TEXT = "Recovered single option text from non-single-letter answer"
UNCLEAR = "Could not identify exactly one option"


def _null() -> Column:
    return F.lit(None).cast("string")


def _in_range(key: Column, n: Column) -> Column:
    at = F.ascii(key) - ord("A")
    return (F.length(key) == 1) & (at >= 0) & (at < n)


def _normalized_all(options: Column) -> Column:
    """Normalised text of every option, null for none: one pass over all of them joined, unless one holds the joint itself."""
    joint = "\x01"
    joined = F.array_join(options.cast("array<string>"), joint, "")
    at_once = F.split(F.regexp_replace(F.lower(joined), f"[^a-z0-9 {joint}]+", " "), joint, -1)
    alone = F.length(joined) - F.length(F.replace(joined, F.lit(joint), F.lit(""))) == F.size(options) - 1
    return F.when(alone, at_once).otherwise(F.transform(options, lambda v: X.normalize_text(v.cast("string"))))


def grade_letter_strict(df: DataFrame, completion: str = "inference_completion", options: str = "options") -> DataFrame:
    """One-character answers are settled here; longer ones are marked ``needs_judge``."""
    raw = X.strip(completion)
    single, key = F.length(raw) == 1, F.upper(raw)
    valid = _in_range(key, F.size(options))
    return df.withColumns(
        {
            "grading_answer_key": F.when(single & valid, key),
            "grading_format_correct": F.coalesce(single & valid, F.lit(False)),
            "grading_format_error": F.when(single & ~valid, F.concat(F.lit("Invalid option: "), key)),
            "grading_error": _null(),
            "needs_judge": F.coalesce(~single, F.lit(False)),
        }
    )


def grade_letter_lenient(
    df: DataFrame, completion: str = "inference_completion", options: str = "options", expected: str = "expected_key"
) -> DataFrame:
    """Exact letter, else one distinct letter token, else one option whose text occurs as whole words.

    Tokens are searched in upper-cased text, so a one-letter word such as "a"
    counts as option A.
    """
    n = F.size(options)
    staged = df.withColumn("_raw", X.strip(completion)).withColumn("_upper", F.upper("_raw"))
    alone = F.regexp_extract_all("_upper", F.lit(r"(?<![\p{L}\p{N}_])[A-Z](?![\p{L}\p{N}_])"), F.lit(0))
    known = F.slice(F.array(*[F.lit(c) for c in ascii_uppercase]), F.lit(1), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))
    letters = F.array_intersect(alone, known)

    def hits(text: Column) -> Column:
        def mark(w: Column, i: Column) -> Column:
            return F.when((w != "") & text.contains(F.concat(F.lit(" "), w, F.lit(" "))), X.letter(i))

        return F.array_compact(F.transform(F.col("_wanted"), lambda v, i: mark(F.trim(v), i)))

    text = F.concat(F.lit(" "), X.normalize_text("_raw"), F.lit(" "))
    # option texts are searched only where letters leave the answer open
    staged = staged.withColumn("_exact", _in_range(F.col("_upper"), n))
    staged = staged.withColumn("_letters", F.when(~F.col("_exact"), letters))
    open_ = ~F.col("_exact") & (F.size("_letters") != 1)
    open_ = open_ & (F.col("_raw") != "")  # no option occurs in nothing
    staged = staged.withColumn("_wanted", F.when(open_, _normalized_all(F.col(options))))
    staged = staged.withColumn("_hits", F.when(open_, bind(text, hits)))
    one_letter, one_text = F.size("_letters") == 1, F.size("_hits") == 1
    key = F.when(F.col("_exact"), F.col("_upper")).when(one_letter, F.get("_letters", F.lit(0))).when(one_text, F.get("_hits", F.lit(0)))
    problem = F.when(F.col("_exact"), _null()).when(one_letter, FROM_LETTER).when(one_text, FROM_TEXT).otherwise(UNCLEAR)
    return staged.withColumns(
        {
            "grading_answer_key": key,
            "grading_format_correct": F.coalesce(F.col("_exact"), F.lit(False)),
            "grading_format_error": problem,
            "grading_correct": key.eqNullSafe(F.col(expected)),
        }
    ).drop("_raw", "_upper", "_exact", "_letters", "_wanted", "_hits")


# ------------------------------------------------------------ judge verdicts
def _json_type(c: Column, path: str) -> Column:
    """STRING, VOID (JSON null), BIGINT, ...; NULL when the key is absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))


def _exactly(found: Column, keys: Sequence[str]) -> Column:
    """A list of distinct keys holds these and no others."""
    wanted = F.array(*[F.lit(k) for k in keys])
    return (F.size(found) == len(keys)) & (F.size(F.array_except(found, wanted)) == 0)


def parse_mc_verdict(df: DataFrame, json_col: str, options: str = "options") -> DataFrame:
    """Judge JSON with exactly ``answer_key`` and ``format_error``, one of them set; else a technical error."""
    c = F.col(json_col)
    parsed = df.withColumns(
        {
            "_body": F.from_json(c, "answer_key string, format_error string"),
            "_keys": F.array_distinct(F.json_object_keys(c)),
            "_kinds": F.array(_json_type(c, "$.answer_key"), _json_type(c, "$.format_error")),
        }
    )
    key, problem, keys = F.col("_body.answer_key"), F.col("_body.format_error"), F.col("_keys")
    odd = F.exists("_kinds", lambda k: ~k.isin("STRING", "VOID"))
    error = (
        F.when(keys.isNull(), "not a JSON object")
        .when(~_exactly(keys, ["answer_key", "format_error"]), "invalid verdict keys")
        .when(key.isNull() & problem.isNull(), "no verdict values")
        .when(F.coalesce(odd, F.lit(False)), "invalid verdict types")
        .when(key.isNotNull() & ~_in_range(key, F.size(options)), "invalid answer key")
        .when(key.isNotNull() & problem.isNotNull(), "both verdict values set")
    )
    staged = parsed.withColumn("_error", error)
    fine = F.col("_error").isNull()
    return staged.withColumns(
        {
            "grading_answer_key": F.when(fine, key),
            "grading_format_correct": F.lit(False),
            "grading_format_error": F.when(fine, problem),
            "grading_error": F.col("_error"),
        }
    ).drop("_body", "_keys", "_kinds", "_error")


def parse_attribute_verdict(df: DataFrame, json_col: str, vocab: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Judge JSON with one text (or null) per attribute, mapped back to the option key.

    ``vocab`` is {attribute: {key: text}}. One invalid value fails the row.
    """
    body = F.from_json(json_col, "map<string,string>")
    staged = df.withColumns({"_body": body, "_keys": F.array_distinct(F.json_object_keys(json_col))})
    named, invalid = [], []
    for attr, options in vocab.items():
        value = F.regexp_replace(F.try_element_at("_body", F.lit(attr)), r"^`+|`+\z", "")
        key = X.lookup(value, {text: k for k, text in options.items()})
        named += [F.lit(attr), key]
        invalid.append(F.when(value.isNotNull() & key.isNull(), value))
    bad = F.coalesce(*invalid)
    error = (
        F.when(F.col("_keys").isNull(), "not a JSON object")
        .when(~_exactly(F.col("_keys"), list(vocab)), "invalid attribute keys")
        .when(bad.isNotNull(), F.concat(F.lit("Invalid attribute value: "), bad))
    )
    staged = staged.withColumns({"_map": F.create_map(*named), "grading_error": error})
    fine = F.col("grading_error").isNull()
    return staged.withColumn("grading_inferred_attributes", F.when(fine, F.col("_map"))).drop("_body", "_keys", "_map")


def parse_enum_verdict(df: DataFrame, json_col: str, allowed: Sequence[str] = tuple(C.VERDICTS), field: str = "verdict") -> DataFrame:
    """One field inside an enumeration; anything else is a technical error."""
    value = F.get_json_object(json_col, f"$.{field}")
    fine = F.coalesce(value.isin(list(allowed)), F.lit(False))
    return df.withColumns(
        {
            "grading_verdict": F.when(fine, value),
            "grading_error": F.when(~fine, F.concat(F.lit("Failed to parse judge verdict: "), F.coalesce(value, F.lit("no value")))),
        }
    )


def parse_judge_scores(
    df: DataFrame, col: str, defaults: Mapping[str, float] = C.NO_SCORES, name: str = "comparison"
) -> DataFrame:
    """Free text around a JSON answer -> struct(textual_analysis, scores); zero scores and a reason on any failure."""
    staged = df.withColumn("_block", X.escape_newlines_in_strings(X.json_block(col)))
    parsed = F.from_json("_block", "textual_analysis string, scores map<string,double>")
    staged = staged.withColumns({"_body": parsed, "_keys": F.json_object_keys("_block")})
    body, keys = F.col("_body"), F.col("_keys")
    zero = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(float(v)))])
    reason = (
        F.when(F.col(col).isNull() | (F.col(col) == ""), "no response")
        .when(keys.isNull(), "response is not a JSON object")
        .when(~F.array_contains(keys, "textual_analysis") | ~F.array_contains(keys, "scores"), F.concat(F.lit("Invalid response structure: "), F.col(col)))
        .when(body["scores"].isNull(), "scores are not numbers")
    )
    failed = F.col("_reason").isNotNull()
    return staged.withColumn("_reason", reason).withColumn(
        name,
        F.struct(
            F.when(failed, F.col("_reason")).otherwise(body["textual_analysis"]).alias("textual_analysis"),
            F.when(failed, zero).otherwise(body["scores"]).alias("scores"),
            failed.alias("failed"),
        ),
    ).drop("_block", "_body", "_keys", "_reason")


def match_attributes(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Detected equals expected per attribute (null-safe), and all of them."""
    hits = {f"grading_correct_{a}": F.col(f"grading_detected_{a}").eqNullSafe(F.col(a)) for a in attrs}
    return df.withColumns(hits).withColumn("grading_all_correct", reduce(lambda a, b: a & b, [F.col(h) for h in hits]))


# ------------------------------------------------------------ plug-in judges
def with_judge(
    df: DataFrame, fn: Callable[[dict], dict], fields: str, max_in_flight: int = 64, error: str = "grading_error",
    retries: int = 0, pause: float = 0.0, waiting: int = 4096,
) -> DataFrame:
    """Call ``fn`` on every row with at most ``max_in_flight`` open calls per task.

    ``fn`` gets the row as a dict and returns the values of ``fields`` (DDL text). An exception is tried again up to
    ``retries`` times, after ``pause`` seconds that double each time; the last one becomes the row's error text
    and never fails the job. Calls run ahead of the rows put out by up to ``waiting`` rows, across batches, so
    that a slow call holds up no other; rows keep their order.
    """
    added = T.StructType.fromDDL(fields)
    names = added.fieldNames()
    schema = T.StructType([*df.schema.fields, *added.fields, T.StructField(error, T.StringType())])

    def call(row: dict) -> dict:
        for attempt in range(retries + 1):
            try:
                answer = fn(row)
                return {**{n: answer.get(n) for n in names}, error: None}
            except Exception as ex:  # the text of any failure belongs to its row
                failed = ex
                if attempt < retries:
                    time.sleep(pause * 2**attempt)
        return {**{n: None for n in names}, error: f"Failed to query judge: {failed}"}

    kinds = {f.name: f.type for f in to_arrow_schema(T.StructType([*added.fields, T.StructField(error, T.StringType())]))}

    def finished(piece: pa.RecordBatch, calls: list) -> pa.RecordBatch:
        answers = [c.result() for c in calls]
        new = [pa.array([a[n] for a in answers], kinds[n]) for n in [*names, error]]
        return pa.RecordBatch.from_arrays([*piece.columns, *new], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, ahead = deque(), 0
        with ThreadPoolExecutor(max_workers=max_in_flight) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, max_in_flight):
                    piece = batch.slice(start, max_in_flight)
                    window.append((piece, [pool.submit(call, row) for row in piece.to_pylist()]))  # whole numbers and NULLs stay what they are
                    ahead += piece.num_rows
                    while window and (ahead > waiting or all(c.done() for c in window[0][1])):
                        ahead -= window[0][0].num_rows
                        yield finished(*window.popleft())
            while window:
                yield finished(*window.popleft())

    return df.mapInArrow(run, schema)


def judge_with_ledger(
    df: DataFrame, key: str, fn: Callable[[dict], dict], fields: str, ledger: str, parts: int = 16, error: str = "grading_error", **options
) -> DataFrame:
    """``df`` with the judge's answers, called once per key however often this is started again.

    Rows are judged in ``parts`` jobs by a hash of the key; each appends its answers to the folder ``ledger`` when it is
    done. A start after a failure calls only keys that have no answer there, and those whose last call failed. A lost
    task repeats its own share of one part at most. ``key`` must identify a row. ``options`` go to ``with_judge``.
    """
    added = T.StructType.fromDDL(fields)
    kept = T.StructType([df.schema[key], *added.fields, T.StructField(error, T.StringType())])
    spark, names = df.sparkSession, [*added.fieldNames(), error]
    part = F.pmod(F.xxhash64(key), F.lit(parts))

    def answers() -> DataFrame:
        found = T.StructType([*kept.fields, T.StructField("judge_part", T.IntegerType())])
        return spark.read.schema(found).parquet(ledger) if exists(spark, f"{ledger}/*") else spark.createDataFrame([], found)

    for i in range(parts):
        fine = answers().filter(F.col(error).isNull() & (F.col("judge_part") == i)).select(key)
        todo = df.filter(part == i).join(fine, key, "left_anti")
        judged = with_judge(todo, fn, fields, error=error, **options).select(key, *names)
        judged.write.mode("append").parquet(f"{ledger}/judge_part={i}")
    best = F.max_by(F.struct(*names), F.col(error).isNull())
    return df.join(answers().groupBy(key).agg(best.alias("_answer")), key, "left").select(*df.columns, "_answer.*")

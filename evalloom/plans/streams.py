"""Streaming queries, run to completion over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import grading
from evalloom.plans.common import derive, registry, scratch, table
from evalloom.plans.grades import ANSWERS, STRICT, filled
from evalloom.sinks.writers import write_jsonl
from evalloom.streaming import results

QUERIES, query = registry()


@query("grade_stream", STRICT)
def _(spark, sf):
    root = scratch(spark)
    rows = derive(spark, sf, ANSWERS).withColumn("options", F.split("opts", r"\|")).drop("opts")
    write_jsonl(rows.repartition(4), f"{root}/in")
    schema = "o_orderkey long, options array<string>, expected_key string, inference_completion string"
    results.grade_stream(spark, f"{root}/in", f"{root}/out", schema, grading.grade_letter_strict, f"{root}/state", 2).awaitTermination()
    graded = results.graded(spark, f"{root}/out", "o_orderkey long, grading_answer_key string, grading_format_correct boolean, grading_format_error string, needs_judge boolean")
    return filled(graded, "grading_answer_key", "grading_format_error")


@query("grade_stream_rejects", """select 'rejected' as sink, case when o_orderkey % 3 = 0 then '{"o_orderkey": ' || o_orderkey else '{"o_orderkey": "' || o_orderstatus || '"}' end as text, count(*)::bigint as n from orders where o_orderkey % 3 < 2 group by 2
    union all select 'graded', o_orderkey::varchar, 1 from orders where o_orderkey % 3 = 2""")
def _(spark, sf):
    """Torn lines and values of another type are kept apart with their text; whole lines are graded."""
    root = scratch(spark)
    value = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"o_orderkey": '), "o_orderkey")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"o_orderkey": "'), "o_orderstatus", F.lit('"}'))).otherwise(F.concat(F.lit('{"o_orderkey": '), "o_orderkey", F.lit("}")))
    table(spark, sf, "orders").select(value.alias("value")).repartition(4).write.text(f"{root}/in")
    results.grade_stream(spark, f"{root}/in", f"{root}/out", "o_orderkey long", lambda df: df, f"{root}/state", 2).awaitTermination()
    bad = results.graded(spark, f"{root}/out-rejected", "file string, text string").groupBy("text").agg(F.count("*").alias("n"))
    fine = results.graded(spark, f"{root}/out", "o_orderkey long").select(F.lit("graded").alias("sink"), F.col("o_orderkey").cast("string").alias("text"), F.lit(1).cast("long").alias("n"))
    return bad.select(F.lit("rejected").alias("sink"), "text", "n").unionByName(fine)


@query("upsert_stream", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def _(spark, sf):
    root = scratch(spark)
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    for part in range(3):  # three arrivals; later files hold later events
        start, end = part / 3, (part + 1) / 3
        last = rows.agg(F.max("event_id")).first()[0] + 1
        write_jsonl(rows.filter((F.col("event_id") >= start * last) & (F.col("event_id") < end * last)), f"{root}/in/arrival={part}")
        stream = spark.readStream.schema("user_id long, event_type string, event_id long").json(f"{root}/in/arrival=*")
        results.upsert_stream(stream, f"{root}/target", "user_id", ["event_id"], f"{root}/state").awaitTermination()
    return results.latest(spark, f"{root}/target", "user_id", ["event_id"])

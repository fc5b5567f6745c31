"""End to end: lookup questions -> answers -> grading -> accuracy over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.seeded import seeded_int
from evalloom.operators import choices, grading, metrics
from evalloom.plans.builders import LOTS
from evalloom.plans.common import derive, duck, key_of, shuffled, u32

QUERIES = {}
MODELS = ("alpha-0", "alpha-1", "alpha-2", "beta-0", "beta-1", "beta-2")
# shares of answer kinds: right letter, wrong letter, sentence, out of range, option text, empty
KINDS = 10


def answered(questions: DataFrame, seed: int) -> DataFrame:
    """Deterministic stand-in answers of every run to every question."""
    q = questions.withColumn("run_id", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    q = q.withColumn("_roll", F.pmod(seeded_int(seed, "run_id", "concept_value", "is_synthetic_query"), F.lit(KINDS)))
    roll = F.col("_roll")
    right = F.get("options", F.array_position("options", F.when(F.col("is_synthetic_query"), F.col("concept_value")).otherwise(F.col("concept_value_synthetic"))).cast("int") - 1)
    completion = (
        F.when(roll < 4, F.concat(F.lower("expected_key"), F.lit("\n")))
        .when(roll == 4, "A").when(roll == 5, F.concat(F.lit("The answer is "), "expected_key", F.lit(".")))
        .when(roll == 6, "Z").when(roll == 7, F.concat(F.lit("I choose "), right)).when(roll == 8, "no idea, sorry").otherwise("")
    )
    return q.withColumn("inference_completion", completion).drop("_roll")


def graded(df: DataFrame) -> DataFrame:
    """Letters are settled strictly; the rest goes through the lenient reading."""
    strict = grading.grade_letter_strict(df).select(*df.columns, F.col("grading_answer_key").alias("_strict"), "needs_judge")
    both = grading.grade_letter_lenient(strict)
    key = F.when(F.col("needs_judge"), F.col("grading_answer_key")).otherwise(F.col("_strict"))
    return both.withColumn("grading_answer_key", key)


def scored(code_map: DataFrame, seed: int) -> DataFrame:
    questions = choices.mc_lookup(code_map, seed)
    flags = metrics.answer_flags(graded(answered(questions, seed)))
    return flags.withColumn("kind", F.when(F.col("is_synthetic_query"), "code_to_value").otherwise("value_to_code"))


def shaped(df: DataFrame) -> DataFrame:
    return df.select("model", *[F.coalesce(F.round(c, 9), F.lit(-1.0)).alias(c) for c in ("accuracy_mean", "accuracy_sem")])


NATIONS = """select r_name as type, n_name as value, concat('code_', n_nationkey) as code from {nation} join {region} on n_regionkey = r_regionkey"""


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    code_map = derive(spark, sf_dir, NATIONS)
    return shaped(metrics.macro_accuracy(scored(code_map, 6666), "run_id", "kind"))


def _sql(source: str, seed: int) -> str:
    runs = ", ".join(f"'{m}'" for m in MODELS)
    return f"""with m as ({source}), l as (select type, list(value order by value) as vs, list(code order by code) as cs from m group by type),
        q as (select m.type, value, code, false as syn, code as answer, cs as pool from m join l using (type) union all select m.type, value, code, true, value, vs from m join l using (type)),
        s as (select *, {shuffled('pool', seed, 'type', 'value', 'syn')} as o from q), e as (select *, {key_of('o', 'answer')} as expected from s),
        a as (select *, {u32(seed, 'run_id', 'value', 'syn')} % {KINDS} as roll from e, (select unnest([{runs}]) as run_id)),
        g as (select *, case when roll < 4 or roll = 5 then expected when roll = 4 then 'A' when roll = 7 then expected end as answer_key from a),
        f as (select run_id, syn, (answer_key is null)::int as unknown, coalesce((answer_key = expected)::int, 0) as correct from g),
        t as (select run_id, syn, sum(correct) / nullif(count(*) - sum(unknown), 0) as acc from f group by all),
        r as (select run_id, split_part(run_id, '-', 1) as model, avg(acc) as acc from t group by all)
        select model, coalesce(round(avg(acc), 9), -1.0) as accuracy_mean, coalesce(round(stddev_samp(acc) / sqrt(count(acc)), 9), -1.0) as accuracy_sem from r group by model"""


def _lots(spark, sf):
    return shaped(metrics.macro_accuracy(scored(derive(spark, sf, LOTS), 6666), "run_id", "kind"))


QUERIES["letter_evaluation"] = (_lots, _sql(duck(LOTS), 6666))
QUERIES["letter_evaluation_nations"] = (evaluation, _sql(duck(NATIONS), 6666))

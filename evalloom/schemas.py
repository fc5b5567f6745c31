"""Explicit schemas as DDL text: JSON is never read by inference, which costs a scan and flips types on null columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

RESERVED_PREFIXES = ("inference_", "grading_")

PAIRS = "prompt string, completion string"
REFUSAL_ROWS = "prompt string, completion string, is_refusal boolean"
CHOICE_ROWS = ("prompt string, expected_key string, options array<string>, concept_type string, concept_value string, "
    "concept_value_synthetic string, is_synthetic_query boolean")
CHOICE_RESULTS = "sample_id string, options array<string>, expected_key string, inference_completion string"
LETTER_GRADE = "grading_answer_key string, grading_format_correct boolean, grading_format_error string, grading_error string"
ATTRIBUTE_GRADE = "grading_inferred_attributes map<string,string>, grading_error string"
VERDICT_GRADE = "grading_verdict string, grading_error string"
CLAUSE = "class string, count int, color string, position struct<relation string, object_idx int>"
RAW_SPEC = (
    "prompt string, tag string, "
    "include array<struct<class string, count int, color string, position array<string>>>, "
    "exclude array<struct<class string, count int, color string, position array<string>>>"
)
SPEC_KEYS = ["prompt", "tag", "include", "exclude"]
ANALYSIS_ITEM = "struct<requirement string, status string, explanation string>"
STORED_SCORES = "struct<correct int, incorrect int, missing int>"
RUBRIC_DOC = ("poster_name string, poster_id string, positive_requirements array<string>, negative_requirements array<string>, "
    f"text_fulfillment struct<text_fulfillment_analysis array<{ANALYSIS_ITEM}>, scores {STORED_SCORES}>, "
    f"image_fulfillment struct<image_fulfillment_analysis array<{ANALYSIS_ITEM}>, scores {STORED_SCORES}>")
FACE_RECORD = ("image_name string, full_prompt string, name string, attributes struct<gender string, eye_color string, "
    "hair_color string, hair_style string, accessories string, name string, secondary_attributes struct<age_group string, "
    "skin_tone string, face_shape string, eyebrow_shape string, lip_shape string, facial_features string>>")
YEARLY_NAMES = "name string, gender string, count int"


def check_prefixes(df: DataFrame, added: list[str]) -> None:
    """Results may only add reserved-prefix columns and must not overwrite any."""
    wrong = [c for c in added if not c.startswith(RESERVED_PREFIXES)]
    taken = [c for c in added if c in df.columns]
    if wrong or taken:
        raise ValueError(f"not a result column: {wrong}; already present: {taken}")

"""Entity descriptions and name lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.functions import text as X
from evalloom.functions.seeded import permuted, pick_one, whole
from evalloom.operators.positions import global_index, index_by_key


def random_secondary(
    df: DataFrame, key: str, seed: int, categories: Mapping[str, Sequence[str]] = C.SECONDARY_OPTIONS
) -> DataFrame:
    """A random value per secondary category, drawn independently per category."""
    return df.withColumns(
        {c: pick_one(F.array(*[F.lit(v) for v in values]), seed, key, F.lit(c)) for c, values in categories.items()}
    )


def describe_face(df: DataFrame, name: str = "description") -> DataFrame:
    """Attribute values -> one portrait description."""
    phrase = F.concat_ws(
        ", ",
        F.lit(C.PORTRAIT_LEAD),
        "face_shape",
        "eyebrow_shape",
        "lip_shape",
        "facial_features",
        X.lookup("age_group", C.AGE_PHRASES),
        F.concat("skin_tone", F.lit(" skin type on Fitzpatrick scale")),
        "gender",
        F.coalesce(X.lookup("eye_color", C.EYE_PHRASES), F.concat("eye_color", F.lit(" eyes"))),
        F.coalesce(X.lookup("hair_color", C.HAIR_PHRASES), F.concat("hair_color", F.lit(" hair"))),
        X.lookup("hair_style", C.STYLE_PHRASES),
        X.lookup("accessories", C.ACCESSORY_PHRASES),
    )
    return df.withColumn(name, phrase)


def clean_first_names(df: DataFrame) -> DataFrame:
    """Distinct trimmed names; the last (year, line) decides the gender."""
    rows = df.select(X.strip("name").alias("name"), X.strip("gender").alias("gender"), "year", "line")
    return rows.groupBy("name").agg(F.max_by("gender", F.struct("year", "line")).alias("gender"))


def clean_surnames(df: DataFrame) -> DataFrame:
    """Non-null one-word names in title case, sorted."""
    rows = df.na.drop().filter(~F.col("name").contains(" "))
    return rows.select(F.initcap(F.lower("name")).alias("name")).distinct().orderBy("name")


def sample_unique_names(
    first: DataFrame, last: DataFrame, n: int, gender: str, seed: int, allow_dup_parts: bool = False
) -> tuple[DataFrame, int]:
    """(``n`` full names, number missing). Parts never repeat unless ``allow_dup_parts``.

    Without repeats both lists are shuffled and paired by position. With repeats, name d is pair number perm(d) of all
    pairs of a first and a last name, in a seeded permutation: ``n`` different pairs whenever there are that
    many, and never more drawn than asked for. Both lists must hold distinct names, last names being one word.
    """
    own = first.filter(F.col("gender") == gender).select(F.col("name").alias("first_name"))
    family = last.select(F.col("name").alias("last_name"))
    below = None if allow_dup_parts else n
    firsts = index_by_key(own, f"{seed}-{gender}-first", "first_name", "_pos", below=below)
    lasts = index_by_key(family, f"{seed}-{gender}-last", "last_name", "_pos", below=below)
    full = F.concat_ws(" ", "first_name", "last_name").alias("name")
    n_first, n_last = own.count(), family.count()
    if not allow_dup_parts:
        return firsts.join(lasts, "_pos").select(F.col("_pos").alias("pos"), full), max(0, n - min(n_first, n_last))
    pairs = n_first * n_last
    drawn = first.sparkSession.range(min(n, pairs)).withColumn("_pair", permuted("id", max(1, pairs), f"{seed}-{gender}"))
    parts = drawn.select(F.col("id").alias("pos"), whole(F.col("_pair"), F.lit(max(1, n_last))).alias("_f"), F.pmod("_pair", F.lit(max(1, n_last))).alias("_l"))
    named = parts.join(firsts.withColumnRenamed("_pos", "_f"), "_f").join(lasts.withColumnRenamed("_pos", "_l"), "_l")
    return named.select("pos", full), max(0, n - pairs)


def pair_name_lists(a: DataFrame, b: DataFrame, pos: str = "pos", name: str = "name") -> DataFrame:
    """Zip two positioned name lists to the shorter one, with ids 0001.. and a text line."""
    left = index_from_order(a, pos).select("_i", F.col(name).alias("name_female"))
    right = index_from_order(b, pos).select("_i", F.col(name).alias("name_male"))
    rows = left.join(right, "_i").select(X.zero_pad(F.col("_i") + 1, 4).alias("id"), "name_female", "name_male")
    return rows.withColumn("line", F.concat("id", F.lit(": "), "name_female", F.lit(", "), "name_male"))


def index_from_order(df: DataFrame, order: str) -> DataFrame:
    return global_index(df, [order], "_i")

"""Compositional prompt specifications: parse, normalise, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom import schemas


def _clauses(c: str) -> Column:
    """``["left of", 0]`` -> struct(relation, object_idx); an absent list -> []."""
    rows = F.transform(
        F.col(c),
        lambda o: F.struct(
            o["class"].alias("class"),
            o["count"].alias("count"),
            o["color"].alias("color"),
            F.when(
                o["position"].isNotNull(),
                F.struct(o["position"][0].alias("relation"), o["position"][1].cast("int").alias("object_idx")),
            ).alias("position"),
        ),
    )
    return F.coalesce(rows, F.array().cast(f"array<struct<{schemas.CLAUSE}>>"))


def parse_compositional_specs(df: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON specification text -> prompt, tag, include, exclude; unknown keys are an error."""
    extra = F.array_except(F.json_object_keys(col), F.array(*[F.lit(k) for k in schemas.SPEC_KEYS]))
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown key: "), F.array_join(extra, ", ")))).otherwise(F.col(col))
    raw = df.select(*keep, F.from_json(checked, schemas.RAW_SPEC).alias("_s")).select(*keep, "_s.*")
    return raw.select(*keep, "prompt", "tag", _clauses("include").alias("include"), _clauses("exclude").alias("exclude"))


def export_compositional_specs(df: DataFrame, name: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Inverse of the parser: null fields and empty lists vanish, positions become two-element lists.

    The two-element list mixes types, so it is written by hand inside the text.
    """

    def clause(o: Column) -> Column:
        fields = F.concat_ws(
            ",",
            F.concat(F.lit('"class":'), F.to_json(o["class"].try_cast("variant"))),
            F.concat(F.lit('"count":'), o["count"].cast("string")),
            F.concat(F.lit('"color":'), F.to_json(o["color"].try_cast("variant"))),
            F.concat(
                F.lit('"position":['), F.to_json(o["position"]["relation"].try_cast("variant")), F.lit(","),
                o["position"]["object_idx"].cast("string"), F.lit("]"),
            ),
        )
        return F.concat(F.lit("{"), fields, F.lit("}"))

    def listing(c: str) -> Column:
        items = F.array_join(F.transform(F.col(c), clause), ",")
        return F.when(F.size(c) > 0, F.concat(F.lit(f'"{c}":['), items, F.lit("]")))

    head = F.concat(F.lit('"tag":'), F.to_json(F.col("tag").try_cast("variant")))
    prompt = F.concat(F.lit('"prompt":'), F.to_json(F.col("prompt").try_cast("variant")))
    body = F.concat_ws(",", prompt, head, listing("include"), listing("exclude"))
    return df.select(*keep, F.concat(F.lit("{"), body, F.lit("}")).alias(name))

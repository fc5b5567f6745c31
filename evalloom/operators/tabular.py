"""Projections, filters and validation of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.seeded import column, seeded_int
from evalloom.functions.text import strip


def single_turn_pairs(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    first_role: str = "human", second_role: str = "gpt",
) -> DataFrame:
    """Conversations of exactly two turns, asker then answerer -> (prompt, completion).

    Counts and conditional maxima combine before the shuffle, so one very long
    conversation costs each task a single partial row.
    """

    def at(i: int, c: str) -> Column:
        return F.max(F.when(F.col(turn) == i, F.col(c)))

    grouped = turns.groupBy(conv).agg(
        F.count(F.lit(1)).alias("_n"),
        at(0, role).alias("_r0"), at(1, role).alias("_r1"),
        at(0, text).alias("prompt"), at(1, text).alias("completion"),
    )
    keep = (F.col("_n") == 2) & (F.col("_r0") == first_role) & (F.col("_r1") == second_role)
    return grouped.filter(keep).select(conv, "prompt", "completion")


def select_contract(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the contract columns, before frames of different origin are united."""
    return df.select(*keep)


def filter_single_image_mc(
    df: DataFrame, n_images: int = 7, stem: str = "image_", kind: str = "question_type", wanted: str = "multiple-choice"
) -> DataFrame:
    """Rows with the first image only and a choice question; the image column loses its number."""
    spare = [f"{stem}{i}" for i in range(2, n_images + 1)]
    alone = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in spare], F.col(f"{stem}1").isNotNull())
    return df.filter(alone & (F.col(kind) == wanted)).drop(*spare).withColumnRenamed(f"{stem}1", "image")


def filter_image_geometry(
    df: DataFrame, min_side: int = 8, min_ratio: float = 0.1, max_ratio: float = 10.0,
    width: str = "width", height: str = "height",
) -> DataFrame:
    w, h = F.col(width), F.col(height)
    ratio = F.try_divide(w.cast("double"), h.cast("double"))
    return df.filter((w > min_side) & (h > min_side) & (ratio > min_ratio) & (ratio < max_ratio))


def crop_resize_plan(
    df: DataFrame, mode: str, size: int, width: str = "width", height: str = "height",
    roi: Sequence[str] | None = None, seed: int | str = 0, key: str | None = None,
) -> DataFrame:
    """Crop box and target size per image; pixels are not touched.

    ``shorter_side`` scales without cropping; ``center_square`` crops (inside
    ``roi`` = x, y, w, h columns when given); ``random_square`` slides the
    square by a seeded offset.
    """
    w, h, zero = F.col(width), F.col(height), F.lit(0)
    if mode == "shorter_side":
        scale = F.lit(float(size)) / F.least(w, h)
        box = (zero, zero, w, h)
        target = (F.rint(w * scale).cast("int"), F.rint(h * scale).cast("int"))
    elif mode == "center_square":
        x, y, rw, rh = (F.coalesce(F.col(c), d) for c, d in zip(roi, (zero, zero, w, h))) if roi else (zero, zero, w, h)
        side = F.least(rw, rh)
        left, top = x + (rw - side) / 2, y + (rh - side) / 2
        box = (left, top, left + side, top + side)
        target = (F.lit(size), F.lit(size))
    elif mode == "random_square":
        side = F.least(w, h)
        draw = F.pmod(seeded_int(seed, key), F.abs(w - h) + 1).cast("int")
        left, top = F.when(w > h, draw).otherwise(0), F.when(w > h, 0).otherwise(draw)
        box = (left, top, left + side, top + side)
        target = (F.lit(size), F.lit(size))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    named = {n: b.cast("double") for n, b in zip(("crop_left", "crop_top", "crop_right", "crop_bottom"), box)}
    return df.withColumns({**named, "target_width": target[0], "target_height": target[1]})


def replace_term(df: DataFrame, col: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the term replaced, violations: term absent, or still there in another case)."""
    done = F.replace(F.col(col), F.lit(old), F.lit(new))
    violation = (
        F.when(~F.col(col).contains(old), "absent").when(F.lower(done).contains(old.lower()), "remains")
    )
    tagged = df.withColumn("_violation", violation)
    good = tagged.filter(F.col("_violation").isNull()).drop("_violation").withColumn(col, done)
    return good, tagged.filter(F.col("_violation").isNotNull()).withColumnRenamed("_violation", "violation")


def coalesce_name(top: Column | str = "name", nested: Column | str = "attributes.name") -> Column:
    return F.coalesce(column(top), column(nested), F.lit("Unknown"))


def flatten_record(
    df: DataFrame, struct: str = "attributes", secondary: str = "secondary_attributes", keep: Sequence[str] = ("image_name",)
) -> DataFrame:
    """Nested attributes -> flat columns; the secondary group gets the prefix ``s_``."""
    fields = df.schema[struct].dataType
    first = [F.col(f"{struct}.{f}").alias(f) for f in fields.names if f not in (secondary, "name")]
    second = [F.col(f"{struct}.{secondary}.{f}").alias(f"s_{f}") for f in fields[secondary].dataType.names]
    return df.select(*keep, coalesce_name("name", f"{struct}.name").alias("name"), *first, *second)


def limit_rows(df: DataFrame, n: int | None, order: Sequence) -> DataFrame:
    """Deterministic head; ``None`` keeps all rows."""
    return df if n is None else df.orderBy(*order).limit(n)


def prefix_columns(df: DataFrame, prefix: str, cols: Sequence[str]) -> DataFrame:
    """Rename result columns; refuse to hide an existing one."""
    renamed = {c: f"{prefix}{c}" for c in cols}
    taken = sorted(set(renamed.values()) & set(df.columns))
    if taken:
        raise ValueError(f"columns already present: {taken}")
    return df.withColumnsRenamed(renamed)


def forbid_substring(df: DataFrame, col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the reserved marker, violations)."""
    found = F.coalesce(F.col(col).contains(text), F.lit(False))
    return df.filter(~found), df.filter(found)


def passthrough_prompt(df: DataFrame, col: str, drop: Sequence[str] = ("image",)) -> DataFrame:
    """``prompt`` from one column; every other column except images rides along."""
    return df.select(F.col(col).alias("prompt"), *[c for c in df.columns if c not in drop and c != "prompt"])


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in a list; blanks around listed ids are ignored."""
    wanted = ids.select(strip(ids.columns[0]).alias(key)).filter(F.col(key) != "")
    return df.join(wanted, key, "left_semi")


def filter_splits(df: DataFrame, names: str, col: str = "split") -> DataFrame:
    """``'train, test'``: blanks and empty parts are ignored."""
    return df.filter(F.col(col).isin([n.strip() for n in names.split(",") if n.strip()]))


def error_counts(df: DataFrame, run: str | Sequence[str], error: str = "grading_error") -> DataFrame:
    runs = [run] if isinstance(run, str) else list(run)
    return df.groupBy(*runs).agg(F.count(F.lit(1)).alias("rows"), F.count(error).alias("errors"))


def gate_errors(df: DataFrame, run: str, action: str = "fail", error: str = "grading_error") -> DataFrame:
    """``report`` counts error rows per run, ``drop`` removes them, ``fail`` stops at the first run that has any."""
    if action == "report":
        return error_counts(df, run, error)
    if action == "drop":
        return df.filter(F.col(error).isNull())
    if action != "fail":
        raise ValueError(f"unknown action {action!r}")
    worst = error_counts(df, run, error).filter("errors > 0").orderBy(run).take(1)
    if worst:
        raise ValueError(f"errors in run {worst[0][run]!r}: {worst[0]['errors']}")
    return df


def patch_known_rows(
    df: DataFrame, patches: DataFrame, run: str, text: str, value: str, error: str = "grading_error"
) -> DataFrame:
    """Overwrite a graded value, and clear the error, of error rows whose text starts with a listed prefix.

    ``patches`` (run, prefix, value) is a hand-written list; a run's patches
    travel as one short array, so the join never multiplies rows.
    """
    listed = patches.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("prefix", "value"))).alias("_patches"))
    match = F.filter("_patches", lambda p: F.col(text).startswith(p["prefix"]))
    hit = F.when(F.col(error).isNotNull(), F.try_element_at(match, F.lit(1))["value"])
    return (
        df.join(listed, run, "left")
        .withColumn("_new", hit)
        .withColumn(value, F.coalesce("_new", value))
        .withColumn(error, F.when(F.col("_new").isNull(), F.col(error)))
        .drop("_patches", "_new")
    )


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str], key: str, value: str) -> DataFrame:
    """Columns -> rows; ``columns`` maps a column to the name it gets in ``key``."""
    cells = F.array(*[F.struct(F.lit(n).alias(key), F.col(c).alias(value)) for c, n in columns.items()])
    return df.select(*ids, F.inline(cells))

"""Object detections: thresholds, overlaps, relative positions and compositional grading.

Boxes are columns x0, y0, x1, y1, score; ``det_id`` breaks score ties. Lists of
boxes exist only after the top-16 cut per (image, class), which bounds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom import constants as C

BOX = ("x0", "y0", "x1", "y1")
# fixed values: colour words in report order
REPORT_COLORS = ["red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white"]


def filter_detections(
    det: DataFrame, counting: Column | None = None, top: int = C.BOXES_PER_CLASS,
    group: Sequence[str] = ("image_id", "class"), tie: str = "det_id",
) -> DataFrame:
    """Confident boxes, best 16 per (image, class).

    The rank limit is applied per task before the shuffle, so a hot group sends
    at most 16 rows per task.
    """
    least = F.lit(C.SCORE_MIN) if counting is None else F.when(counting, C.SCORE_MIN_COUNTING).otherwise(C.SCORE_MIN)
    best = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col(tie))
    return det.filter(F.col("score") > least).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def _area(b: dict[str, Column]) -> Column:
    return F.greatest(b["x1"] - b["x0"] + 1, F.lit(0.0)) * F.greatest(b["y1"] - b["y0"] + 1, F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap share with the inclusive-pixel (+1) convention."""
    inner = {
        "x0": F.greatest(a["x0"], b["x0"]), "y0": F.greatest(a["y0"], b["y0"]),
        "x1": F.least(a["x1"], b["x1"]), "y1": F.least(a["y1"], b["y1"]),
    }
    shared = _area(inner)
    total = _area({k: a[k] for k in BOX}) + _area({k: b[k] for k in BOX}) - shared
    return F.coalesce(F.try_divide(shared, total), F.lit(0.0))


def boxes_per_class(det: DataFrame, extra: Sequence[str] = ("color",), group: Sequence[str] = ("image_id", "class")) -> DataFrame:
    """Ranked boxes (at most 16) of each (image, class) as one sorted list."""
    item = F.struct("rank", *[F.col(c).cast("double").alias(c) for c in BOX], "score", "det_id", *extra)
    return det.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("boxes"))


def suppress_overlaps(det: DataFrame, iou: float = 1.0, extra: Sequence[str] = ()) -> DataFrame:
    """Greedy suppression by descending score inside each ranked group; a threshold of 1.0 switches it off."""
    if iou == 1.0:
        return det
    grouped = boxes_per_class(det, extra)
    kept = F.aggregate(
        "boxes",
        F.filter("boxes", lambda b: F.lit(False)),
        lambda acc, b: F.when(F.exists(acc, lambda k: box_iou(k, b) >= iou), acc).otherwise(F.array_append(acc, b)),
    )
    return grouped.select("image_id", "class", F.inline(kept))


def relative_position(a: Column, b: Column) -> Column:
    """Where box ``a`` lies relative to box ``b``: any of left of, right of, above, below."""

    def axis(lo: str, hi: str) -> tuple[Column, Column]:
        offset = (a[lo] + a[hi]) / 2 - (b[lo] + b[hi]) / 2
        slack = F.lit(C.OFFSET_SLACK) * (F.abs(a[hi] - a[lo]) + F.abs(b[hi] - b[lo]))
        return offset, F.greatest(F.abs(offset) - slack, F.lit(0.0)) * F.signum(offset)

    (ox, rx), (oy, ry) = axis("x0", "x1"), axis("y0", "y1")
    norm = F.sqrt(ox * ox + oy * oy)
    dx, dy = F.try_divide(rx, norm), F.try_divide(ry, norm)
    cut = F.lit(C.DIRECTION_CUT)
    names = F.array_compact(
        F.array(
            F.when(dx < -cut, "left of"), F.when(dx > cut, "right of"), F.when(dy < -cut, "above"), F.when(dy > cut, "below")
        )
    )
    return F.when((F.abs(rx) < 1e-3) & (F.abs(ry) < 1e-3), F.array().cast("array<string>")).otherwise(names)


def grade_compositional(specs: DataFrame, det: DataFrame, key: str = "image_id") -> DataFrame:
    """Include clauses must all hold, exclude clauses must not; reasons are collected.

    ``specs`` has (key, include, exclude), ``det`` ranked boxes with a colour.
    Clauses meet their boxes by an equi-join on (image, class). A position
    clause looks at an earlier clause's boxes, so clauses are folded in order
    inside the row of their image.
    """
    from evalloom.schemas import CLAUSE

    def clauses(kind: str) -> Column:
        return F.transform(F.col(kind), lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), c.cast(f"struct<{CLAUSE}>").alias("c")))

    parts = specs.select(key, F.inline(F.concat(clauses("include"), clauses("exclude"))))
    found = boxes_per_class(det, ("color",), (key, "class"))
    met = parts.withColumn("class", F.col("c.class")).join(found, [key, "class"], "left")
    none = met.schema["boxes"].dataType.simpleString()
    boxes = F.coalesce("boxes", F.array().cast(none))
    item = F.struct("i", "c.class", "c.count", "c.color", "c.position", boxes.alias("boxes"))

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)), lambda a, b: a["i"] - b["i"])

    per_image = met.groupBy(key).agg(listed("include").alias("_inc"), listed("exclude").alias("_exc"))
    state = F.struct(F.array().cast("array<string>").alias("reasons"), F.array().cast(f"array<{none}>").alias("groups"))

    def step(acc: Column, c: Column) -> Column:
        have = F.slice(c["boxes"], F.lit(1), c["count"])
        same = F.size(F.filter(have, lambda b: b["color"] == c["color"]))
        listed_colors = F.array_join(
            F.filter(
                F.transform(
                    F.array(*[F.lit(x) for x in REPORT_COLORS]),
                    lambda x: F.when(
                        F.exists(have, lambda b: b["color"] == x),
                        F.concat(F.size(F.filter(have, lambda b: b["color"] == x)).cast("string"), F.lit(" "), x),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
            ", ",
        )
        need = c["count"].cast("string")
        target = F.get(acc["groups"], c["position"]["object_idx"])
        pairs = F.flatten(F.transform(have, lambda a: F.transform(target, lambda b: relative_position(a, b))))
        off = F.filter(pairs, lambda r: ~F.array_contains(r, c["position"]["relation"]))
        too_few = F.when(
            F.size(have) < c["count"],
            F.concat(F.lit("expected "), c["class"], F.lit(">="), need, F.lit(", found "), F.size(have).cast("string")),
        )
        wrong_color = F.when(
            c["color"].isNotNull() & (same < c["count"]),
            F.concat(
                F.lit("expected "), c["color"], F.lit(" "), c["class"], F.lit(">="), need, F.lit(", found "),
                same.cast("string"), F.lit(" "), c["color"], F.lit("; and "), listed_colors,
            ),
        )
        wrong_place = F.when(
            c["position"].isNotNull() & target.isNull(),
            F.concat(F.lit("no target for "), c["class"], F.lit(" to be "), c["position"]["relation"]),
        ).when(
            c["position"].isNotNull() & (F.size(off) > 0),
            F.concat(
                F.lit("expected "), c["class"], F.lit(" "), c["position"]["relation"], F.lit(" target, found "),
                F.array_join(F.get(off, F.lit(0)), " and "), F.lit(" target"),
            ),
        )
        reason = F.coalesce(too_few, wrong_color, wrong_place)
        return F.struct(
            F.when(reason.isNull(), acc["reasons"]).otherwise(F.array_append(acc["reasons"], reason)).alias("reasons"),
            F.array_append(acc["groups"], F.when(reason.isNull(), have)).alias("groups"),
        )

    folded = F.aggregate("_inc", state, step, lambda s: s["reasons"])
    crowded = F.filter(
        F.transform(
            "_exc",
            lambda c: F.when(
                F.size(c["boxes"]) >= c["count"],
                F.concat(
                    F.lit("expected "), c["class"], F.lit("<"), c["count"].cast("string"), F.lit(", found "),
                    F.size(c["boxes"]).cast("string"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    graded = per_image.select(key, F.concat(folded, crowded).alias("_reasons"))
    out = specs.select(key).join(graded, key, "left")
    reasons = F.coalesce("_reasons", F.array().cast("array<string>"))
    return out.select(key, (F.size(reasons) == 0).alias("grading_correct"), F.array_join(reasons, "\n").alias("grading_reason"))

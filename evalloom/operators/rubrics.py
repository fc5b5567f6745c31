"""Rubric documents: requirement counts, error rates, repairs and audits.

One input row is one document (`schemas.RUBRIC_DOC`, plus any run columns).
Everything about a single document is computed inside its row with array
expressions, so these operators need no shuffle; only rates and reports group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.functions.binding import bind
from evalloom.functions.seeded import column
from evalloom.operators.joins import fulfilment_join
from evalloom.operators.metrics import mean_sem, two_level_mean_sem

KEYS = ("poster_id",)
MODALITIES = ("text", "image")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _analysis(modality: str) -> Column:
    items = F.col(f"{modality}_fulfillment.{modality}_fulfillment_analysis")
    return F.coalesce(items, F.array().cast("array<struct<requirement:string,status:string,explanation:string>>"))


def _equals(text: str, field: str | None = None):
    """Predicate for one array element (a closure, as extra lambda arguments would mean the index)."""
    return lambda x: (x[field] if field else x) == text


def _counts_of(names: Sequence[str]):
    """struct of how often each name occurs in an array of names."""
    return lambda marks: F.struct(*[F.size(F.filter(marks, _equals(n))).alias(n) for n in names])


def explode_requirements(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, kind, idx, requirement) rows of both lists, in one pass."""

    def rows(kind: str) -> Column:
        return F.transform(_list(f"{kind}_requirements"), lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), r.alias("requirement")))

    return docs.select(*keys, F.inline(F.concat(rows("positive"), rows("negative"))))


def explode_analysis(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, modality, idx, requirement, status) rows of both analyses."""

    def rows(m: str) -> Column:
        return F.transform(
            _analysis(m),
            lambda a, i: F.struct(F.lit(m).alias("modality"), i.alias("idx"), a["requirement"].alias("requirement"), a["status"].alias("status")),
        )

    return docs.select(*keys, F.inline(F.concat(rows("text"), rows("image"))))


def fulfilment_counts(reqs: DataFrame, analysis: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """correct / missing / total per item, modality and kind, as columns of one row per (item, modality).

    A missing negative requirement, an unknown status and an item without
    positive requirements are errors.
    """
    rows = fulfilment_join(reqs, analysis, keys)
    bad = (
        F.when(~F.coalesce(F.col("status").isin(C.STATUSES), F.lit(False)), "unknown status")
        .when((F.col("status") == "MISSING") & (F.col("kind") == "negative"), "missing negative requirement")
    )
    rows = rows.withColumn("status", F.when(bad.isNull(), F.col("status")).otherwise(F.raise_error(bad)))

    def count(kind: str, status: str | None = None) -> Column:
        hit = F.col("kind") == kind
        return F.count_if(hit & (F.col("status") == status) if status else hit)

    counts = rows.groupBy(*keys, "modality").agg(
        count("positive", "CORRECT").alias("positive_correct"), count("positive").alias("positive_total"),
        count("positive", "MISSING").alias("positive_missing"),
        count("negative", "CORRECT").alias("negative_correct"), count("negative").alias("negative_total"),
    )
    total = F.when(F.col("positive_total") > 0, F.col("positive_total") + F.col("negative_total")).otherwise(
        F.raise_error(F.lit("no positive requirements"))
    )
    return counts.withColumns(
        {"all_correct": F.col("positive_correct") + F.col("negative_correct"), "all_total": total, "all_missing": F.col("positive_missing")}
    )


_MINOR = "positive_total - positive_correct - positive_missing"
_MAJOR = "negative_total - negative_correct"


def error_rates(counts: DataFrame) -> DataFrame:
    """Hallucination and omission share of all requirements."""
    return counts.withColumns(
        {
            "hallucination": F.expr(f"try_divide({_MINOR} + {_MAJOR}, all_total)"),
            "omission": F.expr("try_divide(positive_missing, all_total)"),
        }
    )


def severity_rates(counts: DataFrame) -> DataFrame:
    """Wrong positive share (minor) and wrong negative share (major); no negatives gives NULL, which means skip."""
    return counts.withColumns(
        {"minor": F.expr(f"try_divide({_MINOR}, positive_total)"), "major": F.expr(f"try_divide({_MAJOR}, negative_total)")}
    )


def rates_by_run(df: DataFrame, run: str, metrics: Sequence[str], by: Sequence[str] = ("modality",)) -> DataFrame:
    """Mean over items per run, then mean and standard error over runs."""
    return two_level_mean_sem(df, run, by, metrics)


def rates_by_item(df: DataFrame, item: str, metrics: Sequence[str], by: Sequence[str] = ("modality",)) -> DataFrame:
    """Mean and standard error per item over runs."""
    return mean_sem(df, [item, *by], metrics)


def positional_breakdown(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Match the analysis to requirements by list position.

    Items beyond the requirements are ignored and any status but CORRECT counts
    as incorrect. Negative requirements follow the positive ones.
    """
    n_pos, n_all = F.size(_list("positive_requirements")), F.size(_list("positive_requirements")) + F.size(_list("negative_requirements"))
    out = []
    for m in MODALITIES:
        marks = F.transform(
            _analysis(m),
            lambda a, i: F.when(
                i < n_all,
                F.concat(F.when(i < n_pos, "positive").otherwise("negative"), F.when(a["status"] == "CORRECT", "_correct").otherwise("_incorrect")),
            ),
        )
        names = ("positive_correct", "positive_incorrect", "negative_correct", "negative_incorrect")
        out.append(bind(marks, _counts_of(names)).alias(f"_{m}"))
    flat = [F.col(f"_{m}.{n}").alias(f"{m}_{n}") for m in MODALITIES for n in names]
    return docs.select(*keys, n_all.alias("total_requirements"), *out).select(*keys, "total_requirements", *flat)


def share_pct(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 when there is nothing."""
    return F.coalesce(F.bround(F.try_divide(part, whole) * 100, 1), F.lit(0.0))


def percentages(df: DataFrame, parts: Sequence[str], total: str = "total_requirements") -> DataFrame:
    return df.withColumns({f"{p}_pct": share_pct(F.col(p), F.col(total)) for p in parts})


def drop_invalid_items(docs: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(documents without graded items that are in neither list, log of removals)."""
    valid = F.concat(_list("positive_requirements"), _list("negative_requirements"))

    def text(a: Column) -> Column:
        return F.coalesce(a["requirement"], F.lit(""))

    def split(m: str, keep: bool) -> Column:
        """Known or unknown items; the set difference is hashed, so this is linear for few unknown texts."""

        def pick(unknown: Column) -> Column:
            return F.filter(_analysis(m), lambda a: F.array_contains(unknown, text(a)) != F.lit(keep))

        return bind(F.array_except(F.transform(_analysis(m), text), valid), pick)

    def removed(m: str) -> Column:
        return F.transform(split(m, False), lambda a: F.struct(F.lit(m).alias("modality"), text(a).alias("requirement")))

    log_rows = F.concat(*[removed(m) for m in MODALITIES])
    log = docs.select(*keys, "poster_name", F.inline(log_rows)).withColumns(
        {"type": F.lit("invalid_requirement"), "action": F.lit("removed")}
    )
    fixed = docs
    for m in MODALITIES:
        s, items = f"{m}_fulfillment", f"{m}_fulfillment_analysis"
        fixed = fixed.withColumn(s, F.when(F.col(s).isNotNull(), F.col(s).withField(items, split(m, True))))
    return fixed, log


def _scores(m: str) -> Column:
    pos, neg = _list("positive_requirements"), _list("negative_requirements")
    parts = [("positive", "correct"), ("positive", "incorrect"), ("positive", "missing"), ("negative", "correct"), ("negative", "incorrect")]

    def marked(positive: Column) -> Column:
        def mark(a: Column) -> Column:
            text = F.coalesce(a["requirement"], F.lit(""))
            kind = F.when(F.array_contains(positive, text), "positive").when(F.array_contains(neg, text), "negative").otherwise("neither")
            return F.concat_ws("_", kind, F.lower(F.coalesce(a["status"], F.lit(""))))

        return F.transform(_analysis(m), mark)

    names = [f"{k}_{s.lower()}" for s in C.STATUSES for k in ("positive", "negative", "neither")]

    def shaped(c: Column) -> Column:
        sums = {s: c[f"positive_{s}"] + c[f"negative_{s}"] + c[f"neither_{s}"] for s in map(str.lower, C.STATUSES)}
        total = sum(sums.values(), F.lit(0))
        flat = [e for s, n in sums.items() for e in (n.alias(s), share_pct(n, total).alias(f"{s}_pct"))]
        return F.struct(*flat, F.struct(*[c[f"{k}_{s}"].alias(f"{k}_{s}") for k, s in parts]).alias("positive_negative_breakdown"))

    return bind(bind(bind(pos, marked), _counts_of(names)), shaped)


def recompute_scores(docs: DataFrame) -> DataFrame:
    """Counts, percentages and the positive/negative breakdown from the analysis itself.

    Status is case-insensitive, a text in both lists counts as positive, and
    repeated items count every time.
    """
    return docs.withColumns({f"{m}_scores": _scores(m) for m in MODALITIES})


def rebuild_summary(docs: DataFrame) -> DataFrame:
    """Flat and nested summary from recomputed scores."""
    scored = docs if "text_scores" in docs.columns else recompute_scores(docs)
    flat = [F.col(f"{m}_scores.{f}").alias(f"{m}_{f}") for m in MODALITIES for s in C.STATUSES for f in (s.lower(), f"{s.lower()}_pct")]
    n_pos, n_neg = F.size(_list("positive_requirements")), F.size(_list("negative_requirements"))
    nested = F.struct(
        *[F.col(f"{m}_scores.positive_negative_breakdown").alias(m) for m in MODALITIES],
        F.struct(n_pos.alias("positive_rubric"), n_neg.alias("negative_rubric")).alias("rubric_counts"),
    )
    return scored.withColumn("summary", F.struct(*flat, (n_pos + n_neg).alias("total_requirements"), nested.alias("positive_negative_breakdown")))


def find_irregularities(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tagged findings per document: (keys, poster_name, type, action, items, detail).

    The stored-score check compares statuses case-sensitively, before repair.
    """
    pos, neg = _list("positive_requirements"), _list("negative_requirements")
    both = F.concat(pos, neg)
    again = bind(F.array_sort(both), lambda a: F.filter(a, lambda x, i: (i > 0) & (x == F.get(a, i - 1))))
    graded = [F.transform(_analysis(m), lambda a: F.coalesce(a["requirement"], F.lit(""))) for m in MODALITIES]
    ungraded = F.array_sort(F.array_except(F.array_except(both, graded[0]), graded[1]))
    nothing = F.array().cast("array<string>")

    def finding(when: Column, kind: str, action: str, items: Column = nothing, detail: Column | None = None) -> Column:
        body = F.struct(F.lit(kind).alias("type"), F.lit(action).alias("action"), items.alias("items"), (F.lit("") if detail is None else detail).alias("detail"))
        return F.when(when, body)

    def mismatch(m: str) -> Column:
        whole = F.col(f"{m}_fulfillment")
        actual = [F.size(F.filter(_analysis(m), _equals(s, "status"))) for s in C.STATUSES]
        stored = [F.coalesce(whole["scores"][s.lower()], F.lit(0)) for s in C.STATUSES]
        differs = F.lit(False)
        for a, s in zip(actual, stored, strict=True):
            differs = differs | (a != s)
        text = lambda cs: F.concat_ws("/", *[c.cast("string") for c in cs])
        detail = F.concat(F.lit("actual "), text(actual), F.lit(" stored "), text(stored))
        return finding(whole.isNotNull() & differs, f"{m}_score_mismatch", "fixed", detail=detail)

    # helper columns are used more than once, so each is evaluated once
    docs = docs.withColumns({"_again": again, "_ungraded": ungraded})
    again, ungraded = F.col("_again"), F.col("_ungraded")
    found = F.array_compact(
        F.array(
            finding(F.col("positive_requirements").isNull(), "missing_positive_requirements", "warning"),
            finding(F.col("negative_requirements").isNull(), "missing_negative_requirements", "warning"),
            finding(F.size(both) == 0, "no_requirements", "error"),
            finding(F.size(again) > 0, "duplicate_requirements", "warning", again),
            mismatch("text"),
            mismatch("image"),
            finding(F.size(ungraded) > 0, "ungraded_requirements", "error", ungraded),
        )
    )
    return docs.select(*keys, "poster_name", F.inline(found))


def irregularity_report(found: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Number of documents and items per type, with the overall total in the NULL row."""
    rows = found.select("type", F.size("items").alias("n_items"))
    if removals is not None:
        rows = rows.unionByName(removals.select("type", F.lit(1).alias("n_items")))
    return rows.groupingSets([[], ["type"]], "type").agg(F.count(F.lit(1)).alias("instances"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"))


def reduction_report(before: DataFrame, merged: DataFrame, after: DataFrame, lists: Sequence[str], key: str = "poster_id") -> DataFrame:
    """Items before, after merging and after filtering, per content type and in total (NULL), with the reduction in percent."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("content"), F.size(_list(c)).alias("n")) for c in lists])
        return df.select(F.inline(rows)).select("content", F.lit(name).alias("stage"), "n")

    stages = counts(before, "original").unionByName(counts(merged, "deduplicated")).unionByName(counts(after, "final"))
    sums = {s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("original", "deduplicated", "final")}
    out = stages.groupingSets([[], ["content"]], "content").agg(*sums.values())
    gone = F.try_divide(F.col("original") - F.col("final"), F.col("original")) * 100
    return out.withColumn("reduction_pct", F.coalesce(gone, F.lit(0.0)))


def collect_comparisons(df: DataFrame, parts: dict[str, str] | None = None) -> DataFrame:
    """Available comparisons of an evaluation as a map of name -> struct(textual_analysis, scores)."""
    names = parts or {"text_to_image": "image_to_text_comparison", "image_to_image": "image_to_image_comparison"}
    entries = [
        F.when(
            F.col(f"{c}.textual_analysis").isNotNull(),
            F.struct(
                F.lit(n).alias("key"),
                F.struct(
                    F.col(f"{c}.textual_analysis").alias("textual_analysis"),
                    F.coalesce(f"{c}.scores", F.create_map().cast("map<string,double>")).alias("scores"),
                ).alias("value"),
            ),
        )
        for n, c in names.items()
    ]
    return df.withColumn("comparisons", F.map_from_entries(F.array_compact(F.array(*entries))))


def filter_statements(c: Column | str, min_len: int = 5) -> Column:
    """Parsed list or {positive, negative} object -> clean lists; any other shape -> empty lists."""
    raw = column(c)
    listed = F.from_json(raw, "array<string>")
    named = F.from_json(raw, "positive array<string>, negative array<string>")
    keys = F.json_object_keys(raw)
    whole = F.array_contains(keys, "positive") & F.array_contains(keys, "negative")

    def clean(items: Column) -> Column:
        return F.coalesce(F.filter(items, lambda s: s.isNotNull() & (F.length(s) > min_len)), F.array().cast("array<string>"))

    is_list = F.ltrim(raw).startswith("[")
    return F.struct(
        clean(F.when(is_list, listed).when(whole, named["positive"])).alias("positive"),
        clean(F.when(~is_list & whole, named["negative"])).alias("negative"),
    )

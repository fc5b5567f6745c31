"""Token-id sequences as arrays: prompt masks, truncation, markers and placeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.constants import IGNORE_ID
from evalloom.functions.binding import bind
from evalloom.functions.seeded import column


def ids(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def repeated(value: int | Column, n: Column) -> Column:
    return F.array_repeat(F.lit(value) if isinstance(value, int) else value, n)


def mask_prompt(prompt_ids: Column | str, target_ids: Column | str) -> Column:
    """struct(input_ids, labels, n_prompt, n_target); prompt labels are ignored."""
    p, t = column(prompt_ids), column(target_ids)
    return F.struct(
        F.concat(p, t).alias("input_ids"),
        F.concat(repeated(IGNORE_ID, F.size(p)), t).alias("labels"),
        F.size(p).alias("n_prompt"),
        F.size(t).alias("n_target"),
    )


def truncate(arr: Column | str, n: int, side: str = "right") -> Column:
    """``right`` keeps the first ``n`` ids, ``left`` the last ``n``."""
    a = column(arr)
    if side == "right":
        return F.slice(a, 1, n)
    if side == "left":
        return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n))
    raise ValueError(f"unknown side {side!r}")


def marker_end(arr: Column | str, marker: Sequence[int]) -> Column:
    """Number of ids up to the end of the first occurrence of ``marker``; NULL when absent."""
    m = len(marker)

    def end(a: Column) -> Column:
        starts = F.filter(
            F.transform(a, lambda v, i: F.when((v == marker[0]) & (F.slice(a, i + 1, F.lit(m)) == ids(marker)), i)), lambda i: i.isNotNull()
        )
        return F.get(starts, F.lit(0)) + m

    return bind(column(arr), end)


def mask_before_marker(labels: Column | str, marker: Sequence[int], strict: bool = True) -> Column:
    """Ignore everything up to and including the first occurrence of a marker sub-sequence."""
    a = column(labels)
    absent = F.raise_error(F.lit("marker not found")).cast("array<int>") if strict else F.lit(None).cast("array<int>")

    def masked(end: Column) -> Column:
        kept = F.slice(a, end + 1, F.greatest(F.size(a) - end, F.lit(0)))
        return F.when(end.isNotNull(), F.concat(repeated(IGNORE_ID, end), kept)).otherwise(absent)

    return bind(marker_end(a, marker), masked)


def swap_terminator(arr: Column | str, refuse: Column | str, end: int, other: int) -> Column:
    """Rows that are not refusals end in ``other`` instead of the end id."""
    a = column(arr)
    swapped = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), ids([other]))
    checked = F.when(F.try_element_at(a, F.lit(-1)) == end, F.when(column(refuse), a).otherwise(swapped))
    return F.coalesce(checked, F.raise_error(F.lit("last id is not the end id")).cast("array<int>"))


def expand_placeholder(arr: Column | str, placeholder: int, token: int, n: int, begin: int | None = None, end: int | None = None, keep: bool = False) -> Column:
    """struct(input_ids, n_images): placeholder -> [placeholder] begin + n x token + end."""
    block = ([placeholder] if keep else []) + ([begin] if begin is not None else []) + [token] * n + ([end] if end is not None else [])
    a = column(arr)
    expanded = F.flatten(F.transform(a, lambda v: F.when(v == placeholder, ids(block)).otherwise(F.array(v))))
    return F.struct(expanded.alias("input_ids"), F.size(F.filter(a, lambda v: v == placeholder)).alias("n_images"))

"""Splits that keep the share of every label and of every pair of labels."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.positions import index_by_key

BEYOND = 400  # weight of a squared distance beyond one row
TURNS, WORK = 20_000, 400_000_000  # of the search for quotas where descent ends beyond one row: turns, and sums looked at


def _distance_cost(distance: np.ndarray, den: int) -> np.ndarray:
    beyond = np.maximum(np.abs(distance) - den, 0)
    return distance * distance + BEYOND * beyond * beyond


def _searched(of: np.ndarray, off: np.ndarray, quotas: np.ndarray, counts: np.ndarray, den: int) -> np.ndarray:
    """Quotas that bring every sum within one row of its share, by a tabu search from where descent ended; the nearest found if none do.

    Each turn moves the cell that costs least one row up or down, also uphill, and lets it rest for some turns. Quotas
    may leave the two roundings of their share, but not 0..count. Draws are fixed, so a repeated task finds the same.
    """
    rng, off, quotas = np.random.default_rng(0), off.copy(), quotas.copy()
    rest = np.zeros(len(counts), np.int64)
    beyond = lambda: int((np.maximum(np.abs(off) - den, 0) ** 2).sum())
    best, least = quotas.copy(), beyond()
    never = np.iinfo(np.int64).max
    for turn in range(min(TURNS, WORK // of.size)):
        if not least:
            break
        now = off[of]
        before = _distance_cost(now, den).sum(axis=1)
        moves = []
        for way, can in ((1, quotas < counts), (-1, quotas > 0)):
            gain = _distance_cost(now + way * den, den).sum(axis=1) - before
            moves.append(np.where(can & (rest <= turn), gain, never))
        cell = int(np.argmin(np.minimum(*moves)))
        if min(m[cell] for m in moves) == never:  # all rest
            continue
        way = 1 if moves[0][cell] <= moves[1][cell] else -1
        quotas[cell] += way
        off[of[cell]] += way * den
        rest[cell] = turn + 3 + int(rng.integers(1 + min(20, len(counts) // 4)))
        if (found := beyond()) < least:
            best, least = quotas.copy(), found
    return best


def rounded_quotas(codes: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whole quotas of cells whose sums over each label and each pair of labels stay within one of ``num / den`` of their rows, where that can be.

    ``codes`` has a column of label numbers per label, ``counts`` the rows of each cell. A quota is its share
    rounded down or up at first. Rounding by running totals is where it starts; then cells change sides as long as the squared
    distances of all sums from their shares fall, what lies beyond one row weighing most: single cells, then pairs. If a
    sum still lies beyond one row, a search goes on from there. All in whole numbers, distances being counted in units
    of 1 / den rows.
    """
    floor, part = counts * num // den, counts * num % den
    margins = [np.zeros(len(counts), np.int64)]
    for size in (1, 2):
        for chosen in combinations(range(codes.shape[1]), size):
            margins.append(np.unique(codes[:, list(chosen)], axis=0, return_inverse=True)[1].reshape(-1))
    starts = np.cumsum([0, *[m.max(initial=-1) + 1 for m in margins]])
    of = np.stack([m + s for m, s in zip(margins, starts)], axis=1)  # the sums that a cell is part of
    running = np.cumsum(part) + den // 2
    up = running // den - (running - part) // den
    off = np.zeros(starts[-1], np.int64)
    np.add.at(off, of.reshape(-1), np.repeat(up * den - part, of.shape[1]))
    free = part > 0

    def cost(distance: np.ndarray) -> np.ndarray:
        return _distance_cost(distance, den)

    def change(cell: int) -> int:
        before = int(cost(off[of[cell]]).sum())
        off[of[cell]] += (1 - 2 * up[cell]) * den
        up[cell] = 1 - up[cell]
        return int(cost(off[of[cell]]).sum()) - before

    def gains() -> np.ndarray:
        now = off[of]
        gain = (cost(now + ((1 - 2 * up) * den)[:, None]) - cost(now)).sum(axis=1)
        return np.where(free, gain, np.iinfo(np.int64).max)

    while free.any():
        gain = gains()
        best = int(np.argmin(gain))
        if gain[best] < 0:
            change(best)
            continue
        better = False
        for cell in np.argsort(gain, kind="stable")[:64]:
            if not free[cell]:
                break
            first = change(int(cell))
            second = gains()
            second[cell] = np.iinfo(np.int64).max
            partner = int(np.argmin(second))
            if second[partner] < np.iinfo(np.int64).max and first + int(second[partner]) < 0:
                change(partner)
                better = True
                break
            change(int(cell))
        if not better:
            break
    return _searched(of, off, floor + up, counts, den)


def stratified_split_pairs(df: DataFrame, labels: Sequence[str], fraction: float | str, seed: int | str, key: str, name: str = "split") -> DataFrame:
    """``test`` gets ``fraction`` of the rows of every label and of every pair of labels, each to within one row where that can be.

    Rows are counted per combination of labels; quotas of the combinations come from ``rounded_quotas``, and the
    first rows in seeded order fill them. Counts are one row per combination that occurs, so what one task holds grows
    with the vocabulary and not with the rows; a combination that many rows share is numbered by hash buckets. NULL is a
    label like any other. ``key`` identifies a row.
    """
    share = Fraction(str(fraction)).limit_denominator(10_000)
    num, den, width = share.numerator, share.denominator, len(labels)
    kinds = [df.schema[c].dataType for c in labels]
    cells = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("_n"))
    schema = T.StructType([*[T.StructField(f"_c{k}", t) for k, t in enumerate(kinds)], T.StructField("_cell", T.LongType()), T.StructField("_quota", T.LongType())])

    def quotas(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        codes = np.stack([_numbers(table.column(k)) for k in range(width)], axis=1)
        found = rounded_quotas(codes, table.column(width).to_numpy(), num, den)
        yield from pa.Table.from_arrays([*table.columns[:width], pa.array(np.arange(len(found))), pa.array(found)], names=schema.names).to_batches()

    ordered = cells.repartition(1).sortWithinPartitions(*labels)
    table = ordered.mapInArrow(quotas, schema)
    same = [df[c].eqNullSafe(table[f"_c{k}"]) for k, c in enumerate(labels)]
    placed = df.join(table, reduce(lambda a, b: a & b, same)).select(*df.columns, "_cell", "_quota")
    numbered = index_by_key(placed, seed, key, "_pos", digits=2, within="_cell")
    return numbered.withColumn(name, F.when(F.col("_pos") < F.col("_quota"), "test").otherwise("train")).select(*df.columns, name)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A number per distinct value; NULL has one of its own."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

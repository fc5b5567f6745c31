"""Seeded choices that depend on the seed and on key columns only.

Nothing here looks at partitions, row order or task attempts, so a lost
executor or another cluster size cannot change a draw.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.binding import bind

PRIME = 2147483647  # 2^31 - 1: products of two remainders fit into 64 bits
ROUNDS = 6
WALK = 20


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_key(seed: int | str, *cols: Column | str) -> Column:
    """32 hex digits from the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[column(c).cast("string") for c in cols]))


def seeded_int(seed: int | str, *cols: Column | str) -> Column:
    """Integer in [0, 2^32)."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 8), 16, 10).cast("long")


def shuffle_array(arr: Column | str, seed: int | str, *keys: Column | str) -> Column:
    """Permute an array inside its row."""
    # the key's common part is made once per row; sort_array compares in compiled code, array_sort by an interpreted function
    common = F.concat_ws("|", F.lit(str(seed)), *[column(c).cast("string") for c in keys])
    tagged = bind(common, lambda p: F.transform(column(arr), lambda v: F.struct(F.md5(F.concat_ws("|", p, v.cast("string"))).alias("k"), v.alias("v"))))
    return F.transform(F.sort_array(tagged), lambda s: s["v"])


def pick_one(arr: Column | str, seed: int | str, *keys: Column | str) -> Column:
    """One element of an array per row; NULL for an empty array."""
    a = column(arr)
    n = F.size(a)
    slot = F.pmod(seeded_int(seed, *keys), F.greatest(n, F.lit(1))) + 1
    return F.when(n > 0, F.try_element_at(a, slot.cast("int")))


def keyed_bernoulli(p: float, seed: int | str, *keys: Column | str) -> Column:
    """True with probability ``p``."""
    return seeded_int(seed, *keys) / F.lit(float(2**32)) < F.lit(float(p))


def round_keys(seed: int | str) -> list[int]:
    """One number per round; the last bit tells which half a round changes."""
    digits = [hashlib.md5(f"{seed}|{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [int(d[:7], 16) * 2 + r % 2 for r, d in enumerate(digits)]


def whole(x: Column, y: Column) -> Column:
    """Whole-number division of numbers that aren't negative, exact in all 64 bits."""
    return F.call_function("div", x, y)


def permuted(place: Column | str, n: Column | int, seed: int | str, tweak: Column | int = 0) -> Column:
    """Where ``place`` goes in a pseudo-random order of 0..n-1; each seed and each ``tweak`` (a whole number, not negative) is an order of its own.

    A bijection computed per row, so no order of n numbers is ever held: Feistel rounds on the halves x and y of
    place = x + a y, a being just above the root of n and b the least that covers n. A result beyond n is
    permuted again. Fewer than a places lie beyond, so a walk is hardly ever longer than two steps; none is
    longer than WALK below n = WALK^2, and one that were would be an error, not a wrong place.
    """
    number = lambda c: column(c).cast("long") if not isinstance(c, int) else F.lit(c).cast("long")
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def one(z: Column, s: Column) -> Column:
        def changed(state: Column, k: Column) -> Column:
            x, y, even = F.pmod(state, s.a), whole(state, s.a), F.pmod(k, F.lit(2)) == 0
            mixed = bind(F.pmod(F.when(even, y).otherwise(x) + k + s.t, F.lit(PRIME)), lambda h: F.pmod(h * h + 48271 * h, F.lit(PRIME)))
            return F.when(even, F.pmod(x + mixed, s.a) + s.a * y).otherwise(x + s.a * F.pmod(y + mixed, s.b))

        return F.aggregate(keys, z, lambda z, k: bind(z, lambda state: changed(state, k)))

    def walk(s: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(WALK))
        return F.aggregate(steps, one(s.z, s), lambda z, _: F.when(z < s.n, z).otherwise(one(z, s)))

    a = F.floor(F.sqrt(number(n).cast("double"))).cast("long") + 1
    sized = F.struct(number(place).alias("z"), number(n).alias("n"), a.alias("a"), F.pmod(F.pmod(number(tweak), F.lit(PRIME)) * 1103515245 + 12345, F.lit(PRIME)).alias("t"))
    with_b = lambda s: F.struct(s.z.alias("z"), s.n.alias("n"), s.a.alias("a"), whole(s.n + s.a - 1, s.a).alias("b"), s.t.alias("t"))
    found = bind(sized, lambda s: bind(with_b(s), lambda t: F.struct(walk(t).alias("z"), t.n.alias("n"))))
    return F.when(found.z < found.n, found.z).otherwise(F.raise_error(F.lit("no place found in a permutation")))


def with_permuted(df: DataFrame, name: str, place: str, n: int, seed: int | str, tweak: str, turns: int = 2) -> DataFrame:
    """``df`` with ``permuted(place, n, seed, tweak)`` as column ``name``, for a fixed ``n``.

    The rounds are projections on plain numbers, which Spark compiles; the first ``turns`` permutations of a walk are made
    so, and the few rows that are still beyond n go on with ``permuted``.
    """
    a = math.isqrt(n) + 1
    b = -(-n // a)
    out = df.withColumn("_t", F.pmod(F.pmod(column(tweak).cast("long"), F.lit(PRIME)) * 1103515245 + 12345, F.lit(PRIME))).withColumn("_z", column(place).cast("long"))
    for turn in range(turns):
        out = out.withColumns({"_x": F.pmod("_z", F.lit(a)), "_y": whole(F.col("_z"), F.lit(a))})
        for k in round_keys(seed):
            kept, changed, size = ("_y", "_x", a) if k % 2 == 0 else ("_x", "_y", b)
            out = out.withColumn("_h", F.pmod(F.col(kept) + F.lit(k) + F.col("_t"), F.lit(PRIME)))
            mixed = F.pmod(F.col("_h") * F.col("_h") + 48271 * F.col("_h"), F.lit(PRIME))
            out = out.withColumn(changed, F.pmod(F.col(changed) + mixed, F.lit(size)))
        next_ = F.col("_x") + a * F.col("_y")
        out = out.withColumn("_z", F.when(F.col("_z") < n, F.col("_z")).otherwise(next_) if turn else next_)
    # a later filter on the result stops at a generator; pushed through the rounds it would grow by a power of them
    out = out.withColumnRenamed("_z", "_w").select("*", F.explode(F.array("_w")).alias("_z"))
    return out.withColumn(name, F.when(F.col("_z") < n, F.col("_z")).otherwise(permuted("_z", n, seed, tweak))).drop("_t", "_x", "_y", "_h", "_w", "_z")

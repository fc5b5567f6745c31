"""Text scores under a hierarchical Pitman-Yor model of words after words, words and letters.

A token is drawn by restaurants that share parents:

* the word, in the restaurant of the word before it (its context; the end token stands before a text), whose customers are
  the training tokens;
* a word that opens a table there is drawn again from the parent of that context, where words before with one ending (last two
  bytes) are alike: first its ending, in the restaurant of the ending before it, whose parent is the restaurant of all endings;
* then the word, in the restaurant of its ending;
* a word that opens a table there is spelt backwards from the ending: every further letter, and an end
  mark, is drawn in the restaurant of the letters spelt before (at most ``DEPTH``), whose parent is the
  restaurant of that context without its first letter, down to a root where all bytes are equal.

So the probabilities of all words after any word sum to one. A text is its words and one end token. The strength of contexts
of words is the likeliest for their tables, discounts of words come from how many occur once and twice.

Seating is sampled by Gibbs. What a table count depends on, given everything else, is known in closed
form (generalised Stirling numbers), so a sweep draws the number of tables of each (restaurant, dish)
afresh; the tables then are the customers of the parent. Predictive probabilities are averaged over the
draws of the last round, those of letters over the sweeps after burn-in.

Texts are held in chunks. Words meet once by their hash, are counted and numbered; chunks get the numbers of theirs and
send their distinct pairs once to cells, by the numbers of both words, where they are counted. All rounds run on the distinct
pairs of the cells and, as the others have one table for good, draw those that occur twice only. In each round words are told
what the cells seated, and cells get back the figures of their words. At the end cells score their pairs and send each chunk the
scores of its own, in steps of 2^-28. No restaurant is gathered: draws need the totals of its word before only. Draws are keyed by
word and pair, so chunks and partitions don't show. Letter restaurants are dealt to tasks by the last two letters of their
context; what tasks share of them is bounded by the 65,536 pairs of letters. Words are dealt by 64-bit hashes and told apart by
their letters once they meet; in a chunk they are told apart by those hashes.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.arrays import BASE, INVERSE, SPACED, Words, flat, mix, ranges, span_hash, sums, text_chunks
from evalloom.llm.store import removed, written

DEPTH = 5
LETTER_DISCOUNT, STRENGTH = 0.5, 1.0
SWEEPS, BURN_IN = 6, 2
ROUNDS = 2
PARTS = 61  # groups of letter contexts, by their last two letters
ENDING_PARTS = 64  # groups of endings, as the ending before
EXACT = 64  # customers of a dish whose tables are drawn in closed form; further ones are seated in growing blocks
DRAWS = SWEEPS - BURN_IN  # of the tables of words, in each round
PIECE = 64
BLOCK = 1 << 17  # pairs of a cell that are scored at once
WAVES = 2  # in which chunks and cells meet, where much is shuffled
BUCKET_TOKENS = 2_000_000
ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 4}
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_CELLS = 4_000_000  # 64 MB of letter model; a larger one stays in its parts
GROUP_WORDS = 50_000  # that ask the parts of a larger model together
START, END, LAST = 0x20, 0x0A, b"\r"  # bytes that no word holds: start and end of a word, the token that ends a text


# ------------------------------------------------------------------ seating
def log_stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t up to ``n``."""
    out = np.full((n + 1, n + 2), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, n + 1)
    for c in range(n):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - discount * t, 0)) + out[c, 1:-1]
        out[c + 1, 1:-1] = np.logaddexp(out[c, :-2], stay)
    return out[:, :-1]


class Keyed:
    """Draws that depend on a dish's own key and the seed, not on the rows that a task happens to hold with it."""

    def __init__(self, keys: np.ndarray, seed: int):
        self.keys = mix(keys + np.uint64(seed * int(BASE) % (1 << 64)))

    def _at(self, at: np.ndarray, step: int) -> np.ndarray:
        return mix(self.keys[at] + np.uint64(step * int(BASE) % (1 << 64)))

    def uniform(self, at: np.ndarray, step: int) -> np.ndarray:
        return (self._at(at, step) >> np.uint64(11)) * 2.0**-53

    def binomial(self, at: np.ndarray, step: int, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """By inversion, in pieces that each expect at most ``PIECE`` hits (or misses, if those are fewer)."""
        rare = np.minimum(p, 1 - p)
        pieces = np.maximum(np.ceil(n * rare / PIECE), 1).astype(np.int64)
        row, piece = np.repeat(np.arange(len(n)), pieces), ranges(np.zeros(len(n), np.int64), pieces)
        size = n[row] // pieces[row] + (piece < n[row] % pieces[row])
        left = (mix(self._at(at, step)[row] + (piece + 1).astype(np.uint64) * INVERSE) >> np.uint64(11)) * 2.0**-53
        chance, hits = np.exp(size * np.log1p(-rare[row])), np.zeros(len(row), np.int64)
        odds, todo, k = rare[row] / (1 - rare[row]), np.arange(len(row)), 0
        while (todo := todo[(left[todo] >= chance[todo]) & (size[todo] > k)]).size:
            left[todo] -= chance[todo]
            chance[todo] *= (size[todo] - k) / (k + 1) * odds[todo]
            k += 1
            hits[todo] = k
        found = np.bincount(row, hits, len(n)).astype(np.int64)
        return np.where(p > 0.5, n - found, found)


class Streamed:
    """Draws of one stream, for dishes that stand in a fixed order."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def uniform(self, at: np.ndarray, step: int) -> np.ndarray:
        return self.rng.random(len(at))

    def binomial(self, at: np.ndarray, step: int, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self.rng.binomial(n, p)


def draw_repeatedly(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rngs: list[Streamed | Keyed], stirling: np.ndarray) -> list[np.ndarray]:
    """Tables of each dish, once for each of ``rngs``, given its customers, the strength of its restaurant without it
    (strength + discount * other tables) and the dish's probability in the parent."""
    out = [np.minimum(customers, 1).astype(np.int64) for _ in rngs]
    first = np.minimum(customers, EXACT)
    low = 1
    for high in (4, 16, EXACT):
        todo = np.flatnonzero((first > low) & (first <= high))
        for at in np.array_split(todo, -(-len(todo) // 20_000) or 1):
            steps = np.log(others[at, None] + discount * np.arange(high)) + np.log(parent[at, None])
            weight = stirling[first[at], 1 : high + 1] + np.cumsum(steps, axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            for draws, tables in zip(rngs, out, strict=True):
                tables[at] = 1 + (weight < draws.uniform(at, high)[:, None] * weight[:, -1:]).sum(axis=1)
        low = high
    for draws, tables in zip(rngs, out, strict=True):
        seated = EXACT
        while (more := np.flatnonzero(customers > seated)).size:
            new = (others[more] + discount * tables[more]) * parent[more]
            block = np.minimum(customers[more], 2 * seated) - seated
            tables[more] += draws.binomial(more, seated, block, new / (seated - discount * tables[more] + new))
            seated *= 2
    return out


def draw_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator | Keyed, stirling: np.ndarray) -> np.ndarray:
    """One draw of ``draw_repeatedly``."""
    return draw_repeatedly(customers, others, parent, discount, [rng if isinstance(rng, Keyed) else Streamed(rng)], stirling)[0]


class Level:
    """Restaurants of one context length: cells (context, letter) in order of their key."""

    def __init__(self, keys: np.ndarray, direct: np.ndarray):
        self.keys, back = np.unique(keys, return_inverse=True)
        self.direct = np.bincount(back, direct, len(self.keys)).astype(np.int64)
        self.contexts, self.context = np.unique(self.keys >> 8, return_inverse=True)
        self.tables = np.ones(len(self.keys), np.int64)
        self.above = np.zeros(len(self.keys), np.int64)  # cell of the parent level
        self.seen, self.back = np.zeros(len(self.keys)), np.zeros(len(self.contexts))

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, len(self.contexts))

    def draw(self, customers: np.ndarray, parent: np.ndarray, rng, stirling) -> None:
        self.customers = customers
        others = STRENGTH + LETTER_DISCOUNT * (self.total(self.tables)[self.context] - self.tables)
        self.tables = draw_tables(customers, others, parent, LETTER_DISCOUNT, rng, stirling)

    def predict(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each cell, and what each context leaves to its parent."""
        size = STRENGTH + self.total(self.customers)
        left = (STRENGTH + LETTER_DISCOUNT * self.total(self.tables)) / size
        return (self.customers - LETTER_DISCOUNT * self.tables) / size[self.context] + left[self.context] * parent, left


def parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same letters in the contexts without their first letter."""
    return (keys & ((1 << 8 * depth) - 1)) | (depth - 1) << 56


def seat(keys: np.ndarray, direct: np.ndarray, shared: np.ndarray, seed: int, lowest: int = 2) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels from ``DEPTH`` down to ``lowest`` after all sweeps, and the tables of the lowest one by parent key.

    ``shared`` holds the parent's probabilities by parent key modulo 65,536.
    """
    rng, stirling = np.random.default_rng(seed), log_stirling(LETTER_DISCOUNT)
    depth, levels = keys >> 56, []
    for k in range(DEPTH, lowest - 1, -1):
        own = depth == k
        below = parents(levels[-1].keys, k + 1) if levels else keys[:0]
        level = Level(np.concatenate([keys[own], below]), np.concatenate([direct[own], np.zeros(len(below), np.int64)]))
        if levels:
            levels[-1].above = np.searchsorted(level.keys, below)
        levels.append(level)
    top = parents(levels[-1].keys, lowest) & 0xFFFF
    guess = [shared[parents(x.keys, lowest) & 0xFFFF] for x in levels]
    for sweep in range(SWEEPS):
        for j, level in enumerate(levels):
            customers = level.direct.copy()
            if j:
                np.add.at(customers, levels[j - 1].above, levels[j - 1].tables)
            level.draw(customers, shared[top] if j == len(levels) - 1 else guess[j + 1][level.above], rng, stirling)
        for j in range(len(levels) - 1, -1, -1):
            level = levels[j]
            guess[j], left = level.predict(shared[top] if j == len(levels) - 1 else guess[j + 1][level.above])
            if sweep >= BURN_IN:
                level.seen += guess[j] / (SWEEPS - BURN_IN)
                level.back += left / (SWEEPS - BURN_IN)
    return levels, parents(levels[-1].keys, lowest), levels[-1].tables


# ------------------------------------------------------------------ letters of words
def endings(words: pa.Array) -> np.ndarray:
    """The last two bytes of each word as a number; a word of one byte is its own ending."""
    data, offsets = flat(words.cast(pa.large_string()))
    last, n = offsets[1:] - 1, np.diff(offsets)
    if not len(data):
        return np.zeros(len(n), np.int64)
    return np.where(n > 0, data[last], 0).astype(np.int64) | np.where(n > 1, data[last - 1].astype(np.int64) << 8, 0)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every letter of every word that its ending leaves open, from the back and with the end mark: the word,
    the depth of its context, and its key at each depth (0 and up)."""
    data, offsets = flat(words.cast(pa.large_string()))
    n = np.diff(offsets)
    text = np.full(len(data) + 2 * len(n), START, np.int64)  # start, letters from the last to the first, end
    first = offsets[:-1] + 2 * np.arange(len(n))
    text[np.repeat(first + n, n) - ranges(np.zeros(len(n), np.int64), n)] = data
    text[first + n + 1] = END
    open_ = np.where(n > 1, n - 1, 0)
    word = np.repeat(np.arange(len(n)), open_)
    at = ranges(first + 3, open_)
    depth = np.minimum(at - first[word], DEPTH)
    keys, context = [text[at]], np.zeros(len(at), np.int64)
    for k in range(1, DEPTH + 1):
        context = context | text[np.maximum(at - k, 0)] << 8 * (k - 1)
        keys.append(k << 56 | context << 8 | text[at])
    return word, depth, keys


def _cells(batches):
    """(key, n): customers of the deepest restaurants, summed per batch."""
    for batch in batches:
        tables = batch.column(1).to_numpy()
        word, depth, keys = spelled(batch.column(0))
        key, back = np.unique(np.choose(depth, keys), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(back, tables[word], len(key)).astype(np.int64))], names=["key", "n"])


def _seated(shared: np.ndarray, seed: int):
    def seated(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")  # rows arrive in any order
        keys, direct = group.column("key").to_numpy(), group.column("n").to_numpy()
        levels, up, tables = seat(keys, direct, shared, seed + int(keys[0] >> 8 & 0xFFFF))
        key = np.concatenate([*(x.keys for x in levels), *(x.contexts for x in levels), up])
        value = np.concatenate([*(x.seen for x in levels), *(x.back for x in levels), tables])
        sizes = [sum(len(x.keys) for x in levels), sum(len(x.contexts) for x in levels), len(up)]
        return pa.table({"kind": pa.array(np.repeat(np.arange(3), sizes), pa.int32()), "key": key, "value": value})

    return seated


class Endings:
    """The restaurant of all endings: probabilities of all 65,536."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray, seed: int):
        self.each = np.full(1 << 16, 1 / (1 << 16))
        if not len(keys):
            return
        rng, stirling = np.random.default_rng(seed), log_stirling(LETTER_DISCOUNT)
        root, even = Level(keys, customers), np.full(len(keys), 1 / (1 << 16))
        each = np.zeros(1 << 16)
        for sweep in range(SWEEPS):
            root.draw(root.direct, even, rng, stirling)
            guess, left = root.predict(even)
            if sweep >= BURN_IN:
                each += left[0] / (1 << 16) / (SWEEPS - BURN_IN)
                each[root.keys] += (guess - left[0] / (1 << 16)) / (SWEEPS - BURN_IN)
        self.each = each


class Shared:
    """Letter restaurants of one letter and of none, at most 65,536 and 256 cells: probabilities over all bytes."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray, seed: int):
        self.pairs = np.full(1 << 16, 1 / 256)
        self.letters = np.full(256, 1 / 256)
        if not len(keys):
            return
        rng, stirling = np.random.default_rng(seed), log_stirling(LETTER_DISCOUNT)
        one = Level(keys, customers)
        root = Level(one.keys & 255, np.zeros(len(one.keys), np.int64))
        letter = np.searchsorted(root.keys, one.keys & 255)
        pairs, letters = np.zeros((256, 256)), np.zeros(256)
        guess = np.full(len(root.keys), 1 / 256)
        for sweep in range(SWEEPS):
            one.draw(one.direct, guess[letter], rng, stirling)
            root.draw(np.bincount(letter, one.tables, len(root.keys)).astype(np.int64), np.full(len(root.keys), 1 / 256), rng, stirling)
            guess, left = root.predict(np.full(len(root.keys), 1 / 256))
            every = np.full(256, left[0] / 256)
            every[root.keys] = guess
            seen, left = one.predict(guess[letter])
            table = np.tile(every, (256, 1))
            table[one.contexts & 255] *= left[:, None]
            table[(one.keys >> 8) & 255, one.keys & 255] = seen
            if sweep >= BURN_IN:
                pairs += table / (SWEEPS - BURN_IN)
                letters += every / (SWEEPS - BURN_IN)
        self.pairs, self.letters = pairs.reshape(-1), letters


def letter_scores(letters: np.ndarray, cells: np.ndarray, seen: np.ndarray, contexts: np.ndarray, back: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """log10 probability of each letter, given by its deepest key: from the longest known cell, times what each longer context leaves."""
    keys, score, open_ = letters.copy(), np.zeros(len(letters)), np.arange(len(letters))
    for k in range(DEPTH, 1, -1):
        deep = keys[open_] >> 56 >= k
        due, later = open_[deep], open_[~deep]
        at = np.minimum(np.searchsorted(cells, keys[due]), max(len(cells) - 1, 0))
        hit = cells[at] == keys[due] if len(cells) else np.zeros(len(due), bool)
        score[due[hit]] += np.log10(seen[at[hit]])
        missed = due[~hit]
        known = np.minimum(np.searchsorted(contexts, keys[missed] >> 8), max(len(contexts) - 1, 0))
        held = contexts[known] == keys[missed] >> 8 if len(contexts) else np.zeros(len(missed), bool)
        score[missed[held]] += np.log10(back[known[held]])
        keys[missed] = parents(keys[missed], k)
        open_ = np.sort(np.concatenate([later, missed]))
    score[open_] += np.log10(shared[keys[open_] & 0xFFFF])
    return score


def distinct_letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct letters of words that their endings leave open, as deepest keys, by the part of the model that has their
    contexts of all lengths; those parts; and for each letter of the words its word and its place among the distinct ones."""
    word, depth, keys = spelled(words)
    letters, back = np.unique(np.choose(depth, keys), return_inverse=True)
    part = (letters >> 8 & 0xFFFF) % PARTS
    order, place = np.argsort(part, kind="stable"), np.empty(len(letters), np.int64)
    place[order] = np.arange(len(letters))
    return letters[order], part[order], word, place[back]


def spelling_scores(words: pa.Array, *model: np.ndarray) -> np.ndarray:
    """log10 probability of each word's spelling."""
    letters, _, word, place = distinct_letters(words)
    return np.bincount(word, letter_scores(letters, *model)[place], len(words)).astype(float)  # whole numbers if there is no letter


# ------------------------------------------------------------------ the models in Spark
def _ending_pairs(shared: np.ndarray, seed: int):
    def seated(group: pa.Table) -> pa.Table:
        """(pair, score) of the restaurants of a task's endings; kind 1 is what an ending leaves to its parent, kind 2 its tables by dish."""
        group = group.sort_by("pair")
        pairs, n = group.column("pair").to_numpy(), group.column("n").to_numpy()
        rng, stirling = np.random.default_rng([seed, int(pairs.min())]), log_stirling(LETTER_DISCOUNT)
        level = Level(pairs & 0xFFFF | (pairs >> 16) << 16, n)
        level.contexts, level.context = np.unique(level.keys >> 16, return_inverse=True)
        level.back = np.zeros(len(level.contexts))
        parent = shared[level.keys & 0xFFFF]
        for sweep in range(SWEEPS):
            level.draw(level.direct, parent, rng, stirling)
            guess, left = level.predict(parent)
            if sweep >= BURN_IN:
                level.seen += guess / (SWEEPS - BURN_IN)
                level.back += left / (SWEEPS - BURN_IN)
        dish, back = np.unique(level.keys & 0xFFFF, return_inverse=True)
        tables = np.bincount(back, level.tables, len(dish))
        sizes = [len(level.keys), len(level.contexts), len(dish)]
        return pa.table({"kind": pa.array(np.repeat(np.arange(3), sizes), pa.int32()), "key": np.concatenate([level.keys, level.contexts, dish]), "value": np.concatenate([level.seen, level.back, tables])})

    return seated


def ending_model(pairs: DataFrame, seed: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """From (pair, n): (pair, probability) of pairs that occur, what each ending leaves to the parent, and the parent's probabilities."""
    dish, context = F.expr("pair & 65535").alias("key"), F.expr(f"(pair >> 16) % {ENDING_PARTS}")
    guessed = sorted(pairs.where("n > 0").groupBy(dish).agg(F.count("*").alias("n")).collect())
    for k in range(ROUNDS):
        shared = Endings(*(np.array([r[i] for r in guessed], np.int64) for i in (0, 1)), seed + k)
        if k:
            removed(seated)
        seated = written(pairs.where("n > 0").groupBy(context.alias("part")).applyInArrow(_ending_pairs(shared.each, seed + k), "kind int, key long, value double"))
        guessed = seated.where("kind = 2").groupBy("key").agg(F.sum("value").cast("long").alias("n")).collect()
        guessed.sort()
    left = np.ones(1 << 16)
    for row in seated.where("kind = 1").collect():  # one row per ending
        left[row.key] = row.value
    return seated.where("kind = 0").select(F.col("key").alias("pair"), F.col("value").alias("seen")), left, shared.each


def letter_model(vocabulary: DataFrame, previous: DataFrame | None, seed: int) -> tuple[DataFrame, np.ndarray]:
    """((kind, key, value) of cells (0), contexts (1) and tables of the shared restaurants (2), probabilities under one
    letter of context) from (word, tables). ``previous`` is what an earlier round returned."""
    counted = vocabulary.where("tables > 0").select("word", "tables").mapInArrow(_cells, "key long, n long")
    cells = written(counted.groupBy("key").agg(F.sum("n").alias("n")))
    if previous is None:  # a first guess takes every cell as one customer of the shared restaurants
        guessed = cells.groupBy(F.expr("(key & 65535) | (1L << 56)").alias("pair")).agg(F.count("*").alias("n"))
    else:
        guessed = previous.where("kind = 2").groupBy(F.col("key").alias("pair")).agg(F.sum("value").cast("long").alias("n"))
    guessed = guessed.orderBy("pair").collect()  # at most 65,536 rows
    shared = Shared(*(np.array([r[i] for r in guessed], np.int64) for i in (0, 1)), seed)
    model = written(cells.groupBy(F.expr(f"(key >> 8 & 65535) % {PARTS}").alias("part")).applyInArrow(_seated(shared.pairs, seed), "kind int, key long, value double"))
    removed(cells)
    return model, shared.pairs


def _model_arrays(model: pa.Table) -> list[np.ndarray]:
    """Rising keys and values of the cells, then of the contexts."""
    kind, key, value = (model.column(c).to_numpy() for c in ("kind", "key", "value"))
    out = []
    for k in (0, 1):
        order = np.argsort(key[kind == k])
        out += [key[kind == k][order], value[kind == k][order]]
    return out


def _letters_asked(group: tuple, words: pa.Table) -> pa.Table:
    """The distinct letters (a) that the words of a group ask each part of the model for."""
    letters, part, _, _ = distinct_letters(words.column("word").combine_chunks())
    each, letters = _cut(part, letters)
    return pa.table([pa.array(np.full(len(each), group[0].as_py(), np.int32)), pa.array(each.astype(np.int32)), pa.array([packed(steps(x)) for x in letters], pa.binary())], names=["of", "part", "a"])


def _letters_scored(shared: np.ndarray):
    def scored(asked: pa.Table, model: pa.Table) -> pa.Table:
        """For each group of words the scores (a) of the letters that it asks this part for."""
        own, answers = _model_arrays(model), []
        for row in asked.column("a"):  # one list at a time: a part is asked by every group
            answers.append(packed(letter_scores(np.cumsum(unpacked(row.as_py())), *own, shared)))
        return asked.select(["of", "part"]).append_column("a", pa.array(answers, pa.binary()))

    return scored


def _spelt(schema: T.StructType, then):
    names = schema.names

    def spelt(words: pa.Table, answers: pa.Table) -> pa.Table:
        """The words of a group with the sums of their letters' scores."""
        _, _, word, place = distinct_letters(words.column("word").combine_chunks())
        scores = _values(answers.sort_by("part").column("a"), float)[place]
        words = words.append_column("spelling", pa.array(np.bincount(word, scores, len(words)).astype(float))).combine_chunks()
        batches = words.select(names).to_batches()
        return pa.Table.from_batches(then(iter(batches)) if then else batches)

    return spelt


def with_spelling(vocabulary: DataFrame, model: DataFrame, shared: np.ndarray, then=None, further: tuple = ()) -> DataFrame:
    """``vocabulary`` with the log10 probability of each word's spelling. The model is sent to the tasks if it is small; else
    groups of words ask each of its parts once for their distinct letters, and no letter of a word is a row.
    ``then`` adds the fields ``further`` to the batches, in the same Python worker: each worker takes memory."""
    schema = T.StructType([*vocabulary.schema.fields, T.StructField("spelling", T.DoubleType())])
    wider = T.StructType([*schema.fields, *further])
    at = vocabulary.columns.index("word")
    model = model.where("kind < 2")
    if model.count() <= BROADCAST_CELLS:
        sent = vocabulary.sparkSession.sparkContext.broadcast((*_model_arrays(model.toArrow()), shared))

        def score(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelling_scores(batch.column(at), *sent.value))], names=schema.names)

        return vocabulary.mapInArrow(lambda batches: then(score(batches)) if then else score(batches), wider)

    group = F.expr(f"int(pmod(xxhash64(word), {-(-vocabulary.count() // GROUP_WORDS) or 1}))").alias("of")
    part = F.expr(f"int((if(kind = 0, key >> 8, key) & 65535) % {PARTS})").alias("part")
    asked = vocabulary.select("word").groupBy(group).applyInArrow(_letters_asked, "of int, part int, a binary")
    scored = asked.groupBy("part").cogroup(model.groupBy(part)).applyInArrow(_letters_scored(shared), "of int, part int, a binary")
    return vocabulary.groupBy(group).cogroup(scored.groupBy("of")).applyInArrow(_spelt(schema, then), wider)


# ------------------------------------------------------------------ words and the words before them
def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of words as ``Words`` gives them."""
    data, at = flat(words)
    return mix(span_hash(sums(data.astype(np.uint64) + np.uint64(1)), at[:-1], at[1:]) + np.diff(at).astype(np.uint64) * BASE)


def packed(values: np.ndarray) -> bytes:
    """Numbers of eight bytes as planes of bytes, after how many of those there are; upper ones that are all zero are left out."""
    values = np.ascontiguousarray(values).view(np.uint64)
    n, planes = len(values), -(-int(values.max()).bit_length() // 8) if len(values) else 0
    out = np.empty(1 + max(planes, 1) * n, np.uint8)  # one plane at least tells how many numbers there are
    out[0] = max(planes, 1)
    for k in range(out[0]):
        out[1 + k * n : 1 + (k + 1) * n] = values >> np.uint64(8 * k)
    return zstandard.compress(out, 1)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    planes = planes[1:].reshape(planes[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view(kind).reshape(-1)


def _packed_words(letters: np.ndarray, sizes: np.ndarray) -> bytes:
    """Words as the bytes of all of them after their sizes: rows then hold one value, not one for each word."""
    sizes = packed(sizes)
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.compress(np.ascontiguousarray(letters), 1)


def _unpacked_words(data: bytes) -> pa.Array:
    letters = 8 + int.from_bytes(data[:8], "little")
    offsets = np.concatenate([[0], np.cumsum(unpacked(data[8:letters]))])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(zstandard.decompress(data[letters:]))).cast(pa.string())


def _lists(column, kind: type = np.int64) -> list[np.ndarray]:
    return [unpacked(x, kind) for x in column.to_pylist()]


def _values(column, kind: type = np.int64) -> np.ndarray:
    """The numbers of all rows, after one another."""
    return np.concatenate([np.zeros(0, kind), *_lists(column, kind)])


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which pack better; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=0)


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` buckets each hash falls into; ascending for ascending hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _chunked(batches):
    """One row per chunk of texts: ids, flags, tokens per text, the token stream as numbers of distinct words, those words
    by their hashes, with training counts."""
    last = word_hashes(pa.array([LAST.decode()]))
    for batch in text_chunks(batches, "text"):
        words = Words(batch.column(2), SPACED)
        train = ~batch.column(1).to_numpy(zero_copy_only=False)
        data, size = np.append(words.data, np.uint8(LAST[0])), np.append(words.ends - words.starts, 1)
        hashes, code = np.unique(np.append(words.hash, last), return_inverse=True)
        first = np.empty(len(hashes), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        counts = np.bincount(code, np.append(train[words.doc], train.sum()), len(hashes)).astype(np.int64)
        letters = data[ranges(np.append(words.starts, len(words.data))[first], size[first])]
        sizes = np.diff(words.first) + 1
        stream = np.full(sizes.sum(), code[-1], "<u4")
        stream[np.delete(np.arange(len(stream)), np.cumsum(sizes) - 1)] = code[:-1]
        stream = zstandard.compress(np.concatenate([(stream >> 8 * k).astype(np.uint8) for k in range(4)]), 3)  # planes of bytes, the upper ones nearly empty
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch.column(0), batch.column(1))]
        numbers = [pa.array([x]) for x in (_packed_words(letters, size[first]), packed(sizes), packed(counts), stream, int(sizes.sum()))]
        yield pa.RecordBatch.from_arrays([*lists, *numbers], names=CHUNK_COLUMNS)


CHUNK_COLUMNS = ["ids", "held", "words", "sizes", "counts", "stream", "n_tokens"]
#: What chunks, cells of pairs and buckets of words tell each other, in packed lists.
PART = "kind int, chunk long, cell int, bucket int, a binary, b binary, p binary"
KINDS = range(14)
TEXTS, ASKED, MAPPED, COUNTS, PAIRS, MORE, FIRSTS, SECONDS, SEATED_FIRST, SEATED_SECOND, ENDS, ENDED, DRAWN, SCORES = KINDS
PART_COLUMNS = [x.split(" ")[0] for x in PART.split(", ")]
ALL, TWICE = -1, -2  # in place of a chunk: of all pairs of a cell, of those that occur twice
UNIT = 2.0**-28  # of log10 probabilities of pairs, so that sums over texts are of whole numbers


def _rows(kind: int, chunk, cell, bucket, *lists: Iterable[np.ndarray]) -> pa.Table:
    given = [pa.array([packed(x) for x in values], pa.binary()) for values in lists]
    n = len(given[0])
    numbers = [pa.array(np.full(n, x, t)) for x, t in ((kind, np.int32), (chunk, np.int64), (cell, np.int32), (bucket, np.int32))]
    return pa.table([*numbers, *given, *[pa.nulls(n, pa.binary())] * (3 - len(given))], names=["kind", "chunk", "cell", "bucket", "a", "b", "p"])


def _order(numbers: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 up; short ones are sorted digit by digit."""
    return np.argsort(numbers.astype(np.uint16 if numbers.max(initial=0) < 1 << 16 else np.int64), kind="stable")


def _distinct(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with ``return_inverse``, for rising runs one after another: a stable order merges them."""
    order = np.argsort(runs, kind="stable")
    runs, back = runs[order], np.empty(len(runs), np.int64)
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    back[order] = np.cumsum(new) - 1
    return runs[new], back


def _cut(which: np.ndarray, *values: np.ndarray) -> tuple:
    """The distinct numbers of the ascending ``which``, and the values that stand with each."""
    each, first = np.unique(which, return_index=True)
    return each, *(np.split(x, first[1:]) if len(each) else [] for x in values)


def _kind(group: pa.Table, kind: int, by: str = "bucket") -> pa.Table:
    return group.filter(pc.equal(group.column("kind"), kind)).sort_by(by)


class Numbering:
    """Words are numbered by bucket and by their place there; a pair of words stands in the cell of both their buckets."""

    def __init__(self, sizes: list[int]):
        self.n = len(sizes)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rows = max(int(self.n**0.5), 1)
        self.columns = max(self.n // self.rows, 1)
        if self.start[-1] >> 32:
            raise OverflowError("more than 4,294,967,295 distinct words")

    def bucket(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, words, "right") - 1

    def cell(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Cells of pairs, from the buckets of their words."""
        return first * self.rows // self.n * self.columns + second * self.columns // self.n

    def dealt(self, kind: int, which: int, cell: int, words: np.ndarray, *values: np.ndarray) -> pa.Table:
        """Rows for the buckets of these ascending words: where they stand (a), and their values."""
        bucket = self.bucket(words)
        each, at, *lists = _cut(bucket, words - self.start[bucket], *values)
        return _rows(kind, which, cell, each, [steps(x) for x in at], *lists)


def _turned(numbering: Numbering, total: int, distinct: int):
    def turned(group: pa.Table) -> pa.Table:
        """Texts of a chunk with what their words alone tell and their pairs by number (``TEXTS``); and its distinct pairs by
        cell (``ASKED``): words before (a), words (b), how often its training texts hold them (p)."""
        own, words = group.filter(pc.is_valid(group.column("stream"))), group.filter(pc.is_null(group.column("stream"))).sort_by("bucket")
        at = _lists(words.column("at"))
        bucket = np.repeat(words.column("bucket").to_numpy().astype(np.int64), [len(x) for x in at])
        ids, n = numbering.start[bucket] + np.concatenate(at), _values(words.column("n"))
        word = np.frombuffer(zstandard.decompress(own.column("stream")[0].as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)
        held, sizes, chunk = own.column("held")[0].values.to_numpy(zero_copy_only=False), unpacked(own.column("sizes")[0].as_py()), own.column("chunk")[0].as_py()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        known = np.bincount(doc, (n > 0)[word], len(sizes)).astype(np.int64)
        base = np.bincount(doc, np.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))[word], len(sizes))

        order = np.argsort(ids)
        ids, bucket, rank = ids[order], bucket[order], np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        word = rank[word]
        before = np.concatenate([word[-1:], word[:-1]])  # every text ends with the same token, which also stands before the next
        pairs, pair = np.unique(before * len(ids) + word, return_inverse=True)
        first, second = np.divmod(pairs, len(ids))
        cell = numbering.cell(bucket[first], bucket[second])
        order, place = _order(cell), np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        trained = np.bincount(pair, ~held[doc], len(pairs)).astype(np.int64)[order]
        which, firsts, seconds, counts = _cut(cell[order], ids[first[order]], ids[second[order]], trained)
        asked = _rows(ASKED, chunk, which, -1, [steps(x) for x in firsts], seconds, counts)
        numbers = np.sort(doc * len(pairs) + place[pair])  # within a text the order of its pairs is not told
        row = _rows(TEXTS, chunk, -1, -1, [steps(numbers)], [known], [base])
        for name in ("ids", "held", "sizes"):
            row = row.append_column(name, own.column(name))
            asked = asked.append_column(name, pa.nulls(len(asked), own.column(name).type))
        return pa.concat_tables([row, asked])

    return turned


class Pairs:
    """The distinct pairs of a cell by rising numbers of their words, with their counts in training texts; ``MORE`` has those that occur twice."""

    def __init__(self, row: pa.Table):
        self.first, self.second, self.n = np.cumsum(_values(row.column("a"))), _values(row.column("b")), _values(row.column("p"))
        self.firsts, self.before = np.unique(self.first, return_inverse=True)
        self.seconds, self.own = np.unique(self.second, return_inverse=True)

    def of_endings(self, group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of endings by the part of the model that has them, and which each pair has."""
        before, own = (_values(_kind(group, k).column("a")) for k in (FIRSTS, SECONDS))
        pairs = before[self.before] << 16 | own[self.own]
        each, back = np.unique((pairs >> 16) % ENDING_PARTS << 32 | pairs, return_inverse=True)
        return each & 0xFFFFFFFF, back


def _ends(which: int, cell: int, pairs: np.ndarray, tables: np.ndarray) -> pa.Table:
    """The pairs of endings of a cell (a) and the tables that its own pairs of words have there (b)."""
    part, pairs, tables = _cut((pairs >> 16) % ENDING_PARTS, pairs, tables.astype(np.int64))
    return _rows(ENDS, which, cell, part, [steps(x) for x in pairs], tables)


def _counted(numbering: Numbering):
    def counted(group: pa.Table) -> pa.Table:
        """Distinct pairs of a cell, all (``PAIRS``) and those that occur twice (``MORE``), and the words that either has in each
        place (``FIRSTS``, ``SECONDS``); where the pairs of each chunk stand among them; how many occur once and twice."""
        group = group.sort_by("chunk")
        cell = group.column("cell")[0].as_py()
        firsts = [np.cumsum(x) for x in _lists(group.column("a"))]
        sizes, keys = [len(x) for x in firsts], np.concatenate(firsts).view(np.uint64)
        del firsts  # cells are large: what is done with goes first
        keys <<= np.uint64(32)
        keys |= _values(group.column("b")).view(np.uint64)
        distinct, back = _distinct(keys)
        del keys
        n = np.bincount(back, _values(group.column("p")), len(distinct)).astype(np.int64)
        places = np.split(back, np.cumsum(sizes)[:-1])
        first, second = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = [_rows(MAPPED, group.column("chunk").to_numpy(), cell, -1, [steps(x) for x in places]), _rows(COUNTS, -1, cell, -1, [np.array([(n == 1).sum(), (n == 2).sum()])])]
        more = np.flatnonzero(n > 1)
        for kind, which, some in ((PAIRS, ALL, slice(None)), (MORE, TWICE, more)):
            out.append(_rows(kind, which, cell, -1, [steps(first[some])], [second[some]], [n[some]]))
            out += [numbering.dealt(place, which, cell, np.unique(x[some])) for place, x in ((FIRSTS, first), (SECONDS, second))]
        return pa.concat_tables(out)

    return counted


def _seats(numbering: Numbering, which: int, cell: int, pairs: Pairs, last: np.ndarray, every: np.ndarray) -> pa.Table:
    """Tables of the last draw (b) and of all draws (p) by word before, and of the last draw by word (b)."""
    opened, total = (np.bincount(pairs.before, x, len(pairs.firsts)).astype(np.int64) for x in (last, every))
    customers = np.bincount(pairs.own, last, len(pairs.seconds)).astype(np.int64)
    before, own = np.flatnonzero(opened), np.flatnonzero(customers)
    return pa.concat_tables([numbering.dealt(SEATED_FIRST, which, cell, pairs.firsts[before], opened[before], total[before]), numbering.dealt(SEATED_SECOND, which, cell, pairs.seconds[own], customers[own])])


def _first_tables(numbering: Numbering):
    def seated(group: pa.Table) -> pa.Table:
        """One table for every pair: of pairs that occur once for good, with all pairs of endings of the cell (``ALL``); of
        others until they are drawn (``TWICE``)."""
        pairs, cell = Pairs(_kind(group, PAIRS)), group.column("cell")[0].as_py()
        ends, back = pairs.of_endings(group)
        out = []
        for which, ones in ((ALL, pairs.n == 1), (TWICE, pairs.n > 1)):
            tables = np.bincount(back, ones, len(ends))
            some = np.flatnonzero(tables) if which == TWICE else slice(None)
            out += [_ends(which, cell, ends[some], tables[some]), _seats(numbering, which, cell, pairs, ones, ones * DRAWS)]
        return pa.concat_tables(out)

    return seated


def _priors(group: pa.Table, pairs: Pairs, prior: np.ndarray, left: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """log10 probability of the second word of each pair in the parent of its restaurant."""
    ends, back = pairs.of_endings(group)
    return prior[pairs.own] + ending_scores(ends, _values(_kind(group, ENDED).column("a"), float), left, parent)[back]


def _next_tables(numbering: Numbering, discount: float, strength: float, left: np.ndarray, parent: np.ndarray, seed: int):
    stirling = []

    def seated(group: pa.Table) -> pa.Table:
        """Draws of the tables of each pair in the restaurant of its word before: their sum (a) and the last (b) by pair
        (``DRAWN``), and what they are by word and by pair of endings."""
        if not stirling:
            stirling.append(log_stirling(discount))
        pairs, cell = Pairs(_kind(group, MORE)), group.column("cell")[0].as_py()
        followers, prior = _values(_kind(group, FIRSTS).column("b")), _values(_kind(group, SECONDS).column("b"), float)
        before = _kind(group, DRAWN)
        old = _values(before.column("b")) if before.num_rows else 1
        others = strength + discount * np.maximum(followers[pairs.before] - old, 0)
        keys = mix(pairs.first.astype(np.uint64) * BASE + pairs.second.astype(np.uint64))
        chance = 10.0 ** _priors(group, pairs, prior, left, parent)
        drawn = draw_repeatedly(pairs.n, others, chance, discount, [Keyed(keys, seed * DRAWS + k) for k in range(DRAWS)], stirling[0])
        ends, back = pairs.of_endings(group)
        rows = _rows(DRAWN, TWICE, cell, -1, [sum(drawn)], [drawn[-1]])
        return pa.concat_tables([rows, _seats(numbering, TWICE, cell, pairs, drawn[-1], sum(drawn)), _ends(TWICE, cell, ends, np.bincount(back, drawn[-1], len(ends)))])

    return seated


def _ends_summed(group: pa.Table) -> pa.Table:
    """(pair, n): tables of each pair of endings of a part."""
    pairs, back = np.unique(np.concatenate([np.cumsum(x) for x in _lists(group.column("a"))]), return_inverse=True)
    n = np.bincount(back, _values(group.column("b")), len(pairs)).astype(np.int64)
    return pa.table({"pair": pairs[n > 0], "n": n[n > 0]})


def _ended(asked: pa.Table, seen: pa.Table) -> pa.Table:
    """For each cell the probabilities of its pairs of endings (a), 0 where a pair has none of its own."""
    seen = seen.sort_by("pair")
    pairs, chance = np.append(seen.column("pair").to_numpy(), -1), np.append(seen.column("seen").to_numpy(), 0.0)
    out = []
    for x in _lists(asked.column("a")):
        at = np.searchsorted(pairs[:-1], x := np.cumsum(x))
        out.append(np.where(pairs[at] == x, chance[at], 0.0))
    return _rows(ENDED, -1, asked.column("cell").to_numpy(), asked.column("bucket").to_numpy(), out)


def _words_dealt(n_buckets: int):
    def dealt(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, words, counts = (batch.column(batch.schema.names.index(c))[i].as_py() for c in ("chunk", "words", "counts"))
                words = _unpacked_words(words)
                which, first = np.unique(buckets(word_hashes(words), n_buckets), return_index=True)
                letters, offsets = flat(words)
                cuts = np.append(first, len(words))
                lists = [_packed_words(letters[offsets[x] : offsets[y]], np.diff(offsets[x : y + 1])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                counted = pa.array([packed(x) for x in np.split(unpacked(counts), first[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), chunk, np.int64)), pa.array(which), pa.array(lists), counted], names=["chunk", "bucket", "words", "n"])

    return dealt


DEALT = "chunk long, bucket int, at binary, words binary, n binary, size long"


def _vocabulary(group: pa.Table) -> pa.Table:
    """The words of a bucket, frequent ones first, with their training counts (chunk -1), and where each chunk's words stand among
    them, with those counts."""
    group = group.sort_by("chunk")
    found = [_unpacked_words(x.as_py()) for x in group.column("words")]
    coded = pa.concat_arrays(found).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    n = np.bincount(at, _values(group.column("n")), len(coded.dictionary)).astype(np.int64)
    order = pc.sort_indices(pa.table({"n": n, "word": coded.dictionary}), [("n", "descending"), ("word", "ascending")])
    rank = np.empty(len(n), np.int64)
    rank[order.to_numpy()] = np.arange(len(n))
    at, words, n = rank[at], coded.dictionary.take(order), n[order.to_numpy()]
    cuts = np.cumsum([len(x) for x in found])[:-1]
    letters, offsets = flat(words)
    columns = [
        pa.concat_arrays([group.column("chunk").combine_chunks(), pa.array([-1], pa.int64())]),
        pa.array(np.full(len(found) + 1, group.column("bucket")[0].as_py(), np.int32)),
        pa.array([*(packed(x) for x in np.split(at, cuts)), None], pa.binary()),
        pa.array([*[None] * len(found), _packed_words(letters, np.diff(offsets))], pa.binary()),
        pa.array([packed(x) for x in (*np.split(n[at], cuts), n)], pa.binary()),
        pa.array([None] * len(found) + [len(n)], pa.int64()),
    ]
    return pa.table(columns, names=["chunk", "bucket", "at", "words", "n", "size"])


def _summed(words: pa.Table, seated: pa.Table) -> pa.Table:
    """(bucket, at, word, n, followers, customers, all_followers, ending): sums over the cells of what they seated."""
    texts = _unpacked_words(words.column("words")[0].as_py())

    def summed(kind: int, column: str) -> pa.Array:
        rows = _kind(seated, kind)
        at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x) for x in _lists(rows.column("a")))])
        return pa.array(np.bincount(at, _values(rows.column(column)), len(texts)).astype(np.int64))

    sums_ = [summed(SEATED_FIRST, "b"), summed(SEATED_SECOND, "b"), summed(SEATED_FIRST, "p")]
    return pa.table([pa.array(np.full(len(texts), words.column("bucket")[0].as_py(), np.int32)), pa.array(np.arange(len(texts))), texts, pa.array(_values(words.column("n"))), *sums_, pa.array(endings(texts))], names=SUMMED)


SUMMED = ["bucket", "at", "word", "n", "followers", "customers", "all_followers", "ending"]


def _told(firsts: list[str], seconds: list[str]):
    """What cells are told of the words before and of the words of their pairs: these columns as a, b, p."""

    def told(asked: pa.Table, values: pa.Table) -> pa.Table:
        values, out = values.sort_by("at"), []
        for kind, columns in ((FIRSTS, firsts), (SECONDS, seconds)):
            rows = _kind(asked, kind if columns else -1, "cell")
            at = [np.cumsum(x) for x in _lists(rows.column("a"))]
            lists = [[x[i] for i in at] for x in (values.column(c).to_numpy() for c in columns)] or [[]]
            out.append(_rows(kind, -1, rows.column("cell").to_numpy(), rows.column("bucket").to_numpy(), *lists))
        return pa.concat_tables(out)

    return told


def _trained(batches):
    """Training tokens and distinct training words of each bucket."""
    for batch in batches:
        n = _lists(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([int(f(x)) for x in n], pa.int64()) for f in (np.sum, np.count_nonzero)], names=["tokens", "words"])


def _kept(parts: DataFrame) -> DataFrame:
    """A written table whose rows are long lists: small row groups, as writers hold one and readers up to 4,096 rows of one."""
    return written(parts, **ROW_GROUPS)


def _in_waves(by: str, made, *parts: DataFrame) -> DataFrame:
    """What ``made`` gives for ``parts``, whose groups are of one number ``by`` each: kept for one share of these numbers after
    the other, so that shuffle files of one share stand at a time."""
    return reduce(DataFrame.unionAll, [_kept(made(*(x.where(f"pmod(hash({by}), {WAVES}) = {k}") for x in parts))) for k in range(WAVES)])


def _of(parts: DataFrame, *kinds: int) -> DataFrame:
    return parts.where(F.col("kind").isin(*kinds))


def _drop(*tables: DataFrame) -> None:
    for table in tables:
        removed(table)


def _told_endings(asked: pa.Table, words: pa.Table) -> pa.Table:
    found = endings(_unpacked_words(words.column("words")[0].as_py()))
    return _told(["ending"], ["ending"])(asked, pa.table({"at": np.arange(len(found)), "ending": found}))


def _tables(discount: float, totals: np.ndarray, seed: int):
    """(..., tables, mean_tables): draws of the tables of each word in the restaurant of its ending."""

    def tables(batches):
        stirling = log_stirling(discount)
        for batch in batches:
            names = batch.schema.names
            customers, old, spelling, ending = (batch.column(names.index(c)).to_numpy() for c in ("customers", "tables", "spelling", "ending"))
            keys = word_hashes(batch.column(names.index("word")))
            others = STRENGTH + discount * np.maximum(totals[ending] - old, 0)
            drawn = draw_repeatedly(customers, others, 10.0**spelling, discount, [Keyed(keys, seed * DRAWS + k) for k in range(DRAWS)], stirling)
            columns = [pa.array(drawn[-1]) if c == "tables" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.mean(drawn, axis=0))], names=[*names, "mean_tables"])

    return tables


def estimated_discount(once: int, twice: int) -> float:
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros(np.shape(x))
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


GRID = 10.0 ** np.arange(-2, 8.0625, 0.125)


def strength_slope(size: np.ndarray, tables: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Derivative by the strength of the log probability that restaurants of these sizes have these tables."""
    return (digamma(strength / discount + tables) - digamma(strength / discount + 1)) / discount - (digamma(strength + size) - digamma(strength + 1))


def _slopes(discount: float):
    def slopes(batches):
        for batch in batches:
            size, tables, words = (batch.column(i).to_numpy() for i in range(3))
            sums_ = [(words * np.rint(strength_slope(size, tables, discount, x) * 2**20)).astype(np.int64).sum() for x in GRID]  # whole numbers: no order shows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(GRID))), pa.array(sums_)], names=["at", "slope"])

    return slopes


def likeliest_strength(vocabulary: DataFrame, discount: float) -> float:
    """Strength of the restaurants of words before, where the likelihood of their tables has its top (ends of ``GRID`` if beyond)."""
    alike = vocabulary.where("n > 0").groupBy("n", "followers").agg(F.count("*").alias("words"))
    found = alike.mapInArrow(_slopes(discount), "at long, slope long").groupBy("at").agg(F.sum("slope").alias("slope")).collect()
    if not found:
        return STRENGTH
    slope = [r.slope for r in sorted(found)]
    top = next((i for i, x in enumerate(slope) if x <= 0), len(slope) - 1)
    if not top or slope[top] > 0:
        return float(GRID[top])
    return float(GRID[top - 1] * (GRID[top] / GRID[top - 1]) ** (slope[top - 1] / (slope[top - 1] - slope[top])))


def ending_scores(pairs: np.ndarray, seen: np.ndarray, left: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """log10 probability of the second ending of each pair after the first; ``seen`` is 0 where a pair has no cell of its own."""
    known = seen > 0
    return np.log10(np.where(known, seen, left[pairs >> 16] * parent[pairs & 0xFFFF]))


def pair_scores(n: np.ndarray, tables: np.ndarray, size: np.ndarray, all_tables: np.ndarray, prior: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """log10 probability of a word after another: ``n`` times there at ``tables`` tables, in a restaurant of ``size`` customers
    at ``all_tables`` tables; ``prior`` is its log10 probability in the restaurant of all words."""
    open_ = (strength + discount * all_tables) / (strength + size)
    out = np.log10(open_) + prior  # a long unknown word can be rarer than any double
    seen = n > 0
    out[seen] = np.log10((n[seen] - discount * tables[seen]) / (strength + size[seen]) + open_[seen] * 10.0 ** prior[seen])
    return out


def _pairs_scored(discount: float, strength: float, left: np.ndarray, parent: np.ndarray):
    def scored(group: pa.Table) -> pa.Table:
        """For the pairs of each chunk in this cell, less their log10 probabilities, in ``UNIT``."""
        pairs, chunks = Pairs(_kind(group, PAIRS)), _kind(group, MAPPED, "chunk")
        size, all_tables = (_values(_kind(group, FIRSTS).column(c)) for c in "bp")
        tables = np.minimum(pairs.n, 1).astype(float)
        tables[pairs.n > 1] = _values(_kind(group, DRAWN).column("a")) / DRAWS
        prior = _priors(group, pairs, _values(_kind(group, SECONDS).column("b"), float), left, parent)
        scores = np.empty(len(pairs.n), np.int64)
        for i in range(0, len(scores), BLOCK):
            at = slice(i, i + BLOCK)
            before = pairs.before[at]
            score = pair_scores(pairs.n[at], tables[at], size[before], all_tables[before] / DRAWS, prior[at], discount, strength)
            scores[at] = np.rint(-score / UNIT)
        answers = (scores[np.cumsum(unpacked(x.as_py()))] for x in chunks.column("a"))
        return _rows(SCORES, chunks.column("chunk").to_numpy(), group.column("cell")[0].as_py(), -1, answers)

    return scored


def _texts_scored(id_field: T.StructField, total: int):
    def scored(group: pa.Table) -> pa.Table:
        own, pair = _kind(group, TEXTS), _values(_kind(group, SCORES, "cell").column("a"))
        sizes = _values(own.column("sizes"))
        doc, number = np.divmod(np.cumsum(_values(own.column("a"))), len(pair))
        score = np.bincount(doc, pair[number], len(sizes)) * -UNIT
        ids, held = (own.column(c).combine_chunks().flatten() for c in ("ids", "held"))
        columns = [ids, held, pa.array(sizes), pa.array(_values(own.column("b"))), pa.array(np.full(len(sizes), total, np.int64)), pa.array(_values(own.column("p"), float)), pa.array(score)]
        return pa.table(columns, names=[id_field.name, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scored


def _spelt_and_seated(vocabulary: DataFrame, model: DataFrame, shared: np.ndarray, discount: float, seed: int) -> DataFrame:
    totals = np.zeros(1 << 16, np.int64)
    for row in vocabulary.groupBy("ending").agg(F.sum("tables").alias("tables")).collect():  # one row per ending
        totals[row.ending] = row.tables
    words = vocabulary.drop("mean_tables", "spelling")
    return with_spelling(words, model, shared, _tables(discount, totals, seed), (T.StructField("mean_tables", T.DoubleType()),))


@contextmanager
def _clean_shuffles(spark: SparkSession):
    """Within it shuffle files go as soon as a table is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def score_texts(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column; texts where it is not true are learnt from. Tokens are maximal runs without
    white space, A-Z in lower case, then one end token. ``base_score`` sums log10((c + 0.1) / (N + 0.1 * (V + 1))),
    ``score`` the model's log10 probabilities.

    Defined results: a null text is empty and has the end token only; repeated rows are texts of their own; a null
    ``held_out`` is false; without training texts all words are scored by an untrained model; an empty table gives
    no rows. Other columns are not read.
    """
    with _clean_shuffles(docs.sparkSession):
        return _score_texts(docs, held_out, doc_id, text, seed)


def _score_texts(docs: DataFrame, held_out, doc_id: str, text: str, seed: int) -> DataFrame:
    id_field = T.StructField(doc_id, docs.schema[doc_id].dataType)
    ids = f"ids array<{id_field.dataType.simpleString()}>, held array<boolean>, sizes binary"
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    kinds = (*(x.split(" ")[1] for x in ids.split(", ")[:2]), "binary", "binary", "binary", "binary", "long")
    packed_texts = source.mapInArrow(_chunked, ", ".join(map(" ".join, zip(CHUNK_COLUMNS, kinds, strict=True))))
    chunks = _kept(packed_texts.withColumn("chunk", F.monotonically_increasing_id()))
    n_buckets = max(12, (chunks.agg(F.sum("n_tokens")).first()[0] or 0) // BUCKET_TOKENS)

    dealt = _kept(chunks.select("chunk", "words", "counts").mapInArrow(_words_dealt(n_buckets), "chunk long, bucket int, words binary, n binary").groupBy("bucket").applyInArrow(_vocabulary, DEALT))
    words = _kept(dealt.where("chunk < 0").select("bucket", "words", "n", "size"))
    sizes = [0] * n_buckets
    for row in words.select("bucket", "size").collect():  # one row per bucket
        sizes[row.bucket] = row.size
    numbering = Numbering(sizes)
    total, distinct = words.select("n").mapInArrow(_trained, "tokens long, words long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    meeting = chunks.select("chunk", "ids", "held", "sizes", "stream").unionByName(dealt.where("chunk >= 0").select("chunk", "bucket", "at", "n"), allowMissingColumns=True)
    turned = _in_waves("chunk", lambda x: x.groupBy("chunk").applyInArrow(_turned(numbering, total, distinct), f"{PART}, {ids}"), meeting)
    _drop(chunks, dealt)
    texts = _kept(_of(turned, TEXTS))
    counted = _in_waves("cell", lambda x: x.groupBy("cell").applyInArrow(_counted(numbering), PART), _of(turned, ASKED).select(*PART_COLUMNS))
    _drop(turned)
    few = [unpacked(r.a) for r in _of(counted, COUNTS).select("a").collect()]  # one row per cell
    pair_discount = estimated_discount(*sum(few, np.zeros(2, np.int64)).tolist())

    def asked(which: int) -> DataFrame:
        return _of(counted, FIRSTS, SECONDS).where(F.col("chunk") == which).groupBy("bucket")

    def meet(*parts: DataFrame):
        return reduce(DataFrame.unionAll, parts).groupBy("cell")

    def summed(seated: DataFrame) -> DataFrame:
        counts = ", ".join(f"{c} {t}" for c, t in zip(SUMMED, ("int", "long", "string", "long", "long", "long", "long", "long"), strict=True))
        return written(words.groupBy("bucket").cogroup(_of(once.unionAll(seated), SEATED_FIRST, SEATED_SECOND).groupBy("bucket")).applyInArrow(_summed, counts))

    def told(values: DataFrame, which: int, firsts: list[str], seconds: list[str]) -> DataFrame:
        values = values.select("bucket", "at", *dict.fromkeys(firsts + seconds)).groupBy("bucket")
        return asked(which).cogroup(values).applyInArrow(_told(firsts, seconds), PART)

    def ended(ends: DataFrame, seen: DataFrame) -> DataFrame:
        seen = seen.withColumn("bucket", F.expr(f"int((pair >> 16) % {ENDING_PARTS})")).groupBy("bucket")
        return _of(ends, ENDS).groupBy("bucket").cogroup(seen).applyInArrow(_ended, PART)

    told_endings = asked(ALL).cogroup(words.groupBy("bucket")).applyInArrow(_told_endings, PART)
    first = _kept(meet(_of(counted, PAIRS), told_endings).applyInArrow(_first_tables(numbering), PART))
    once, seated = (first.where(F.col("chunk") == which) for which in (ALL, TWICE))
    drawn = []
    vocabulary = summed(seated)
    once_twice = vocabulary.agg(F.count_if(F.col("customers") == 1), F.count_if(F.col("customers") == 2)).first()
    discount = estimated_discount(*map(int, once_twice))
    model = shared = None
    for k in range(ROUNDS):
        strength = likeliest_strength(vocabulary, pair_discount)
        used = [vocabulary, model] if k else [vocabulary]
        vocabulary = vocabulary.withColumn("tables", F.least("customers", F.lit(1).cast("long")))
        if k:
            vocabulary = written(_spelt_and_seated(vocabulary, model, shared, discount, seed + ROUNDS + k))
            used.append(vocabulary)
        model, shared = letter_model(vocabulary, model, seed + k)
        spelt = written(_spelt_and_seated(vocabulary, model, shared, discount, seed + k))
        _drop(*used)
        of_endings = spelt.groupBy("ending").agg(F.sum("customers").alias("size"), F.sum("mean_tables").alias("all_tables"))
        size = STRENGTH + F.col("size")
        open_ = (STRENGTH + discount * F.col("all_tables")) / size
        probability = (F.col("customers") - discount * F.col("mean_tables")) / size + open_ * F.pow(F.lit(10.0), "spelling")
        # a long unknown word can be rarer than any double
        prior = F.when(F.col("customers") > 0, F.log10(probability)).otherwise(F.log10(open_) + F.col("spelling"))
        priors = spelt.join(F.broadcast(of_endings), "ending").withColumn("prior", prior)  # at most 65,536 endings
        turns = _of(once.unionAll(seated), ENDS).groupBy("bucket").applyInArrow(_ends_summed, "pair long, n long")
        turns = written(turns)
        seen, left, parent = ending_model(turns, seed + k)
        _drop(turns)
        parts = told(priors, TWICE, ["ending", "followers"], ["ending", "prior"]), ended(seated, seen), *drawn
        before, seated = seated, _kept(meet(_of(counted, MORE), *parts).applyInArrow(_next_tables(numbering, pair_discount, strength, left, parent, seed + k), PART))
        drawn = [_of(seated, DRAWN)]
        vocabulary = summed(seated)
        if k:
            _drop(before)
        if k < ROUNDS - 1:
            _drop(spelt, seen)
    firsts = told(vocabulary, ALL, ["ending", "n", "all_followers"], [])
    seconds = told(priors, ALL, [], ["ending", "prior"])
    answers = _kept(reduce(DataFrame.unionAll, (firsts, seconds, ended(once, seen))))
    _drop(words, first, vocabulary, spelt, seen, model)
    score = _pairs_scored(pair_discount, strength, left, parent)
    scores = _in_waves("cell", lambda *x: meet(*x).applyInArrow(score, PART), _of(counted, PAIRS, MAPPED), answers, *drawn)
    _drop(counted, answers, seated)
    fields = [id_field, *(T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))]
    scored = _in_waves("chunk", lambda x: x.groupBy("chunk").applyInArrow(_texts_scored(id_field, total), T.StructType(fields)), texts.unionByName(scores, allowMissingColumns=True))
    _drop(texts, scores)
    return scored

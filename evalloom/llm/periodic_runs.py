"""Periodic runs of words: every stretch that repeats a shorter one at least four times, from a suffix automaton with link-cut access.

The suffix links of a text's automaton form a tree; the path from a prefix to the root holds all its suffixes by
length. A node's colour is where its words last ended. Appending a word recolours the path of the new prefix, which
link-cut access does in few segments of one colour each: a segment whose colour is ``d`` words back and whose longest
suffix has at least ``d`` words is a square of period ``d``. That suffix is also all that the two prefixes share, so
the square's run starts where it starts, and ends at the last word that finds the run again. The root of a square
found like this is never itself a power: its last occurrence would be nearer. So every period is a smallest one.

A word inside a run is covered by three words that stand in the text at least three times. Texts are cut at all other
words first, so that automata grow only over stretches that can hold a run; most texts have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.arrays import BASE, SPACED, flat, mix, ranges, span_hash, sums, text_chunks

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length) of each state of the suffix automaton, and the state of each prefix."""
    step, link, length = [{}], [-1], [0]
    last, prefixes = 0, []
    for word in words:
        state = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = state
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[state] = clone
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
        prefixes.append(state)
        last = state
    return link, length, prefixes


class Paths:
    """Link-cut tree over suffix links. Every splay tree is one path of one colour, ordered by length; its root keeps the colour."""

    def __init__(self, link: list[int], length: list[int]):
        self.up = [p if p > 0 else -1 for p in link]  # the empty suffix is on every path and tells nothing
        self.left, self.right, self.colour = [-1] * len(link), [-1] * len(link), [-1] * len(link)
        self.length = length

    def raised(self, x: int) -> None:
        """Splay ``x`` to the root of its tree."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[x]
            if p < 0:
                return
            if left[p] == x:
                on_left = True
            elif right[p] == x:
                on_left = False
            else:
                return
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                turns = (p, x) if (left[g] == p) == on_left else (x, x)
            else:
                turns = (x,)
            for y in turns:
                p = up[y]
                g = up[p]
                if left[p] == y:
                    inner = right[y]
                    left[p], right[y] = inner, p
                else:
                    inner = left[y]
                    right[p], left[y] = inner, p
                if inner >= 0:
                    up[inner] = p
                up[p], up[y] = y, g
                if g >= 0 and left[g] == p:
                    left[g] = y
                elif g >= 0 and right[g] == p:
                    right[g] = y
                else:
                    colour[y] = colour[p]

    def recoloured(self, x: int, now: int) -> list[tuple[int, int]]:
        """Give the path from ``x`` to the root the colour ``now``; the (colour, longest length) of its segments so far."""
        up, right, colour, found, below = self.up, self.right, self.colour, [], -1
        while x >= 0:
            self.raised(x)
            was = colour[x]
            if was >= 0:
                found.append((was, self.length[x]))
            if right[x] >= 0:
                colour[right[x]] = was
            right[x] = below
            below, x = x, up[x]
        colour[below] = now
        return found


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``times`` (two or more) periods, by start, then period."""
    link, length, prefixes = automaton(words)
    paths, ends = Paths(link, length), {}
    for i, state in enumerate(prefixes):
        for was, shared in paths.recoloured(state, i):
            period = i - was
            if shared >= (times - 1) * period and shared + period >= least:
                ends[i - period - shared + 1, period] = i
    return [(start, ends[start, period] - start + 1, period) for start, period in sorted(ends)]


def _bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts (and one more), starts and ends of their words, first word of each text."""
    data, offsets = flat(texts)
    word = SPACED[data]
    edge = np.zeros(len(word) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(word & ~after) + 1
    return np.append(data, np.uint8(32)), starts, ends, np.searchsorted(starts, offsets)


def with_tail(n: int, h: int) -> np.ndarray:
    """Places of the words of a text of ``n`` words whose tail repeats as the number ``h`` says; all in order unless 10 divides it."""
    places = np.arange(n)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _stretches(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of words that can hold a run: each covered by three words found three times in the text."""
    n = len(hashes) - 2
    if n < LEAST - 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = doc[:n] == doc[2:]
    windows = mix((hashes[:n] * BASE + hashes[1 : n + 1]) * BASE + hashes[2:]) + doc[:n].astype(np.uint64) * BASE
    _, number, counts = np.unique(mix(windows), return_inverse=True, return_counts=True)
    often = np.flatnonzero(inside & (counts[number] >= 3))
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + 3, -1)
    covered = np.cumsum(change)[:-1] > 0
    new_doc = np.ones(len(hashes), bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    starts = np.flatnonzero(covered & (new_doc | ~np.append(False, covered[:-1])))
    ends = np.flatnonzero(covered & np.append(new_doc[1:] | ~covered[1:], True)) + 1
    long = ends - starts >= LEAST
    return starts[long], ends[long]


def _found(batches):
    for chunk in text_chunks(batches, "text"):
        data, starts, ends, first = _bounds(chunk.column(1))
        counts = np.diff(first)
        doc = np.repeat(np.arange(len(counts)), counts)
        places = np.arange(len(starts))
        for row, h in enumerate(chunk.column(2).to_pylist()):
            if h is not None and h % 10 == 0:
                places[first[row] : first[row + 1]] = first[row] + with_tail(int(counts[row]), h)
        starts, ends = starts[places], ends[places]
        prefix = sums(data.astype(np.uint64) + np.uint64(1))
        hashes = mix(span_hash(prefix, starts, ends) + (ends - starts).astype(np.uint64) * BASE)

        runs, kept = [[] for _ in counts], np.ones(len(starts), bool)
        text = data.tobytes()
        for a, b in zip(*_stretches(hashes, doc)):
            names: dict[bytes, int] = {}
            words = [names.setdefault(text[s:e], len(names)) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
            here = runs[doc[a]]
            for start, length, period in runs_of(words):
                kept[a + start + period : a + start + length] = False
                here.append({"start": int(a - first[doc[a]]) + start, "length": length, "period": period})

        sizes = (ends - starts + 1)[kept]
        out = data[ranges(starts[kept], sizes)]
        cuts = np.append(0, np.cumsum(sizes))
        out[cuts[1:] - 1] = 32
        held = np.bincount(doc[kept], minlength=len(counts))
        bounds = cuts[np.append(0, np.cumsum(held))]
        stay = np.ones(len(out), bool)
        stay[bounds[1:][held > 0] - 1] = False  # no space behind a text's last word
        offsets = bounds - np.append(0, np.cumsum(held > 0))
        joined = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[stay])).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [chunk.column(0), pa.array(counts.astype(np.int64)), pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))), joined],
            names=["id", "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tail: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs, collapsed.

    Words are maximal stretches of ``[^\\x20\\x09-\\x0D]``, numbered from 0. ``runs`` lists (start, length, period), by
    start, then period, of every run of at least 6 words and 4 periods; ``collapsed`` is the text without what
    follows the first period of a run, its words joined by one space. ``tail`` gives rows a number; where ten divides
    it, the text gets a repeated tail first (see ``with_tail``): cases with known runs for trials of the operator.

    No shuffle: a text is one value and stays in its task; chunks of texts are bounded in bytes.

    Defined results: a null, empty or blank text has no words, no runs and an empty ``collapsed``; a null number adds no
    tail; rows with a null id or a repeated id or text each count for themselves; an empty table gives no rows. Other
    columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), (F.lit(None) if tail is None else tail).cast("long").alias("tail"))
    schema = T.StructType([
        T.StructField("id", source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ])
    return source.mapInArrow(_found, schema).withColumnRenamed("id", doc_id)

"""Benchmark decontamination over sharded suffix arrays of the corpus.

Every task turns its documents into shards of bounded size and builds, per shard, a suffix array
over words. Every test suffix is then binary-searched in every shard, which gives its longest
verbatim match and, for windows, the interval of all places where the window stands.

The arrays are sparse without losing a match: words outside the test vocabulary are one symbol,
and only suffixes whose first words occur at the start of some test suffix are kept, since any
other suffix shares fewer words with every test suffix than the shortest window has.

The test set is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text; when there are
several, the corpus passes by each block in turn and the hits are united per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.arrays import ALNUM, Words, ranges, span_hash, sums, text_chunks
from evalloom.llm.store import free_name, written

WINDOW = 13
BLOCK_BYTES = 4 << 20
STEM = 3  # words that a kept suffix shares with the start of a test suffix

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "n_words", "item_word")] + [T.StructField("item_id", T.StringType())])
SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("items", T.ArrayType(T.StringType()))])
RUN_ARROW = pa.struct([(n, pa.int64()) for n in ("start", "end", "n_words", "item_word")] + [("item_id", pa.string())])
SCAN_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN_ARROW)), ("items", pa.list_(pa.string()))])


class TestSet:
    """Words, windows and stems of one block of benchmark items."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int):
        words = Words(pa.array(texts, pa.string()), ALNUM)
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        self.ids = ids.astype(np.int64) + 2  # 0: past the end of a text, 1: a word of no item
        self.item_ids, self.item = item_ids, words.doc
        self.end = words.first[1:][words.doc] if len(words) else np.zeros(0, np.int64)
        self.first = words.first
        n = np.diff(words.first)
        short = np.flatnonzero((n > 0) & (n < window))
        at = np.flatnonzero(self.end - np.arange(len(words)) >= window)
        at = np.concatenate([at, words.first[short]])
        length = np.where(np.arange(len(at)) < len(at) - len(short), window, 0)
        length[len(at) - len(short) :] = n[short]
        prefix = sums(self.ids.astype(np.uint64))
        key = np.stack([span_hash(prefix, at, at + length), length.astype(np.uint64)], axis=1)
        _, pick, kind = np.unique(key, axis=0, return_index=True, return_inverse=True)
        #: Each distinct window once: where it first stands and how long it is; the items that hold window k.
        self.window_at, self.window_len = at[pick], length[pick]
        pairs = np.unique(np.stack([kind.reshape(-1), self.item[at]], axis=1), axis=0)
        self.holders = pairs[:, 1]
        self.holder_from = np.searchsorted(pairs[:, 0], np.arange(len(pick) + 1))
        self.radix = len(self.vocabulary) + 2
        own = stems(self.ids, self.end, self.radix)
        self.stems = np.unique(own)
        self.short_stems = [np.unique(own[words.first[short][n[short] == k]] // self.radix ** (STEM - k)) for k in range(1, STEM)]


def stems(ids: np.ndarray, end: np.ndarray, radix: int) -> np.ndarray:
    """The first STEM words of every suffix as one number that orders like them."""
    at, out = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    padded = np.concatenate([ids, np.zeros(STEM, np.int64)])
    for j in range(STEM):
        out = out * radix + np.where(at + j < end, padded[at + j], 0)
    return out


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


class Shard:
    """Sparse suffix array over the words of one chunk of documents."""

    def __init__(self, words: Words, test: TestSet):
        self.words, self.test = words, test
        slot = np.minimum(np.searchsorted(test.vocabulary, words.hash), max(0, len(test.vocabulary) - 1))
        known = test.vocabulary[slot] == words.hash if len(test.vocabulary) else np.zeros(len(words), bool)
        self.ids = np.where(known, slot + 2, 1)
        self.end = words.first[1:][words.doc] if len(words) else np.zeros(0, np.int64)
        stem = stems(self.ids, self.end, test.radix)
        keep = np.zeros(len(words), bool)
        live = np.flatnonzero(known)
        keep[live] = member(stem[live], test.stems)
        for k, short in enumerate(test.short_stems, 1):
            if len(short):
                keep[live] |= member(stem[live] // test.radix ** (STEM - k), short)
        self.order = self.sorted_suffixes(np.flatnonzero(keep), stem)
        self.prefix, self.test_prefix = sums(self.ids.astype(np.uint64)), sums(test.ids.astype(np.uint64))

    def sorted_suffixes(self, kept: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """The kept suffixes in order, by prefix doubling. A suffix that is not kept counts by its stem alone:
        no test suffix goes on past it, so what follows cannot change any comparison with one."""
        if not len(kept):
            return kept
        rank = np.zeros(len(stem) + 1, np.int64)
        order = np.argsort(stem[kept], kind="stable")
        new = np.diff(stem[kept][order], prepend=-1) != 0
        rank[kept[order]] = np.cumsum(new)
        step, longest = STEM, int((self.test.end - np.arange(len(self.test.ids))).max())
        end, stem = self.end[kept], np.append(stem, 0)
        while step < longest and new.sum() < len(kept):
            after = np.where(kept + step < end, kept + step, len(stem) - 1)
            order = np.lexsort((rank[after], stem[after], rank[kept]))
            keys = np.stack([rank[kept], stem[after], rank[after]])[:, order]
            new = np.ones(len(kept), bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            rank[kept[order]] = np.cumsum(new)
            step *= 2
        return kept[order]

    def common(self, at: np.ndarray, test_at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that the suffixes ``at`` and the test suffixes share, ``most`` at most."""
        most = np.minimum(most, self.end[at] - at)
        same = np.zeros(len(at), np.int64)
        step = 1 << int(max(1, most.max(initial=1))).bit_length()
        while step:
            fits = np.flatnonzero(same + step <= most)
            p, t = at[fits] + same[fits], test_at[fits] + same[fits]
            equal = span_hash(self.prefix, p, p + step) == span_hash(self.test_prefix, t, t + step)
            same[fits[equal]] += step
            step //= 2
        return same

    def search(self, test_at: np.ndarray, length: np.ndarray, past: bool) -> np.ndarray:
        """Where test suffixes cut to ``length`` words belong in the array; ``past`` goes behind all that start with them."""
        low, high = np.zeros(len(test_at), np.int64), np.full(len(test_at), len(self.order))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            at, t, n = self.order[middle], test_at[open_], length[open_]
            same = self.common(at, t, n)
            theirs = np.where(at + same < self.end[at], self.ids[np.minimum(at + same, len(self.ids) - 1)], 0)
            own = self.test.ids[np.minimum(t + same, len(self.test.ids) - 1)]
            right = np.where(same == n, past, theirs < own)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    def longest(self, test_at: np.ndarray) -> np.ndarray:
        """Length of the longest match of each test suffix anywhere in the shard."""
        if not len(self.order):
            return np.zeros(len(test_at), np.int64)
        most = self.test.end[test_at] - test_at
        at = self.search(test_at, most, past=False)
        near = [np.clip(at + d, 0, len(self.order) - 1) for d in (-1, 0)]
        return np.maximum(*(self.common(self.order[i], test_at, most) for i in near))

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Every place where a window stands, and which distinct window it is."""
        test = self.test
        if not len(self.order) or not len(test.window_at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.flatnonzero(self.longest(test.window_at) >= test.window_len)
        at, length = test.window_at[found], test.window_len[found]
        low, high = self.search(at, length, past=False), self.search(at, length, past=True)
        place, kind = self.order[ranges(low, high - low)], np.repeat(found, high - low)
        sure = np.ones(len(place), bool)  # hashes led here; the words decide
        for j in range(int(length.max(initial=0))):
            due = np.flatnonzero(test.window_len[kind] > j)
            sure[due] &= self.ids[place[due] + j] == test.ids[test.window_at[kind[due]] + j]
        return place[sure], kind[sure]

    def scan(self) -> pa.Array:
        """Per document: words, maximal hit runs with the longest match that starts in each, items with a window in it."""
        place, kind = self.hits()
        words, test = self.words, self.test
        n = len(words.first) - 1
        counts = np.diff(words.first)
        runs: list[list] = [[] for _ in range(n)]
        items: list[list] = [[] for _ in range(n)]
        if len(place):
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + test.window_len[kind], -1)
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.ones(len(hit), bool)
            edge[1:] = words.doc[1:] != words.doc[:-1]
            before = np.concatenate([[False], hit[:-1]]) & ~edge
            starts = np.flatnonzero(hit & ~before)
            after = np.concatenate([hit[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
            ends = np.flatnonzero(hit & ~after) + 1
            length = self.common(place, test.window_at[kind], test.end[test.window_at[kind]] - test.window_at[kind])
            run_of = np.searchsorted(starts, place, "right") - 1
            by = np.lexsort((place, -length, run_of))
            best = by[np.unique(run_of[by], return_index=True)[1]]
            t = test.window_at[kind[best]]
            for doc, start, end, size, item in zip(words.doc[starts], starts, ends, length[best], t, strict=True):
                base = words.first[doc]
                runs[doc].append({"start": start - base, "end": end - base, "n_words": size, "item_word": item - test.first[test.item[item]], "item_id": test.item_ids[test.item[item]]})
            doc_kind = np.unique(np.stack([words.doc[place], kind], axis=1), axis=0)
            held = test.holder_from[doc_kind[:, 1] + 1] - test.holder_from[doc_kind[:, 1]]
            pairs = np.stack([np.repeat(doc_kind[:, 0], held), test.holders[ranges(test.holder_from[doc_kind[:, 1]], held)]], axis=1)
            for doc, item in np.unique(pairs, axis=0):
                items[doc].append(test.item_ids[item])
        items = [sorted(set(x)) for x in items]
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN_ARROW)), pa.array(items, pa.list_(pa.string()))], fields=list(SCAN_ARROW))


def _pass(docs: DataFrame, block: list, text: str, into: str, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(([str(x[0]) if x[0] is not None else "" for x in block], [x[1] for x in block]))

    def scan(batches):
        test = TestSet(*sent.value, window)
        for chunk in text_chunks(batches, text):
            texts = chunk.column(chunk.schema.get_field_index(text))
            yield pa.RecordBatch.from_arrays([*chunk.columns, Shard(Words(texts, ALNUM), test).scan()], names=[*chunk.schema.names, into])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(into, SCAN)]))


def _united(first: str, second: str) -> F.Column:
    """Two scans of the same document as one: runs are joined where they touch, items are a set."""
    runs = F.sort_array(F.concat(F.col(first).runs, F.col(second).runs))
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, r: F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(last(acc).start.alias("start"), F.greatest(last(acc).end, r.end).alias("end"), *(F.when(r.n_words > last(acc).n_words, r[n]).otherwise(last(acc)[n]).alias(n) for n in ("n_words", "item_word", "item_id")))),
    )
    merged = F.aggregate(runs, F.array().cast(T.ArrayType(RUN)), lambda acc, r: F.when((F.size(acc) > 0) & (r.start <= last(acc).end), joined(acc, r)).otherwise(F.concat(acc, F.array(r))))
    return F.struct(F.col(first).n_words.alias("n_words"), merged.alias("runs"), F.array_sort(F.array_union(F.col(first)["items"], F.col(second)["items"])).alias("items"))


def scan_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "scan") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, runs and items.

    Words are maximal runs of letters, digits and non-ASCII characters, A-Z in lower case. A window is
    ``window`` consecutive words of an item, or the whole of a shorter item. ``runs`` are the maximal
    stretches [start, end) of words inside occurrences of windows, each with the longest verbatim match
    that starts in it (its words, item and place in the item); ``items`` the ids, as sorted strings, of
    all items with an occurring window.

    Defined results: a null or empty text has no words, runs or items; an item without words has no
    window; repeated items or ids count once; a null item id is the empty string; repeated documents
    are rows of their own; empty tables give no rows or no hits; an existing column ``into`` is an error.
    """
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists; name another")
    items = items.select(F.col(item_id).cast("string"), F.col(item_text)).where(F.length(F.trim(item_text)) > 0)
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) if blocks > 1 else F.lit(0)
    found = _pass(docs, items.where(block == 0).orderBy(item_id, item_text).collect(), text, into, window)
    for k in range(1, blocks):  # each block is bounded; the table between two passes keeps one block in memory
        more = free_name(found, "_more")
        found = _pass(written(found), items.where(block == k).orderBy(item_id, item_text).collect(), text, more, window)
        found = found.withColumn(into, _united(into, more)).drop(more)
    return found


def n_hit(scan: str) -> F.Column:
    """Words inside any occurrence of a window."""
    return F.aggregate(F.col(scan).runs, F.lit(0).cast("long"), lambda acc, r: acc + r.end - r.start)


def contaminated(scan: str, share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (n_hit(scan) > 0) & (n_hit(scan) * share >= F.col(scan).n_words)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows, columns as they were."""
    into = free_name(docs, "_scan")
    return scan_benchmark(docs, items, text, into=into, **options).where(~contaminated(into)).drop(into)

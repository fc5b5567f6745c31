"""Best-fit packing of token pieces into sequences by linear grouping.

Texts become pieces of at most ``capacity`` tokens. The number of pieces of each length, at most
``capacity`` figures, is all that a packing needs: large lengths are split into groups of equal
cardinality and rounded up to their group's longest; the few sizes that remain are packed by an
optimal mix of configurations (linear programme, columns generated by a knapsack); actual lengths then
take the places of their group; what rounding left over, and the small pieces, go in by best fit.
The plan comes out as runs "pieces number i to j of this length go to sequences s to s + j - i at
this offset", so its size depends on the capacity and not on the number of texts. Tasks number the
pieces of each length and look their places up.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.arrays import ranges, text_chunks
from evalloom.llm.store import free_name, written

CAPACITY = 2048
GROUPS = 16
END_ID = 0
ROWS_PER_BUCKET = 100_000
REMEMBERED = 1_000_000  # words of which a Python worker keeps the ids, some 200 MB
SEPARATOR = b"\x01"  # stands between words that are encoded as one text
GAP = 2e-4  # the configurations may need this share of sequences more than the linear programme's bound


# ------------------------------------------------------------------ the plan
def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(copies of each size, times used) of a nearly optimal fractional packing."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    while True:
        inverse = np.linalg.inv(basis)
        used = inverse @ demand
        price = inverse.sum(axis=0)
        worth, column = knapsack(sizes, price, capacity)
        if worth <= 1 + GAP:
            return [(basis[:, j].astype(int), used[j]) for j in range(k)]
        direction = inverse @ column
        rising = np.flatnonzero(direction > 1e-9)
        basis[:, rising[np.argmin(used[rising] / direction[rising])]] = column


def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration that fits."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, worth = sizes[order], price[order]
    for room in range(int(small[0]), capacity + 1):
        n = np.searchsorted(small, room, "right")
        value = best[room - small[:n]] + worth[:n]
        j = int(value.argmax())
        best[room], last[room] = value[j], order[j]
        if best[room - 1] > best[room]:
            best[room], last[room] = best[room - 1], -1
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            column[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), column


class Plan:
    """Runs (length, first rank, first sequence, offset); ranks count the pieces of one length from 0."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None):
        """``counts[n]``: pieces of length n. Lengths up to ``small``, an eighth of the capacity by default, are small."""
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.next_rank = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int]] = []
        self.sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
        small = capacity // 8 if small is None else small
        self.pack_large(small, groups)
        for length in range(capacity, 0, -1):
            self.best_fit(length)

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.next_rank[length]), sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def pack_large(self, small: int, groups: int) -> None:
        lengths = np.flatnonzero(self.left[small + 1 :])[::-1] + small + 1
        if not len(lengths):
            return
        after = np.cumsum(self.left[lengths])
        group = np.minimum((after - self.left[lengths]) * groups // after[-1], groups - 1)  # by a length's first piece
        sizes = np.array([lengths[group == g].max() for g in np.unique(group)])
        members = [lengths[group == g].tolist() for g in np.unique(group)]
        demand = np.array([self.left[m].sum() for m in members], float)
        for copies, used in sorted(configurations(sizes, demand, self.capacity), key=lambda x: -x[1]):
            slots = [g for g in np.flatnonzero(copies) for _ in range(copies[g])]
            todo = int(used + 1e-6)
            while todo:  # as many equal sequences at once as the lengths at hand allow
                picks, taken, room = [], defaultdict(int), self.capacity
                for j, g in enumerate(slots):
                    # the last place takes the longest piece that fits: what rounding up has left over is used here
                    fitting = members[g] if j < len(slots) - 1 else range(room, 0, -1)
                    length = next((x for x in fitting if x <= room and self.left[x] > taken.get(x, 0)), 0)
                    picks.append(length)
                    taken[length] += 1
                    room -= length
                if 0 in taken:
                    break  # this group is used up; best fit takes the rest
                n = min(todo, *(int(self.left[x]) // t for x, t in taken.items()))
                offset = 0
                for length in picks:
                    self.place(length, n, self.sequences, offset)
                    offset += length
                self.room[self.capacity - offset].append((self.sequences, n))
                self.sequences += n
                todo -= n

    def best_fit(self, length: int) -> None:
        """All pieces of one length: into the least room that takes one, each sequence filled before the next."""
        rooms = iter(sorted(r for r in self.room if r >= length and self.room[r]))
        room = next(rooms, None)
        while self.left[length]:
            if room is None:
                each = self.capacity // length
                first, n = self.sequences, -(-int(self.left[length]) // each)
                self.sequences += n
                self.room[self.capacity].append((first, n))
                room, rooms = self.capacity, iter(())
            first, n = self.room[room].pop()
            each = min(room // length, int(self.left[length]))
            use = min(n, int(self.left[length]) // each)
            if use < n:
                self.room[room].append((first + use, n - use))
            for j in range(each):
                self.place(length, use, first, self.capacity - room + j * length)
            self.room[room - each * length].append((first, use))
            while room is not None and not self.room[room]:
                room = next(rooms, None)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the runs, and where each run begins."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 4)
        return (runs[:, 0] << 48) + runs[:, 1], runs[:, 2], runs[:, 3]


# ------------------------------------------------------------------ the tables
@functools.cache
def word_ids(tokenizer: str) -> WordIds:
    """One per Python worker, so that a task finds what earlier ones have encoded."""
    return WordIds(tokenizer)


class WordIds:
    """Token ids of texts from the ids of their words, each word encoded once while it is remembered.

    Right for a tokenizer that drops white space and lets no token span it, as the one of the registered
    query does: the ids of a text are then the ids of its words in order. Words are what ASCII white space
    parts, the empty one before or behind it included, which has no ids.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer)
        self.separator = self.joint([SEPARATOR])
        self.slot: dict[bytes, int] = {}
        self.bounds, self.parts = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, "<u4")  # ids of slot k: parts[bounds[k] : bounds[k + 1]]
        self.again = np.zeros(1 << 16, bool)  # slots met in a later chunk too; these three are grown by doubling

    def joint(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words as one text."""
        text = (b" " + SEPARATOR + b" ").join(words).decode()
        return np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has).

        One text of all words, since a call costs more than a word does. Every separator gives its id; if there are no more
        of these, no word has it and they part the words. Otherwise the words are encoded one by one.
        """
        if len(self.separator) == 1:
            ids = self.joint(words)
            cuts = np.flatnonzero(ids == self.separator[0])
            if len(cuts) == len(words) - 1:
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        each = [e.ids for e in self.encoder.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(itertools.chain.from_iterable(each), "<u4", int(size.sum())), size

    def learn(self, words: list[bytes]) -> None:
        """Give each word, none of them known, the next slot."""
        for at in range(0, len(words), 1000):
            batch = words[at : at + 1000]
            ids, size = self.encoded(batch)
            n, start = len(self.slot), self.bounds[len(self.slot)]
            while n + len(batch) >= len(self.bounds) or start + len(ids) > len(self.parts):
                self.bounds, self.parts, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.bounds, self.parts, self.again))
            self.bounds[n + 1 : n + len(batch) + 1] = start + np.cumsum(size)
            self.parts[start : start + len(ids)] = ids
            self.again[n : n + len(batch)] = False
            self.slot.update(zip(batch, range(n, n + len(batch)), strict=True))

    def forget(self) -> None:
        """Keep the words met again since the last time; if these are over half of what may be remembered, none."""
        kept = np.flatnonzero(self.again[: len(self.slot)])
        if len(kept) > REMEMBERED // 2:
            kept = kept[:0]
        start, size = self.bounds[kept], self.bounds[kept + 1] - self.bounds[kept]
        ids = self.parts[ranges(start, size)]
        self.parts[: len(ids)] = ids
        self.bounds[1 : len(kept) + 1] = np.cumsum(size)
        words = list(itertools.compress(self.slot, self.again)) if len(kept) else []  # slots are numbered in the order of the dict
        self.slot = {}  # the old one goes before the new one is filled
        self.slot.update(zip(words, range(len(kept)), strict=True))
        self.again[:] = False

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none) and the end id, as little-endian unsigned 32-bit numbers."""
        if len(self.slot) > REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        found = split.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()  # bytes, without a scalar for each
        slots = np.fromiter(map(self.slot.get, words, itertools.repeat(-1)), np.int64, len(words))
        self.again[slots[slots >= 0]] = True
        new = np.flatnonzero(slots < 0)
        slots[new] = len(self.slot) + np.arange(len(new))
        self.learn([words[i] for i in new.tolist()])
        at = found.indices.to_numpy()
        start, size = self.bounds[slots][at], (self.bounds[slots + 1] - self.bounds[slots])[at]
        ids = self.parts[ranges(start, size)]
        tokens = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]
        mark = np.array([END_ID], "<u4")
        return [np.append(ids[a:b], mark) for a, b in zip(tokens, tokens[1:])]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): token ids of each text, then an end id, cut at every ``capacity`` tokens.

    ``tokenizer`` is the path of a tokenizers file on every machine (see WordIds for which). A null text is empty: one piece that holds
    the end id. Repeated rows are texts of their own.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [source.schema["doc_id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches):
        memo = word_ids(tokenizer)
        for chunk in text_chunks(batches, "text"):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(memo.encode(chunk.column(1))):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [chunk.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(encode, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity`` tokens, gapless from 0.

    Lengths are 1 to ``capacity``; any other, or null, is an error. The table is written once and read for the
    counts and for the placing, so both see the same rows. Pieces of one length are numbered within hash buckets
    of about ROWS_PER_BUCKET rows, whatever their share of the table. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    for name in ("sequence_id", "offset"):
        if name in pieces.columns:
            raise ValueError(f"column {name!r} exists")
    wrong = F.raise_error(F.concat(F.lit("no length of a piece: "), F.coalesce(F.col(length).cast("string"), F.lit("null"))))
    pieces = written(pieces.withColumn(length, F.when(F.col(length).between(1, capacity), F.col(length)).otherwise(wrong)))
    histogram = pieces.groupBy(length).count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram:
        counts[n] = c
    plan = Plan(counts, capacity, groups)
    sent = spark.sparkContext.broadcast(plan.arrays())

    bucket, first, rank = (free_name(pieces, n) for n in ("_bucket", "_first", "_rank"))
    keys = [length, bucket]
    spread = max(1, -(-int(counts.sum()) // ROWS_PER_BUCKET))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*pieces.columns), F.lit(spread)))
    sums = dealt.groupBy(*keys).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(length).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    firsts = sums.select(*keys, F.coalesce(before, F.lit(0)).alias(first))
    ranked = dealt.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*pieces.columns)) - 1).join(firsts, keys)
    ranked = ranked.select(*pieces.columns, (F.col(first) + F.col(rank)).alias(rank))

    def located(batches):
        word_ids.cache_clear()  # this worker may have encoded; rows are sorted beside it now
        key, sequence, offset = sent.value
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (length, rank))
            run = np.searchsorted(key, (n << 48) + r, "right") - 1
            at = sequence[run] + ((n << 48) + r - key[run])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at), pa.array(offset[run])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(located, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Every text tokenized, cut and placed: see ``pieces`` and ``pack``. Other columns are not read."""
    return pack(pieces(docs, tokenizer, doc_id, text, capacity, keep_ids), capacity, groups)

"""Removal of byte strings that also stand in an earlier document, by a logarithmic family of suffix arrays.

The arrays are sparse: of every ``MATCH`` bytes, the place whose ``GRAM`` bytes hash lowest is an anchor,
so equal strings of that length have an anchor at the same place in them, and only suffixes at anchors
are indexed, sorted by the hash of their first ``GRAM`` bytes. Texts are packed into chunks. A batch of
chunks gets its array, dealt into buckets by hash; it is merge-scanned in one pass over the buckets
against all levels, and levels of equal size merge with it geometrically, as a binary counter does.

A scan tells the chunks which of their anchors stand in another chunk too. These anchors' surroundings
then meet once, by bucket, where every string of ``MATCH`` bytes learns the smallest document it stands in;
each chunk gets back what concerns it and cuts its texts. Whatever repeats inside a chunk, be it a third of
all texts, is sent once per chunk, under the smallest document id.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.arrays import flat, mix, ranges, span_hash, sums, text_chunks
from evalloom.llm.store import written

MATCH, GRAM = 50, 24
CHUNK = 2 << 20  # bytes of text in a chunk
ENTRIES = 1 << 19  # anchors in a bucket, about
BATCHES = 4
LATER = np.int64((1 << 63) - 1)  # stands for a null id: after all others

ROWS = "kind int, bucket int, level int, chunk long, blob binary"


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted 32-bit numbers as planes of bytes, which compress."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.copy()


def unstepped(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view(np.uint32).reshape(-1), dtype=np.uint32)


class Anchors:
    """Anchors of a chunk and the strings each stands for.

    ``at``: place; ``key``: hash of the bytes there; ``low``, ``n``: the first string, and how many, whose anchor it is.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.prefix = sums(data.astype(np.uint64) + np.uint64(1))
        sizes = np.diff(offsets)
        starts = ranges(offsets[:-1], np.maximum(sizes - MATCH + 1, 0))  # of strings that lie in one text
        empty = np.zeros(0, np.int64)
        self.at, self.low, self.n, self.key = empty, empty, empty, np.zeros(0, np.uint64)
        if not len(starts):
            self.doc = empty
            return
        span = MATCH - GRAM + 1
        place = np.arange(len(data) - GRAM + 1)
        least = mix(span_hash(self.prefix, place, place + GRAM))
        where, width = place.astype(np.int32), 1
        while width < span:
            step = min(width, span - width)
            right = least[step:] < least[:-step]  # of equal ones the first
            least = np.where(right, least[step:], least[:-step])
            where = np.where(right, where[step:], where[:-step])
            width += step
        anchor = where[starts].astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
        first = np.flatnonzero(new)
        self.at, self.low, self.n = anchor[first], starts[first], np.diff(np.append(first, len(starts)))
        self.key = least[starts[first]]
        self.doc = np.searchsorted(offsets, self.low, "right") - 1

    def strings(self, which: np.ndarray) -> np.ndarray:
        """Starts of all strings of these anchors."""
        return ranges(self.low[which], self.n[which])

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        return mix(span_hash(self.prefix, starts, starts + MATCH))

    def repeated_here(self) -> np.ndarray:
        """Which anchors have their key at another anchor of the chunk, in whatever text."""
        _, back, n = np.unique(self.key, return_inverse=True, return_counts=True)
        return n[back] > 1


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def groups(sorted_values: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values."""
    return np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values)) if len(sorted_values) else np.zeros(1, np.int64)


# ------------------------------------------------------------------ tasks
def _chunked(limit: int):
    def chunked(batches):
        for batch in text_chunks(batches, "text", limit):
            data, offsets = flat(batch.column(1))
            ids = batch.column(0).fill_null(int(LATER)).to_numpy().astype(np.int64)
            null = np.asarray(batch.column(0).is_null())
            yield pa.RecordBatch.from_arrays([pa.array([packed(ids, null, offsets)], pa.binary()), pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary()), pa.array([len(data)])], names=["ids", "data", "size"])

    return chunked


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, Anchors]:
    ids, null, offsets = unpacked(row["ids"])
    return ids, null, Anchors(np.frombuffer(zstandard.decompress(row["data"]), np.uint8), offsets)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "bucket", "level", "chunk", "blob"])


def _arrays_of(buckets: int):
    def arrays(batches):
        """A chunk's suffix array: its distinct keys in order, a row per bucket."""
        for batch in batches:
            for row in batch.to_pylist():
                key = np.unique(_opened(row)[2].key)
                order = np.lexsort((key & np.uint64(0xFFFFFFFF), bucket_of(key, buckets)))
                bucket, low = bucket_of(key, buckets)[order], (key & np.uint64(0xFFFFFFFF))[order]
                cuts = groups(bucket)
                yield _batch([(0, bucket[a], -1, row["chunk"], packed(steps(low[a:b]))) for a, b in zip(cuts, cuts[1:])])

    return arrays


def _scanned(merged: int, keep: bool):
    def scanned(group: pa.Table) -> pa.Table:
        """Merge-scan of one bucket: a new batch (level -1) and all levels. Kind 1: keys of a chunk that another chunk
        has; kind 2: the new level ``merged``, where a key keeps its chunk until that has been told."""
        key, owner, level = [], [], []
        for row in group.to_pylist():
            planes, *owners = unpacked(row["blob"])
            key.append(unstepped(planes))
            owner.append(owners[0] if owners else np.full(len(key[-1]), row["chunk"]))
            level.append(np.full(len(key[-1]), row["level"]))
        key, owner, level = map(np.concatenate, (key, owner, level))
        order = np.argsort(key, kind="stable")
        key, owner, level = key[order], owner[order], level[order]
        cuts = groups(key)
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        bucket, rows = group.column("bucket")[0].as_py(), []
        told = np.flatnonzero((size > 1) & (owner >= 0))
        told = told[np.argsort(owner[told], kind="stable")]
        edges = groups(owner[told])
        rows += [(1, bucket, -1, owner[told[a]], packed(steps(key[told[a:b]]))) for a, b in zip(edges, edges[1:])]
        if keep:
            own = level < merged
            key, owner = key[own], np.where(size > 1, -1, owner)[own]
            first = groups(key)[:-1]
            rows.append((2, bucket, merged, -1, packed(steps(key[first]), owner[first])))
        return pa.Table.from_batches([_batch(rows)])

    return scanned


def _surroundings(buckets: int):
    def surroundings(chunk: pa.Table, shared: pa.Table) -> pa.Table:
        """The bytes around a chunk's shared anchors, equal ones once under the smallest id, a row per bucket."""
        rows = []
        for row in chunk.to_pylist():
            ids, _, a = _opened(row)
            by_bucket: dict[int, list] = {}
            for told in shared.to_pylist():
                by_bucket.setdefault(told["bucket"], []).append(unstepped(unpacked(told["blob"])[0]))
            bucket, low = bucket_of(a.key, buckets), a.key & np.uint64(0xFFFFFFFF)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < 1 << 16 else None
            for b, told in by_bucket.items():
                own = order[cuts[b] : cuts[b + 1]] if cuts is not None else np.flatnonzero(bucket == b)
                wanted = own[np.isin(low[own], np.unique(np.concatenate(told)).astype(np.uint64))]
                if not len(wanted):
                    continue
                whole = mix(span_hash(a.prefix, a.low[wanted], a.low[wanted] + a.n[wanted] + MATCH - 1) + a.n[wanted].astype(np.uint64))
                by = np.lexsort((ids[a.doc[wanted]], whole))
                pick = wanted[by[groups(whole[by])[:-1]]]
                pick = pick[np.argsort(a.key[pick], kind="stable")]
                rows.append((3, b, -1, row["chunk"], packed(a.low[pick].astype(np.uint32), a.n[pick].astype(np.uint8), ids[a.doc[pick]], a.data[ranges(a.low[pick], a.n[pick] + MATCH - 1)])))
        return pa.Table.from_batches([_batch(rows)])

    return surroundings


def _judged(group: pa.Table) -> pa.Table:
    """Runs of a chunk's strings that stand in a document with a smaller id in another chunk, with that id."""
    low, n, doc, data, chunk = [], [], [], [], []
    for row in group.select(["chunk", "blob"]).to_pylist():
        parts = unpacked(row["blob"])
        for into, x in zip((low, n, doc, data), parts, strict=True):
            into.append(x)
        chunk.append(np.full(len(parts[0]), row["chunk"]))
    low, n, doc, data, chunk = map(np.concatenate, (low, n, doc, data, chunk))
    n, low = n.astype(np.int64), low.astype(np.int64)
    sizes = n + MATCH - 1
    starts = np.cumsum(sizes) - sizes
    at, entry = ranges(starts, n), np.repeat(np.arange(len(n)), n)
    h = mix(span_hash(sums(data.astype(np.uint64) + np.uint64(1)), at, at + MATCH))
    _, back = np.unique(h, return_inverse=True)
    least = np.full(back.max(initial=-1) + 1, LATER)
    np.minimum.at(least, back, doc[entry])
    earlier = least[back]
    hit = np.flatnonzero(earlier < doc[entry])
    rows = []
    if len(hit):
        place = low[entry[hit]] + at[hit] - starts[entry[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (entry[hit][1:] != entry[hit][:-1]) | (earlier[hit][1:] != earlier[hit][:-1])
        first = np.flatnonzero(new)
        owner, place, length, who = chunk[entry[hit]][first], place[first], np.diff(np.append(first, len(hit))), earlier[hit][first]
        order = np.argsort(owner, kind="stable")
        cuts = groups(owner[order])
        rows = [(4, 0, -1, owner[order[a]], packed(*(x[order[a:b]] for x in (place.astype(np.uint32), length.astype(np.uint8), who)))) for a, b in zip(cuts, cuts[1:])]
    return pa.Table.from_batches([_batch(rows)])


def _cut(id_type: pa.DataType, keep_bytes: bool):
    def cut(chunk: pa.Table, judged: pa.Table) -> pa.Table:
        """Per text: bytes covered by a string of a smaller document, in this chunk or in others."""
        out = {n: [] for n in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for row in chunk.to_pylist():
            ids, null, a = _opened(row)
            own = a.strings(np.flatnonzero(a.repeated_here()))
            runs = [unpacked(x) for x in judged.column("blob").to_pylist()]
            place, length, who = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3
            told = ranges(place.astype(np.int64), length.astype(np.int64))
            starts = np.concatenate([own, told])
            doc = ids[np.searchsorted(a.offsets, starts, "right") - 1]
            _, back = np.unique(a.hashes(starts), return_inverse=True)
            least = np.full(back.max(initial=-1) + 1, LATER)
            np.minimum.at(least, back, np.concatenate([doc[: len(own)], np.repeat(who, length.astype(np.int64))]))
            gone = np.unique(starts[least[back] < doc])
            cover = np.zeros(len(a.data) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + MATCH, -1)
            lost = np.cumsum(cover[:-1]) > 0
            for k in range(len(ids)):
                part = slice(a.offsets[k], a.offsets[k + 1])
                mine = lost[part]
                kept = a.data[part][~mine].tobytes()
                out["id"].append(None if null[k] else int(ids[k]))
                out["n_bytes"].append(len(mine))
                out["n_removed"].append(int(mine.sum()))
                out["n_spans"].append(int((np.diff(mine.astype(np.int8), prepend=0) == 1).sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
        if not keep_bytes:
            out.pop("kept")
        kinds = {"id": id_type, "kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    return cut


# ------------------------------------------------------------------ the family
class Family:
    """Levels of 1, 2, 4, ... batches of chunks, each a table of buckets of sorted keys."""

    def __init__(self, buckets: int):
        self.buckets, self.levels, self.told = buckets, {}, []

    def add(self, chunks: DataFrame, keep: bool = True) -> DataFrame:
        """Scan a batch against all levels and take it in (``keep``): rows of shared keys of new and of older chunks."""
        merged = 0
        while merged in self.levels:
            merged += 1
        rows = chunks.mapInArrow(_arrays_of(self.buckets), ROWS)
        for table in self.levels.values():
            rows = rows.unionByName(table)
        found = written(rows.groupBy("bucket").applyInArrow(_scanned(merged, keep), ROWS))
        if keep:
            self.levels = {k: v for k, v in self.levels.items() if k > merged} | {merged: found.where("kind = 2")}
        self.told.append(found.where("kind = 1"))
        return self.told[-1]


def remove_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, keep_bytes: bool = True, chunk_bytes: int = CHUNK, entries: int = ENTRIES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, the kept bytes.

    A byte of a text, as UTF-8, is removed if a string of MATCH bytes that covers it also starts in a document with
    a smaller id, judged on the input. ``doc_id`` is of a whole-number type. Kept bytes can begin or end inside a
    character, so they are binary.

    Defined results: a null text is empty; texts under MATCH bytes lose nothing; documents with a null id come after
    all others and not before each other; rows that share an id do not remove from each other; an empty table gives
    no rows. Other columns are not read.

    A chunk, and a bucket's share of anchors, is what a task holds; a byte string of GRAM bytes with ever different
    surroundings brings each of these once per chunk to its bucket.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    chunks = written(source.mapInArrow(_chunked(chunk_bytes), "ids binary, data binary, size long").withColumn("chunk", F.monotonically_increasing_id()))
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    family = Family(max(8, -(-int(size) * 2 // (MATCH - GRAM + 2) // entries)))
    for k in range(batches):
        family.add(chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == k), keep=k < batches - 1)
    told = family.told[0]
    for more in family.told[1:]:
        told = told.unionByName(more)
    near = lambda rows: rows.select("kind", "bucket", "level", F.col("chunk").alias("of"), "blob")
    around = chunks.groupBy("chunk").cogroup(near(told).groupBy("of")).applyInArrow(_surroundings(family.buckets), ROWS)
    judged = around.groupBy("bucket").applyInArrow(_judged, ROWS)
    id_type = docs.schema[doc_id].dataType
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]
    kinds = {"id": "long", "kept_sha256": "string", "kept": "binary"}
    cut = chunks.groupBy("chunk").cogroup(near(judged).groupBy("of")).applyInArrow(_cut(pa.int64(), keep_bytes), ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))
    return cut.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", doc_id)

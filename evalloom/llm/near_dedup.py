"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts become sets of word shingles; equal sets are one class, so exact copies cost one signature.
2. Signatures are cut into bands; classes that agree on a band share a bucket.
3. Buckets name candidates in turns, over ever more bands. In each turn a class proposes itself once: to a member
   of the largest component of a bucket that it shares with other components. That joins large groups in linear work,
   and what is left to propose shrinks with it. What is left at the end in buckets of several components, after sets
   that shingles held by their own component alone rule out, is compared block by block inside tasks, each pair in
   the first band it shares; tasks put out links only. No link is lost and no group gives all its pairs.
4. Candidates compare their signatures batch by batch. After each batch the posterior chance that
   the similarity reaches the threshold, given the matches so far and a uniform prior, decides:
   pairs below the chosen miss probability are dropped.
5. Survivors are confirmed on their full sets, read from the texts again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.arrays import SPACED, Words, mix, text_chunks
from evalloom.llm.components import merged
from evalloom.llm.store import Scratch, free_name, written

BANDS, ROWS = 32, 5  # misses a pair at similarity 0.8 with chance (1 - 0.8 ** 5) ** 32 = 3e-6
BATCH = 32  # hashes compared between two decisions
MISS = 1e-7
BROADCAST_NODES = 200_000
BLOCK = 1024  # nodes of a bucket that a task compares with as many others, fewer if their sets are large
VOLUME = 1 << 20  # shingles of a block, 8 bytes each
#: Bands of the turns; what is left in the buckets of all bands is compared after them.
TURNS = (range(0, 2), range(2, 8))

_random = np.random.default_rng(20)
_XOR = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingles, document of each) of a chunk; a text of fewer words is one shingle."""
    h, at = words.runs(k)
    doc = words.doc[at]
    counts = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        whole = np.full(len(short), n, np.uint64)
        for j in range(n):
            whole = mix(whole) + words.hash[words.first[short] + j]
        h, doc = np.concatenate([h, mix(whole)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def prints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit fingerprint of each set, 16 bytes a row."""
    return np.stack([np.add.reduceat(mix(h ^ np.uint64(salt)), first) for salt in (1, 0x5851F42D4C957F2D)], axis=1)


def fixed(values: np.ndarray) -> pa.Array:
    """Rows of a 2-D array as binary values."""
    rows, width = values.shape[0], values[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(values))])


def _signed(k: int):
    def signed(batches):
        for chunk in text_chunks(batches, "text"):
            words = Words(chunk.column(1), SPACED)
            h, doc = shingles(words, k)
            full, first, counts = np.unique(doc, return_index=True, return_counts=True)
            n = np.zeros(chunk.num_rows, np.int64)
            n[full] = counts
            pick = np.full(chunk.num_rows, -1)
            pick[full] = np.arange(len(full))
            index = pa.array(pick, pa.int64(), mask=pick < 0)
            if len(full):
                low = (h >> np.uint64(32)).astype(np.uint32)
                signature = np.empty((len(full), BANDS * ROWS), np.uint32)
                for j in range(BANDS * ROWS):
                    mixed = (low ^ _XOR[j]) * _ODD[j]
                    mixed ^= mixed >> np.uint32(15)
                    signature[:, j] = np.minimum.reduceat(mixed * np.uint32(0x2C1B3C6D), first)
                kept = [fixed(prints(h, first)), fixed(signature)]
            else:
                kept = [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(n), *(x.take(index) for x in kept)], names=["id", "n", "print", "signature"])

    return signed


def _banded(bands: range):
    def banded(batches):
        """(key, node, part): a row per band; the key holds its values, its last bits the band."""
        of = np.arange(bands.start, bands.stop, dtype=np.uint64)
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)[:, bands.start : bands.stop]
            keys = (of + np.uint64(1)) * np.ones((len(values), 1), np.uint64)
            for j in range(ROWS):
                keys = mix(keys) + values[:, :, j]
            keys = mix(keys) & ~np.uint64(BANDS - 1) | of
            again = pa.array(np.repeat(np.arange(len(values)), len(bands)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64).reshape(-1)), batch.column(0).take(again), batch.column(1).take(again)], names=["key", "node", "part"])

    return banded


def fewest_matches(threshold: float, miss: float) -> list[int]:
    """For 1, 2, ... batches: the least number of equal hashes with which P(similarity >= threshold) is at least ``miss``.

    With a uniform prior the posterior is a beta distribution, so that chance is the one that a binomial
    variable of n + 1 draws at ``threshold`` does not exceed the matches.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _likely(least: list[int]):
    def likely(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            live, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[live] += (a[live, part] == b[live, part]).sum(axis=1)
                live = live[matches[live] >= m]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live)), pa.array(matches[live].astype(np.int32))], names=["a", "b", "matches"])

    return likely


def _sets(k: int):
    def sets(batches):
        """(node, set) of (node, print, text) rows; rows that share an id with another text are dropped by their print."""
        for chunk in text_chunks(batches, "text"):
            h, doc = shingles(Words(chunk.column(2), SPACED), k)
            full, first = np.unique(doc, return_index=True)
            if not len(full):
                continue
            own, ends = prints(h, first), np.append(first[1:], len(h))
            asked, nodes = chunk.column(1).to_pylist(), chunk.column(0).to_pylist()
            right = [j for j, row in enumerate(full) if own[j].tobytes() == asked[row]]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[full[j]] for j in right], pa.int64()), pa.array([h[first[j] : ends[j]].tobytes() for j in right], pa.binary())], names=["node", "set"])

    return sets


def _confirmed(percent: int):
    def confirmed(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(keep, pa.int64())) for j in (0, 1)], names=["a", "b"])

    return confirmed


def _narrowed(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """``values`` of the written ``nodes``: before any shuffle if the nodes are few (8 bytes each), else by a join."""
    few = nodes.count() <= BROADCAST_NODES
    return values.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def _paired(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both nodes; a node in very many pairs is split by the skew join."""
    left = values.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _pairs(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _open(banded: DataFrame) -> DataFrame:
    """Buckets with members of several components: key, the largest component in it and one of its members, rows, pairs across.

    Buckets of other bands with the same members are left out: their pairs meet in the smallest such band.
    """
    draw = F.xxhash64("node")
    parts = banded.groupBy("key", "part").agg(F.count("*").alias("n"), F.min_by("node", draw).alias("c"), F.sum(F.pmod(draw, F.lit(1 << 40))).alias("print"))
    size = F.col("n") * (1 << 20) + F.pmod(F.xxhash64("part"), F.lit(1 << 20))
    whole = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("c", size).alias("c"), F.max_by("part", size).alias("other"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.sum("print").alias("print"))
    split = whole.where("parts > 1")
    band = F.pmod("key", F.lit(BANDS))
    first = split.groupBy("print", "n").agg(F.min_by("key", band).alias("key")).select("key")
    return split.join(first, "key", "left_semi").select("key", "c", "other", "n", "own")


def _elsewhere(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, rest): how many of a set's shingles another component holds too."""

    def members(batches):
        for batch in batches:
            for node, part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = np.frombuffer(held.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), node)), pa.array(np.full(len(h), part))], names=["h", "node", "part"])

    parts = sets.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "set")
    held = parts.mapInArrow(members, "h long, node long, part long")
    shared = held.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("h")
    return held.join(shared, "h").groupBy("node").agg(F.count("*").alias("rest"))


def _across(parts: DataFrame, rest: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(key, low, high, node, part, block, n): what is left of the buckets, each cut into blocks of about BLOCK nodes and VOLUME shingles at most, for every pair of blocks.

    The intersection of two sets of different components is at most the smaller ``rest``; sets for which this rules
    out every partner are left out.
    """
    bound = sizes.join(rest, "node").where(100 * F.col("rest") >= percent * F.col("n"))
    known = parts.join(bound, "node").select("key", "node", "part", "n")
    blocks = known.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / VOLUME)).cast("int").alias("blocks"), F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").drop("x", "y")
    placed = known.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "part", "block", "n")


def _judged(least: list[int], percent: int):
    def judged(group: pa.Table) -> pa.Table:
        """Links between the nodes of two blocks that are in different components and in no earlier band together: by size, by signatures batch by batch, then on the sets."""
        band = group.column("key")[0].as_py() % BANDS
        node, part, block, n = (group.column(c).to_numpy() for c in ("node", "part", "block", "n"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        right = np.flatnonzero(block == high)
        a, b = [], []
        for i in np.flatnonzero(block == low):
            live = right[(part[right] != part[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            live = live[live > i] if low == high else live
            matches = np.zeros(len(node), np.int64)
            for k, m in enumerate(least):
                columns = slice(k * BATCH, (k + 1) * BATCH)
                matches[live] += (signature[live, columns] == signature[i, columns]).sum(axis=1)
                live = live[matches[live] >= m]
            if len(live):
                earlier = (signature[live, : band * ROWS] == signature[i, : band * ROWS]).reshape(len(live), band, ROWS).all(axis=2).any(axis=1)
                live = live[~earlier]
            for j in live:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (n[i] + n[j] - shared):
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return judged


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are maximal runs without white space, A-Z in lower case. A text's set holds its distinct shingles
    of ``words`` words, or its whole word sequence when it has fewer; texts are linked when
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable over links,
    ``kept`` marks the row with that id.

    Defined results: a null, empty or blank text has 0 shingles, is linked with nothing and is its own
    component; a row with a null id is linked with nothing, has a null component and is kept; rows that
    repeat an id and text all carry the same component and are all kept if the id is; an empty table
    gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    rows = written(source.mapInArrow(_signed(words), f"id {id_type}, n long, print binary, signature binary"))
    named = rows.where("id is not null and n > 0")
    classes = named.groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    least = fewest_matches(percent / 100, miss)

    sizes = classes.select("node", "n")
    both = F.explode(F.array("a", "b")).alias("node")

    signed = classes.select("node", "signature")
    results = Scratch()

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return signed.select("node", F.col("node").alias("part"), "signature")
        held = F.broadcast(labels) if labels.count() <= BROADCAST_NODES else labels  # 16 bytes a node
        return signed.join(held, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "signature")

    def members(bands: range, labels: DataFrame | None, here: Scratch) -> DataFrame:
        """(key, node, part, c, other) of the buckets of ``bands`` that hold several components."""
        banded = labelled(labels).mapInArrow(_banded(bands), "key long, node long, part long")
        found = here.written(_open(banded))
        return banded.join(F.broadcast(found) if found.count() <= BROADCAST_NODES else found, "key")

    def proposed(bands: range, labels: DataFrame | None, here: Scratch) -> DataFrame:
        """(a, b): each class outside its bucket's largest component with a member of that, one bucket a class."""
        banded = labelled(labels).mapInArrow(_banded(bands), "key long, node long, part long")
        found = here.written(_open(banded)).select(F.col("key").alias("k"), "c", "other")
        found = F.broadcast(found) if found.count() <= BROADCAST_NODES else found
        outside = banded.join(found, (F.col("key") == F.col("k")) & (F.col("part") != F.col("other")))
        return outside.groupBy("node").agg(F.min_by("c", "key").alias("c")).select(*_pairs("node", "c")).distinct()

    def sets_of(nodes: DataFrame, here: Scratch) -> DataFrame:
        wanted = here.written(_narrowed(classes.select("node", "id", "print"), here.written(nodes)))
        if wanted.count() <= BROADCAST_NODES:
            wanted = F.broadcast(wanted)  # 32 bytes and an id each: the texts then need no shuffle
        return here.written(source.join(wanted, "id").select("node", "print", "text").mapInArrow(_sets(words), "node long, set binary").dropDuplicates(["node"]))

    def links(pairs: DataFrame, here: Scratch) -> DataFrame:
        fits = here.written(_paired(pairs, sizes, "n").where(F.least("x", "y") * 100 >= F.greatest("x", "y") * percent).select("a", "b"))
        signatures = _narrowed(signed, here.written(fits.select(both).distinct()))
        likely = here.written(_paired(fits, signatures, "signature").mapInArrow(_likely(least), "a long, b long, matches int"))
        sets = sets_of(likely.select(both).distinct(), here)
        return results.written(_paired(likely.select("a", "b"), sets, "set").mapInArrow(_confirmed(percent), "a long, b long"))

    def across(parts: DataFrame, labels: DataFrame | None, here: Scratch) -> DataFrame:
        """Links in what is left: rows of buckets that still hold several components."""
        nodes = here.written(parts.select("node").distinct())
        sets = sets_of(nodes, here)
        known = labels if labels is not None else nodes.select("node", F.col("node").alias("component"))
        blocks = _across(parts, _elsewhere(sets, known), sizes, percent)
        whole = blocks.join(here.written(_narrowed(signed, nodes).join(sets, "node")), "node")  # one row a node, fetched once for all its blocks
        return results.written(whole.groupBy("key", "low", "high").applyInArrow(_judged(least, percent), "a long, b long").distinct())

    labels = None

    def add(new: DataFrame) -> None:
        nonlocal labels
        if not new.isEmpty():
            labels = merged(labels, new)
            results.tables.append(labels)

    for bands in TURNS:
        here = Scratch()
        add(links(proposed(bands, labels, here), here))
        here.clear()
    here = Scratch()
    parts = here.written(members(range(BANDS), labels, here).select("key", "node", "part"))
    if not parts.isEmpty():
        add(across(parts, labels, here))
    here.clear()

    labels = labels if labels is not None else classes.select("node", F.col("node").alias("component"))
    placed = classes.join(labels, "node", "left").select("print", "id", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    placed = written(placed.join(names, "component").select("print", "component_id"))
    results.clear()
    linked = named.drop("signature").join(placed, "print").select("id", "n", "component_id")
    alone = rows.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every group of near-duplicates, columns as they were.

    Rows of one id and different texts are judged by the id: they go only if none of them is kept.
    Of fully repeated rows all stay if one does.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    name = free_name(docs, "_dropped")
    dropped = found.groupBy(F.col(doc_id).alias(name)).agg(F.max("kept").alias("k")).where("not k").select(name)
    return docs.join(dropped, docs[doc_id] == dropped[name], "left_anti")

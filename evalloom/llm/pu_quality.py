"""Text quality from trusted good texts and unlabelled ones: positive-unlabelled learning with the non-negative unbiased risk.

Only some texts are known to be good; all others may be either. With z the linear score of a text, l the logistic loss
and p the share of good texts, the risk of a classifier is p E_good[l(z)] + (E_all[l(-z)] - p E_good[l(-z)]). The second
part estimates the loss on bad texts, so it can't be negative: a step that makes it so fits single good texts, and is
shortened until it no longer does. p itself is estimated first. A classifier of good against all texts ranks them; at a cut
above which nearly no bad text lies, the share of all texts above it over that of good ones is p. Cuts with few texts
above them are held back by their confidence bounds (best bin estimation), on texts this classifier has not learnt from.

A text is described by some forty shares and means of its bytes, words and lines. These are written once; every later
step reads only them, is a sum over all texts, and adds up small matrices by row number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.arrays import BASE, SPACED, flat, mix, span_hash, sums, text_chunks
from evalloom.llm.matrices import row_sums
from evalloom.llm.store import removed, written

#: Bytes by class; what is in none of them is the rest.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"#*$%&|<>", b"!", b"?", b".", b",", b";:", b"\"'`", b"()[]{}", b"-_=/\\@+~^", bytes(range(9)) + bytes(range(11, 32)), bytes(range(0xC0, 0x100))]
CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES):
    CLASS[list(_bytes)] = _k
UPPER, LOWER, DIGIT, SYMBOL, MARK = 0, 1, 2, 5, 6
STEPS = (1.0, 0.25, 0.0625)  # shares of a Newton step tried at once
RIDGE = 30.0  # over the number of texts: its share of the risk falls as texts are added
BINS = 2048


# ------------------------------------------------------------ texts as numbers
def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``first`` bounds."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _copies(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is an earlier one equal in the same text, how many equal ones the text has) for each key."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    _, where, number, counts = np.unique(mix(keys + doc.astype(np.uint64) * BASE), return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(len(keys), bool)
    again[where] = False
    return again, counts[number]


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text; an empty text has zeros."""
    data, offsets = flat(texts)
    n_docs = len(offsets) - 1
    n_bytes = np.diff(offsets).astype(np.float64)
    kind = CLASS[data]
    per_byte = np.maximum(n_bytes, 1)
    byte_doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    shares = np.bincount(byte_doc * (len(CLASSES) + 1) + kind, minlength=n_docs * (len(CLASSES) + 1)).reshape(n_docs, -1) / per_byte[:, None]

    word = SPACED[data]
    edge = np.zeros(len(word) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    n_words = np.diff(first).astype(np.float64)
    per_word = np.maximum(n_words, 1)
    size = (ends - starts).astype(np.float64)

    def inside(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int32)
        np.cumsum(flag, out=total[1:])
        return total[ends] - total[starts]

    upper, lower, digits, symbols, marks = (inside(kind == k) for k in (UPPER, LOWER, DIGIT, SYMBOL, MARK))
    hashes = mix(span_hash(sums(data.astype(np.uint64) + np.uint64(1)), starts, ends) + (ends - starts).astype(np.uint64) * BASE)
    again, copies = _copies(hashes, doc)
    near = [np.append(np.zeros(min(d, len(doc)), bool), (hashes[d:] == hashes[:-d]) & (doc[d:] == doc[:-d])) for d in (1, 2)]
    n = max(len(hashes) - 2, 0)
    whole = doc[:n] == doc[2:]
    repeated = np.zeros(len(hashes), bool)
    repeated[:n] = whole & (_copies((hashes[:n] * BASE + hashes[1 : n + 1]) * BASE + hashes[2:], doc[:n])[1] > 1)
    most = np.zeros(n_docs)
    np.maximum.at(most, doc, copies)

    breaks = np.flatnonzero((data == 10) & ~edge[1:])
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    bounds = np.append(line_starts[1:], offsets[-1]) - np.append(line_doc[:-1] == line_doc[1:], False)
    per_line = np.searchsorted(starts, line_starts), np.searchsorted(starts, bounds)
    full = per_line[1] > per_line[0]
    line_hash = span_hash(sums(hashes), *per_line)
    same, _ = _copies(line_hash[full], line_doc[full])
    n_lines = np.maximum(np.bincount(line_doc[full], minlength=n_docs), 1)
    share = lambda flag: _per_doc(flag, first) / per_word
    return np.column_stack([
        shares, np.log1p(n_words), np.log1p(n_bytes), share(size) / 8, np.sqrt(share(size * size)) / 8, share(size > 24), share(size == 1), share((upper > 0) & (lower == 0)), share((upper > 0) & (lower > 0)),
        share(digits > 0), share(symbols > 0), share(marks > 0), share(again), share(near[0]), share(near[1]), share(repeated), most / per_word, np.sqrt(most) / np.sqrt(per_word),
        share(again) * np.log1p(n_words), np.bincount(line_doc[full], weights=same, minlength=n_docs) / n_lines, np.log1p(n_lines), np.log1p(n_words / n_lines),
    ]).astype(np.float32)


N_FEATURES = len(CLASSES) + 1 + 21


def _described(batches):
    for batch in batches:
        for chunk in text_chunks([batch], "text"):
            rows = features(chunk.column(2))
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "learn", "x"])


class Scale:
    """Features less their means over their deviations, cut at 4, with their squares and a one."""

    def __init__(self, means: np.ndarray, deviations: np.ndarray):
        self.means, self.deviations = means, np.where(deviations > 1e-6, deviations, np.inf)

    def __call__(self, column: pa.Array) -> np.ndarray:
        x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES)
        z = np.clip((x - self.means) / self.deviations, -4, 4)
        return np.column_stack([z, z * z, np.ones(len(z))])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


# ------------------------------------------------------------ sums over all texts
def _moments(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def moments(batches):
        total = np.zeros((3, N_FEATURES))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            total += [np.full(N_FEATURES, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    n, s, q = row_sums(table.select("x").mapInArrow(moments, "i int, row binary"), 3, N_FEATURES)
    n = np.maximum(n, 1)
    return s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))


class Sums:
    """Sums at one weight vector over good (0) and all (1) texts: count, l(z), l(-z), features, gradient and Hessian of l(-z)."""

    def __init__(self, block: np.ndarray, size: int):
        parts = block.reshape(2, size + 3, size)
        self.n = np.maximum(parts[:, 0, 0], 1)
        self.loss, self.other = parts[:, 0, 1] / self.n, parts[:, 0, 2] / self.n
        self.mean, self.slope = parts[:, 1] / self.n[:, None], parts[:, 2] / self.n[:, None]
        self.bend = parts[:, 3:] / self.n[:, None, None]


def _at(table: DataFrame, scale: Scale, weights: np.ndarray) -> list[Sums]:
    size = weights.shape[1]

    def at(batches):
        total = np.zeros((len(weights), 2, size + 3, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, good = scale(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for w, out in zip(weights, total, strict=True):
                for rows, part in ((x[good], out[0]), (x, out[1])):
                    z = rows @ w
                    s = _sigmoid(z)
                    part[0, :3] += [len(z), _softplus(-z).sum(), _softplus(z).sum()]
                    part[1] += rows.sum(axis=0)
                    part[2] += s @ rows
                    part[3:] += (rows * (s * (1 - s))[:, None]).T @ rows
        flat_rows = total.reshape(-1, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat_rows)), pa.int32()), pa.array([r.tobytes() for r in flat_rows], pa.binary())], names=["i", "row"])

    n_rows = len(weights) * 2 * (size + 3)
    found = row_sums(table.select("trusted", "x").mapInArrow(at, "i int, row binary"), n_rows, size).reshape(len(weights), -1)
    return [Sums(block, size) for block in found]


def _minimised(table: DataFrame, scale: Scale, start: np.ndarray, objective, allowed, rounds: int) -> np.ndarray:
    """Newton's method: ``objective(sums)`` gives (value, gradient, Hessian); of the shortened steps the best ``allowed`` one is taken."""
    w, here = start, _at(table, scale, start[None])[0]
    ridge = np.full(len(w), RIDGE / here.n.sum())
    ridge[-1] = 0.0
    for _ in range(rounds):
        value, gradient, bend = objective(here)
        value += ridge @ (w * w) / 2
        step = -np.linalg.lstsq(bend + np.diag(ridge + 1e-9), gradient + ridge * w, rcond=None)[0]
        tried = w + np.outer(STEPS, step)
        found = _at(table, scale, tried)
        values = [objective(s)[0] + ridge @ (t * t) / 2 if allowed(s) else math.inf for s, t in zip(found, tried, strict=True)]
        best = int(np.argmin(values))
        if not values[best] < value - 1e-7:
            break
        w, here = tried[best], found[best]
    return w


def _against_all(s: Sums):
    """Loss of good against all texts, both weighted alike."""
    return (s.loss[0] + s.other[1]) / 2, (s.slope[0] - s.mean[0] + s.slope[1]) / 2, (s.bend[0] + s.bend[1]) / 2


def _unbiased(prior: float):
    def objective(s: Sums):
        """l(z) - l(-z) = -z, so the two parts over good texts are one."""
        value = prior * s.loss[0] + max(0.0, s.other[1] - prior * s.other[0])
        return value, s.slope[1] - prior * s.mean[0], s.bend[1]

    return objective


def class_prior(good: np.ndarray, every: np.ndarray, delta: float = 0.1, weight: float = 2.0) -> float:
    """Share of good texts among all, from histograms of a score (best texts last) over good and over all.

    Cuts are compared by the share they give plus ``weight`` times the width of its ``1 - delta`` confidence bound.
    """
    n = good.sum(), every.sum()
    if not all(n):
        return 0.5
    above = [np.cumsum(h[::-1]) / m for h, m in zip((good, every), n, strict=True)]
    reached = above[0] > 0
    slack = weight * sum(math.sqrt(math.log(4 / delta) / (2 * m)) for m in n)
    share = above[1][reached] / above[0][reached]
    return float(np.clip(share[np.argmin(share + slack / above[0][reached])], 0.01, 1.0))


def _histograms(table: DataFrame, scale: Scale, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def counted(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            if batch.num_rows:
                good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                place = np.minimum((_sigmoid(scale(batch.column(1)) @ w) * BINS).astype(np.int64), BINS - 1)
                total += [np.bincount(place[good], minlength=BINS), np.bincount(place, minlength=BINS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    return tuple(row_sums(table.select("trusted", "x").mapInArrow(counted, "i int, row binary"), 2, BINS))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rounds: int = 12) -> DataFrame:
    """One row per row of ``docs``: id, learn, score (0 to 1, higher for good texts), prior.

    Trusted are the rows for which ``learn`` holds and whose ``label`` is 1 in each row that ``labels`` has for their id.
    Rows for which ``learn`` doesn't hold are scored only, so held-out texts teach nothing. No row is left out of a sum
    and none is sampled. ``prior`` is the estimated share of good texts.

    Defined results: a null ``learn`` doesn't hold; a null, empty or blank text is described by zeros and scored; a null label
    is none, ids without a row in ``docs`` teach nothing; repeated rows of ``docs`` count and are scored each; a row with a null
    id is never trusted; without trusted texts the prior is a half and only the unlabelled texts shape the scores; an empty table
    gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    good = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = 1 and high = 1").select("id", F.lit(True).alias("trusted"))
    described = source.mapInArrow(_described, f"id {kind}, learn boolean, x binary")
    table = written(described.join(good, "id", "left").select("id", "learn", (F.col("learn") & F.coalesce("trusted", F.lit(False))).alias("trusted"), "x"))

    known = table.where("learn")
    ranked = F.pmod(F.xxhash64("x"), F.lit(4)) == 0  # copies of a text fall on the same side
    scale = Scale(*_moments(known))
    start = np.zeros(2 * N_FEATURES + 1)
    w = _minimised(known.where(~ranked), scale, start, _against_all, lambda s: True, rounds)
    prior = class_prior(*_histograms(known.where(ranked), scale, w))
    start[-1] = math.log(prior / (1.001 - prior))
    w = _minimised(known, scale, start, _unbiased(prior), lambda s: s.other[1] >= prior * s.other[0], rounds)

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                found = _sigmoid(scale(batch.column(2)) @ w)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(np.full(len(found), prior))], names=["id", "learn", "score", "prior"])

    return table.select("id", "learn", "x").mapInArrow(scored, f"id {kind}, learn boolean, score double, prior double").withColumnRenamed("id", doc_id)

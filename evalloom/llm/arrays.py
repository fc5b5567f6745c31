"""Whole texts as flat NumPy arrays inside Arrow tasks: bytes, words and hashes of both.

A chunk of documents is one byte array with document offsets, so a pass over it is a few
vector operations however many documents it holds, and no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: ASCII letters A-Z in lower case; all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64, for exponents below ``n``."""
    if len(_powers["up"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, factor in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, factor)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values`` weighted by powers of BASE: the hash of a span is a difference of two."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), equal for equal spans wherever they stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``counts`` numbers each, after one another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def text_chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` text bytes each; a longer text stands alone, whole."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another, and where each text starts (one more at the end). Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a chunk: ``hash``, ``starts``, ``ends`` (bytes), ``doc`` (row in the chunk), ``first`` (per row, one more at the end)."""

    def __init__(self, texts: pa.Array, inside: np.ndarray):
        data, offsets = flat(texts)
        self.data, self.offsets = LOWER[data], offsets
        word = inside[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets)
        prefix = sums(self.data.astype(np.uint64) + np.uint64(1))
        self.hash = mix(span_hash(prefix, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64) * BASE)

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within one text, and the word that each starts at."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * BASE + self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(h[at]), at

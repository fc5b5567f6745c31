"""Removal of repeated passages by sliding spans of sentences.

A span starts at every sentence and takes in sentences until it has at least ``SENTENCES`` of them and
``WORDS`` words. Spans are hashed and joined over the whole corpus; every sentence that a span covers is
removed unless the span is the first with its content, by document id and then by place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.arrays import SPACED, Words, mix, ranges, span_hash, sums, text_chunks
from evalloom.llm.store import free_name, written

SENTENCES, WORDS = 3, 20
#: Bytes that end a sentence when a word ends with them, quotes and brackets after them aside. Clauses count as
#: sentences: a passage pasted into a sentence, or changed in one place, then loses a clause and not a long sentence.
STOPS, CLOSERS = b".!?;:,", b"\"')]"


class Spans:
    """Sentences of a chunk and the span that starts at each; a sentence too near the end of its text has none."""

    def __init__(self, texts: pa.Array, sentences: int, words: int):
        self.words = w = Words(texts, SPACED)
        is_stop, is_closer = np.zeros(256, bool), np.zeros(256, bool)
        is_stop[list(STOPS)] = is_closer[list(CLOSERS)] = True
        last = w.ends - 1
        for _ in range(3):
            again = is_closer[w.data[last]] & (last > w.starts)
            last = last - again
        ends = is_stop[w.data[last]]
        breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
        after = np.append(w.starts[1:], len(w.data))
        ends |= breaks[after] > breaks[w.ends]  # a line break follows
        ends |= np.append(w.doc[1:], -1) != w.doc
        self.first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(w) else np.zeros(0, np.int64)
        self.last = np.flatnonzero(ends) + 1  # words [first, last)
        self.doc = w.doc[self.first]
        n = len(self.first)
        doc_end = np.searchsorted(self.doc, self.doc, "right")
        stop = np.maximum(np.arange(n) + sentences, np.searchsorted(self.last, self.first + words) + 1)
        self.start = np.flatnonzero(stop <= doc_end)
        self.stop = stop[self.start]
        prefix = sums(w.hash)
        n_words = self.last[self.stop - 1] - self.first[self.start]
        self.hash = mix(span_hash(prefix, self.first[self.start], self.last[self.stop - 1]) + n_words.astype(np.uint64)).astype(np.int64)

    def begins(self) -> np.ndarray:
        """Byte at which each sentence starts, and its text's end for the last of a text: a sentence reaches to the next."""
        return self.words.starts[self.first]


def _hashes(sentences: int, words: int):
    def hashes(batches):
        for chunk in text_chunks(batches, "text"):
            s = Spans(chunk.column(1), sentences, words)
            _, first = np.unique(np.stack([s.doc[s.start], s.hash]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.hash[first]), chunk.column(0).take(pa.array(s.doc[s.start][first]))], names=["hash", "id"])

    return hashes


def _cut(schema: T.StructType, text: str, into: str, sentences: int, words: int):
    names = schema.names

    def cut(batches):
        for chunk in text_chunks(batches, text):
            at = chunk.schema.get_field_index(text)
            s = Spans(chunk.column(at), sentences, words)
            asked = chunk.column(chunk.schema.get_field_index(into)).to_pylist()
            doc = s.doc[s.start]
            bad = np.zeros(len(doc), bool)
            for row, hashes in enumerate(asked):
                own = slice(*np.searchsorted(doc, [row, row + 1]))
                if own.stop > own.start:
                    bad[own] = np.isin(s.hash[own], np.array(hashes or [], np.int64))
                    _, first = np.unique(s.hash[own], return_index=True)
                    again = np.ones(own.stop - own.start, bool)
                    again[first] = False
                    bad[own] |= again
            gone = np.zeros(len(s.first), bool)
            gone[ranges(s.start[bad], s.stop[bad] - s.start[bad])] = True
            rows = np.arange(chunk.num_rows)
            n = np.diff(np.searchsorted(s.doc, np.append(rows, chunk.num_rows)))
            removed = np.bincount(s.doc[gone], minlength=chunk.num_rows)
            lost = np.bincount(s.doc[gone], (s.last - s.first)[gone], chunk.num_rows).astype(np.int64)
            texts = chunk.column(at).cast(pa.binary()).to_pylist()
            begin = s.begins()
            for row in np.flatnonzero(removed):
                own = np.flatnonzero(s.doc == row) if chunk.num_rows < 3 else np.arange(*np.searchsorted(s.doc, [row, row + 1]))
                base, body = s.words.offsets[row], texts[row]
                edges = np.append(begin[own] - base, len(body))
                kept = [body[: edges[0]], *(body[edges[j] : edges[j + 1]] for j in np.flatnonzero(~gone[own]))]
                texts[row] = b"".join(kept)
            out = pa.array(texts, pa.binary()).cast(pa.string())
            stats = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(lost, pa.int64())], names=["n_sentences", "n_removed", "n_removed_words"])
            yield pa.RecordBatch.from_arrays([out if i == at else stats if name == into else chunk.column(i) for i, name in enumerate(names)], names=names)

    return cut


def remove_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS, into: str = "passages") -> DataFrame:
    """``docs`` with repeated sentences cut from ``text`` and a struct ``into``: n_sentences, n_removed, n_removed_words.

    A sentence ends with a word that ends in one of ``.!?;:,`` (closing quotes and brackets aside), at a line
    break or with the text, and reaches to the start of the next. Spans compare by their words, A-Z in lower case.

    Defined results: a null text stays null and has no sentences; a text shorter than a span loses nothing; spans
    of documents with a null id are never first if another document has them; rows that repeat an id count as one
    document, so exact repeats of a row lose nothing to each other; an empty table gives no rows; an existing
    column ``into`` is an error.
    """
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists; name another")
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    spans = written(source.mapInArrow(_hashes(sentences, words), f"hash long, id {id_type}"))
    # most hashes stand once and combine to nothing, a hash in a third of all texts to one row per task
    first = spans.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").drop("n")
    later = spans.join(first, "hash").where("first is not null and (id is null or id > first)")
    name = free_name(docs, "_id")
    cut = later.groupBy(F.col("id").alias(name)).agg(F.collect_set("hash").alias(into))  # at most one per sentence of a text
    joined = docs.join(cut, F.col(doc_id).eqNullSafe(F.col(name)), "left").drop(name)
    stats = T.StructType([T.StructField(n, T.LongType()) for n in ("n_sentences", "n_removed", "n_removed_words")])
    return joined.mapInArrow(_cut(joined.schema, text, into, sentences, words), T.StructType([*docs.schema.fields, T.StructField(into, stats)]))

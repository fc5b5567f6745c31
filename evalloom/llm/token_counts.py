"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves hold the characters and tokens of a few
pre-tokens, inner nodes the sums below them, so the root is the count of the document. An edit descends
to the leaf before it, splits the changed text into pre-tokens again until a boundary meets an old leaf
boundary behind the edit, encodes these alone, and updates the sums above.

Splitting goes from left to right and looks at most one character past the pre-token and one further past
a run of white space, so a pre-token that ends two characters before the edit stays, and from a shared
boundary on both splits are the same.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.arrays import text_chunks

LEAF = 16  # pre-tokens in a new leaf
FULL = 64  # pre-tokens in a leaf at which leaves are dealt anew
LOOK = 2  # characters before an edit that it may reach back to
REMEMBERED = 200_000

TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
EDIT = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern, self.memo = regex.compile(pattern), {}

    def count(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            n = self.memo[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, pieces: list[str], parts: int | None = None) -> tuple[list[int], list[int]]:
        """Characters and tokens of ``parts`` even groups of the pieces, by default of LEAF pieces each."""
        sizes, counts = [len(p) for p in pieces], [self.count(p) for p in pieces]
        parts = parts or max(1, -(-len(pieces) // LEAF))
        cuts = [len(pieces) * k // parts for k in range(parts + 1)]
        return [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])], [sum(counts[a:b]) for a, b in zip(cuts, cuts[1:])]


class Tree:
    """Sums of characters and tokens: node 1 is the root, node k has the children 2k and 2k + 1, leaves are the last half."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def over(cls, chars: list[int], tokens: list[int]) -> Tree:
        size = 1 << max(0, (len(chars) - 1).bit_length())
        tree = cls([0] * size + chars + [0] * (size - len(chars)), [0] * size + tokens + [0] * (size - len(tokens)))
        for node in range(size - 1, 0, -1):
            tree.sum(node)
        return tree

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    def sum(self, node: int) -> None:
        for values in (self.chars, self.tokens):
            values[node] = values[2 * node] + values[2 * node + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the last leaf that starts at or before ``place`` and has text, or of the first leaf."""
        node, start = 1, 0
        while node < self.size:
            left = self.chars[2 * node]
            right = place >= start + left and self.chars[2 * node + 1] > 0
            node, start = 2 * node + right, start + left * right
        return node - self.size, start

    def replace(self, first: int, chars: list[int], tokens: list[int]) -> None:
        """New leaves from ``first`` on, and the sums above them."""
        low, high = self.size + first, self.size + first + len(chars) - 1
        self.chars[low : high + 1], self.tokens[low : high + 1] = chars, tokens
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                self.sum(node)


def edited(counter: Counter, text: str, tree: Tree, start: int, end: int, new: str) -> tuple[str, Tree, int]:
    """(text, tree, pre-tokens encoded) after ``text[start:end]`` became ``new``."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    after = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    leaf, begin = tree.leaf_at(max(0, start - LOOK))
    last, bound = leaf, begin + tree.chars[tree.size + leaf]  # old leaves leaf..last end at the old place ``bound``
    pieces, at = [], begin
    for match in counter.pattern.finditer(after, begin):
        pieces.append(match[0])
        at = match.end()
        while bound + shift < at and last + 1 < tree.size:
            last += 1
            bound += tree.chars[tree.size + last]
        if bound >= end and at == bound + shift and at >= start + len(new):
            break
    else:
        last = tree.size - 1
    if len(pieces) <= FULL * (last - leaf + 1):
        tree.replace(leaf, *counter.leaves(pieces, last - leaf + 1))
    else:
        chars, tokens = counter.leaves(pieces)
        size = tree.size
        tree = Tree.over(*(v[size : size + leaf] + mine + v[size + last + 1 :] for v, mine in ((tree.chars, chars), (tree.tokens, tokens))))
    return after, tree, len(pieces)


def count_tokens(docs: DataFrame, edits: Column, ranks: str, pattern: str, text: str = "text", tree: str = "tree", into: str = "counts") -> DataFrame:
    """``docs`` with ``text`` and ``tree`` after the edits, and a struct ``into``: before, after (tokens), pieces, encoded (pre-tokens).

    ``edits`` gives each row its (start, end, text) in order, places in code points of the text as it then is.
    ``tree`` is what an earlier call returned for the text; without that column, or where it is null, the text is
    encoded whole once. ``ranks`` is a tiktoken file on every machine, ``pattern`` its splitting pattern.
    ``pieces`` counts the pre-tokens of trees built here, ``encoded`` those encoded for edits.

    Defined results: a null text is empty; null edits are none, a null replacement is empty, null or outlying places
    are moved to the nearest end; repeated rows count each for themselves; an existing column ``into`` is an error.
    """
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists; name another")
    if tree not in docs.columns:
        docs = docs.withColumn(tree, F.lit(None).cast(TREE))
    asked = docs.withColumn(into, edits.cast(EDIT))
    counts = T.StructType([T.StructField(n, T.LongType()) for n in ("before", "after", "pieces", "encoded")])
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields), T.StructField(into, counts)])

    def run(batches):
        counter = Counter(ranks, pattern)
        for chunk in text_chunks(batches, text):
            column = {name: chunk.column(i) for i, name in enumerate(chunk.schema.names)}
            texts, trees, stats = [], [], []
            for body, old, todo in zip(column[text].to_pylist(), column[tree].to_pylist(), column[into].to_pylist(), strict=True):
                body, pieces, encoded = body or "", 0, 0
                if old is None:
                    parts = counter.pattern.findall(body)
                    now, pieces = Tree.over(*counter.leaves(parts)), len(parts)
                else:
                    now = Tree(old["chars"], old["tokens"])
                before = now.tokens[1]
                for edit in todo or []:
                    start = edit["start"] or 0
                    body, now, n = edited(counter, body, now, start, edit["end"] if edit["end"] is not None else start, edit["text"] or "")
                    encoded += n
                texts.append(body)
                trees.append({"chars": now.chars, "tokens": now.tokens})
                stats.append({"before": before, "after": now.tokens[1], "pieces": pieces, "encoded": encoded})
            made = {text: pa.array(texts, pa.string()), tree: pa.array(trees, pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])), into: pa.array(stats, pa.struct([(n, pa.int64()) for n in ("before", "after", "pieces", "encoded")]))}
            yield pa.RecordBatch.from_arrays([made.get(n, column[n]) for n in schema.names], names=schema.names)

    return asked.mapInArrow(run, schema)

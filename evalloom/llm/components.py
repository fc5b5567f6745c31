"""Connected components of an edge table, as joins and aggregates on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.store import removed, written


def fingerprint(edges: DataFrame) -> tuple:
    """Number and two sums of hashes of the rows: equal for equal sets, and for others with a chance of 2 ** -100 or so."""
    h = [F.sum(F.pmod(F.xxhash64("u", "v", F.lit(k)), F.lit(1 << 40)).cast("decimal(20,0)")) for k in (1, 2, 3)]
    return tuple(edges.agg(F.count("*"), *h).first())


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component; None if there are none) after further ``edges`` (a, b), as a new table: only components that they join are worked on."""
    if labels is None:
        return components(edges)
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    known = labels.unionByName(fresh)
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b").distinct()
    joined = components(between)
    joint = joined.select(F.col("node").alias("component"), F.col("component").alias("joint"))
    out = written(known.join(joint, "component", "left").select("node", F.coalesce("joint", "component").alias("component")))
    removed(joined)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), as a written table: the component is its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then the node and its
    smaller ones on the smallest of those. Every round is two aggregates and two joins and rounds
    grow with the logarithm of the longest path; nothing of a component meets in one task. A round's table is deleted
    when the next one stands.

    Defined results: an edge of a node with itself, with a null end, or repeated, adds nothing; no edges give no rows.
    """
    state = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())  # greatest and least skip a null end, which leaves u = v
    last = fingerprint(state)
    while True:
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(small)
        removed(state)
        state, now = new, fingerprint(new)
        if now == last:
            break
        last = now
    labels = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(labels.unionByName(roots.join(labels, "node", "left_anti")))
    removed(state)
    return out

"""Connected components of an edge table, by alternating large-star and small-star steps.

A large-star step links every larger neighbour of a node to the smallest node near it, a small-star step does so for
the smaller neighbours; after a number of rounds that grows with the logarithm of the longest path every node is linked
to the smallest node of its component and the edges no longer change. Only minima are aggregated, never lists of
neighbours; each step's result is a table in the shared folder. A node with very many edges is a skewed join key, whose
rows Spark splits over tasks, since both sides of the joins are plain shuffles of written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import discard, written


def _linked(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) for the pairs (u, v): m is the smallest of u and all its v; and the table of m by u, to be discarded."""
    least = written(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{name}-least")
    return pairs.join(least, "u").select("u", "v", "m"), least


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b): longs; loops and repeated edges do no harm."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    state = None
    while True:
        both = written(now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v"))), "cc-both")
        linked, least = _linked(both, "cc-large")
        large = written(linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        discard(both, least, now)
        small, least = _linked(large, "cc-small")
        links = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(links.filter("a <> b").distinct(), "cc-edges")
        discard(large, least)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == state:
            break
        state = (seen["n"], seen["x"])
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""Connected components of a link table, by alternating star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from furrow.llm.common import checkpoint


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node reachable.

    ``links`` has two long columns a, b in any order; nulls, self-links and
    repeats are ignored. Each round hangs every node's larger neighbours, then
    its smaller ones, under its smallest neighbour, until only stars are left;
    the rounds grow with the logarithm of the longest chain. Neighbourhoods are
    never gathered: minima combine map-side, and the joins on a hub's key are
    split by adaptive execution.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpoint(edges.where("a is not null and b is not null and a <> b").distinct())

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()

    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = _smallest(both).select("a", F.least("a", "least").alias("least"))
        large = (
            both.join(hub, "a").where("b > a and b <> least")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        )
        low = _smallest(large)
        small = (
            large.join(low, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(low.select("a", F.col("least").alias("b"))).distinct()
        )
        edges = checkpoint(small)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

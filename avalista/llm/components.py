"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avalista.llm.common import cut_lineage

STEPS = 60  # far more than the logarithm of any number of nodes


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b; returns (node, label) for every linked node, the label being the smallest node of its component.

    Each step keeps an edge set no larger than the links. A node with many links is summed before
    the shuffle, and the join that brings its minimum back can be split by adaptive execution.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(STEPS if mark["n"] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("w")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        if mark["n"]:
            raise RuntimeError(f"components are not settled after {STEPS} steps")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)

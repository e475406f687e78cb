"""Connected components of an edge table by alternating large-star and small-star steps.

Each step joins edges with the least neighbour of each node, a grouped minimum with partial aggregation, so a
node with very many neighbours is never gathered in one task; skewed joins are split by adaptive execution.
Edges are written to the shared folder after each round, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node that an edge between different nodes has; root is the least node of its component.

    Rows with nulls and loops are ignored; an empty table gives an empty result.
    """
    kind = edges.schema[u].dataType
    pairs = edges.select(F.col(u).cast(kind).alias("a"), F.col(v).cast(kind).alias("b")).filter("a <> b")
    now = scratch.keep(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(step)
        scratch.drop(now)
        new_mark = _mark(after)
        now = after
        if new_mark == mark:
            break
        mark = new_mark
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of an edge table."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")).first()
    return r.n, r.s or 0

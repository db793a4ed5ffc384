"""Connected components of an edge table by alternating large and small stars.

Every round is a few equi-joins and aggregations over the edge table; the
number of rounds grows with the square of the logarithm of the node count at
most, also on long chains.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knockon.llm.common import shared_table


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    Self loops and repeated edges change nothing; no edges give an empty table.
    """
    a, b = F.col(left), F.col(right)
    now = shared_table(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                       .distinct(), "cc-edges")
    state = _state(now)
    while state[0]:
        now = shared_table(_small_star(_large_star(now)), "cc-round")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

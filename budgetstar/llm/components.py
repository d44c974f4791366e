"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation and a join on node numbers, written to the shared folder; nothing
about the graph reaches the driver but one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.sources.shared import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them (large: only larger neighbours)."""
    pairs = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    met = pairs.join(least, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) for all nodes but the roots.

    ``edges`` has columns ``a`` and ``b`` of any order; self-edges and repeats do no harm.
    """
    current = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(current)
    while state[0]:
        current = cut_lineage(_star(cut_lineage(_star(current, large=True)), large=False))
        after = _state(current)
        if after == state:
            break
        state = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least v of each u, grouped by a struct of u, so that a join on u shuffles it again."""
    return edges.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; component is the smallest node reachable.

    Null ends and self-loops are ignored. Each round shuffles the edge list on one end; the minimum is combined
    before its shuffle and dealt anew for the join back to the edges, so that both sides of the join are plain shuffles, of
    which adaptive execution splits a hub's edges. Only two numbers per round reach the driver.
    """
    u, v = F.col(a), F.col(b)
    edges = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges = cut(edges.distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large).hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.*").where("u > v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

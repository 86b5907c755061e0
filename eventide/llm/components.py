"""Connected components of an edge table, by alternating stars.

A large-star round links every larger neighbour of a node to the node's
smallest neighbour, a small-star round does the same for the smaller ones;
both keep the components and end in stars around each smallest node. Rounds
grow with the logarithm of the longest path. Hubs: the smallest neighbour is
an aggregate with map-side partials, and the joins that use it are plain
equi-joins, so adaptive execution splits a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import discard, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node.

    Edges with a null end and loops are ignored. Nodes without edges are not
    in the result, and each is its own component.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    e = materialize(e.distinct(), "edges")
    stamp = _stamp(e)
    while stamp[0]:
        after = materialize(_small_star(_large_star(e)), "edges")
        discard(e)
        e, before, stamp = after, stamp, _stamp(after)
        if stamp == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stamp(e: DataFrame) -> tuple[int, int]:
    n, x = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return n, x


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

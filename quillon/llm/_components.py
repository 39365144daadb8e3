"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._store import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its smallest reachable node) for each node of ``edges``.

    Every round only takes minima by node and joins them back, so no node's neighbours
    are gathered anywhere; a join on a node with very many is left to adaptive skew splits.
    Rounds grow with the logarithm of the longest path.  To the driver goes one row a round.
    """
    oriented = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current, seen = stored(oriented), None
    while True:
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (mark["n"], mark["x"]) == seen or not mark["n"]:
            break
        seen = (mark["n"], mark["x"])
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours move to the least of the neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the least of these.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)


def joined_components(reached: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``reached`` (node, component) once ``edges`` are there too: only whole components are linked."""
    name = lambda side: reached.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    named = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).join(name("x"), "x", "left").join(name("y"), "y", "left")
    merged = components(named.select(F.coalesce("cx", "x").alias("p"), F.coalesce("cy", "y").alias("q")), "p", "q")
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    moved = reached.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = merged.join(reached.select(F.col("node").alias("component")), "component", "left_anti")
    return moved.unionByName(fresh.select(F.col("component").alias("node"), F.col("root").alias("component")))

"""Connected components of an edge table, by alternating stars.

A large star links every larger neighbour of a node to the least node around it, a small star links a node and its
smaller neighbours to the least of them. Both keep what is connected; in turns they end in one star for each component.
Least neighbours are combined before the shuffle and joined back, so a node with very many neighbours is split like any
other skewed key. Every round is written to the shared folder; only whether all components are stars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or is one, but not both."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    roles = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.where("leaf + centre > 1").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node of edges(u, v); an edge from a node to itself adds nothing."""
    held = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(held):
            break
        large = stage(_large_star(held), "large-star")
        small = stage(_small_star(large), "small-star")
        drop(large)
        drop(held)
        held = small
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = held.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

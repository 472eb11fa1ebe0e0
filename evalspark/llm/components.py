"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import keep_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours over to the smallest node it knows."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("u", "m")).filter("a != b")


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (two columns of integer ids) -> node, component (its smallest node).

    Nodes without an edge to another one are not in the result; loops and repeated
    edges make no difference. A round is a few grouped minima and joins, which
    Spark combines before the shuffle and splits when a node has very many
    edges; its result is written to the shared folder. Rounds end when the edges
    no longer change: then every component is a star around its smallest node.
    """
    edges = edges.toDF("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = keep_table(edges, "edges")
    before = _state(edges)
    while True:
        edges = keep_table(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(hashed, 20)), F.bit_xor(hashed)).first())

"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.scratch import materialize, replace


def _lowest_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the least of u and all v that share its row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest_neighbour(down)
    onward = low.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionAll(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the least node of its component.

    Returns (node, root) for each node that has an edge to another node.
    Each round writes its edges to the shared folder; the number of rounds
    grows with the logarithm of the longest path. Edges with a null end and
    loops are ignored.
    """
    edges = materialize(edges.select("u", "v").where("u != v"), "star")
    mark = None
    for _ in range(max_rounds):
        edges = replace(edges, _small_star(_large_star(edges)), "star")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))

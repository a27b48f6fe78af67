"""Connected components of a graph held as a DataFrame of edges.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
reconnects neighbours to the least one, which never makes the graph larger and
halves the distance to it.  All is grouping and joining; each round is written
to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.frames import LEAST_HOT, join_groups, settle


def _joined_to_least(pairs: DataFrame, total: int, degree: int) -> DataFrame:
    """(u, v, m) for every (u, v) of at most ``total``: m is the least of u and its neighbours, of whom no node has more than
    ``degree``."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    if degree > LEAST_HOT:  # a star's centre may be a hot key
        return join_groups(pairs, least, ["u"], total=total)
    return pairs.join(least.drop("n").withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(edges: DataFrame, total: int, degree: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _joined_to_least(both, 2 * total, degree).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int, degree: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _joined_to_least(down, total, degree)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _shape(edges: DataFrame) -> tuple[int, int, bool]:
    """Number of edges, most of a node, and whether each is from a leaf to its centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    n, degree, inner = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max(F.col("up") + F.col("down")), F.lit(0)), F.count_if((F.col("up") > 1) | (F.least("up", "down") > 0))).first()
    return n, degree, inner == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (u, v); the root is the least node of its component."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = settle(edges, "edges")
    while True:
        n, degree, stars = _shape(edges)
        if stars:
            break
        # A step leaves a node no more neighbours than all edges; the degree is a guess at which keys are hot.
        edges = settle(_small_star(_large_star(edges, n, degree), n, degree), "edges")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())

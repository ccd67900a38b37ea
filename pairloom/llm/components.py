"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.session import durable



# The smallest neighbours are dealt out anew before each join: both sides of it are then
# shuffled for the join, which lets adaptive execution split a node with very many links.

def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).repartition("a", "m")
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them.

    Rows are (larger, smaller).
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).repartition("a", "m")
    joined = edges.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has a link.

    ``links`` has two long columns ``a`` and ``b``; the result has ``node`` and ``root``.
    Each round replaces the links by stars around smaller nodes and is stored in the
    shared folder; the rounds end when the stars no longer change, after about log2 of
    the longest path.  A node with very many links is a join key that adaptive execution
    splits; no neighbour list is ever gathered.  Self links and repeated links do no
    harm, rows with a null end are left out, an empty table gives an empty one.
    """
    edges = durable(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
        edges = durable(_small_star(_large_star(edges)))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.union(roots)

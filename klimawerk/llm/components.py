"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klimawerk.llm.storage import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; ``component`` is the smallest node that can be reached.

    Links that are stars are settled, which the table of every node's ends tells; it is then the result too. Others go through
    rounds. Each round joins every node's larger neighbours to its smallest one, then its smaller ones too. Rounds grow with the
    logarithm of the number of nodes. Minima are combined before the exchange and only links are joined back, so a node
    with very many neighbours is spread over tasks. No links give no rows.
    """
    links = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a != b")
    # The larger node comes first, here and after each round. A link may come twice here.
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    for _ in range(max_rounds):
        ends = _ends(edges)
        # No node has a smaller neighbour and yet another one.
        if ends.where("low < n and low != high").isEmpty():
            return ends.select(F.col("n").alias("node"), F.least("n", "low").alias("component"))
        edges = written(_small_star(_large_star(edges, ends)), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _ends(edges: DataFrame) -> DataFrame:
    """(n, low, high): every node with its smallest and its largest neighbour."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("n"), F.col("a").alias("other"))
    )
    # Written, so that both sides of a join are shuffled for it and Spark may split the partition of a hub.
    return written(both.groupBy("n").agg(F.min("other").alias("low"), F.max("other").alias("high")), "ends")


def _large_star(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """As many links as there are, some perhaps twice."""
    lowest = ends.select("n", F.least("n", "low").alias("m"))
    # A larger neighbour of n is the first node of an oriented link whose second is n.
    return edges.join(lowest, edges.b == lowest.n).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()

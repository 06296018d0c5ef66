"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import cut, join_with_hot


def _both_ways(edges: DataFrame) -> DataFrame:
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionAll(flipped)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links each node's larger neighbours to the least node around it."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    moved = join_with_hot(near.where("b > a"), least, ["a"], "n", total)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links each node, and its smaller neighbours, to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_with_hot(down, least, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return least.select("a", F.col("m").alias("b")).unionAll(moved).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in edges (a, b: long), component being the least node reachable.

    Each round is two grouped minima and joins over the edges left. A node with very many neighbours is met by a partial
    minimum, and its least neighbour is broadcast to its edges wherever they are, so that no task gathers it. Ends when a
    round changes nothing, which takes about log(longest path) rounds. Nodes without edges, null ends and self-links yield
    no row; repeated edges count once.
    """
    now = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct(), name)
    count = now.count()
    while count:
        before, last = now, count
        stars = cut(_large_star(before, last), name)
        now = cut(_small_star(stars, stars.count()), name)
        count = now.count()
        # Equal tables: as many rows, and none of the new that wasn't there.
        if count == last and now.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

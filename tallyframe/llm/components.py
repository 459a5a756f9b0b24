"""Connected components of large graphs by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import settle


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label) for every vertex of the edges (a, b); equal labels mean connected.

    In each round every vertex joins its neighbour that comes first in an order hashed anew, and the edges
    between what has been joined stay.  The rounds are about the logarithm of the longest path, and each has fewer edges
    than the one before.  Sums per vertex are combined before the shuffle, so a hub costs nothing; the tables of a round
    are written, so lost executors do not repeat earlier ones.
    """
    edges = settle(edges.where("a <> b").select("a", "b").distinct(), "edges")
    total = edges.select(F.col("a").alias("vertex"), F.col("a").alias("label")).limit(0)
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        moved = settle(
            first.select(F.col("a").alias("vertex"), F.when(F.col("best") < rank("a"), F.col("best.v")).otherwise(F.col("a")).alias("to")),
            "moves",
        )
        of_a = moved.select(F.col("vertex").alias("a"), F.col("to").alias("ta"))
        of_b = moved.select(F.col("vertex").alias("b"), F.col("to").alias("tb"))
        edges = settle(
            edges.join(of_a, "a").join(of_b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges"
        )
        if turn == 0:
            total = moved.withColumnRenamed("to", "label")
        else:
            later = moved.select(F.col("vertex").alias("label"), "to")
            total = settle(total.join(later, "label", "left").select("vertex", F.coalesce("to", "label").alias("label")), "labels")
        turn += 1
    return total

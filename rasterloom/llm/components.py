"""Connected components of a link table by repeated contraction, in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """``node`` and ``label`` for every node of ``links(a, b)``; equal labels mean connected.

    Each round sends every node to the smallest of itself and its neighbours and contracts the links.
    Nodes should be hashes, so that the number that remains falls by a constant factor a round even on
    chains, and a star of any size is done in one or two. A hot node only meets a partial minimum and a join
    that Spark may split. Nothing but a row count comes to the driver.
    """
    edges = work.write(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    moves, k = [], 0
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = work.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), f"{name}-move-{k}")
        moves.append(move)
        left = edges.join(move.select("a", F.col("to").alias("x")), "a")
        both_moved = left.join(move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        k += 1
        nearer = both_moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = work.write(nearer, f"{name}-edges-{k}")
    if not moves:
        kind = links.schema["a"].dataType.simpleString()
        return work.spark.createDataFrame([], f"node {kind}, label {kind}")
    label = moves[0].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for move in moves[1:]:
        step = move.select(F.col("a").alias("label"), F.col("to").alias("next"))
        label = label.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return work.write(label, f"{name}-labels")

"""Graph walks as joins: bounded hops, ranks, and the end of each chain of successors."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise


def k_hop(seeds: DataFrame, edges: DataFrame, weights: dict[str, float], *, hops: int = 2, decay: float = 0.85, other: float = 0.7) -> DataFrame:
    """(node, score): the best weight * decay^hop with which each node is reached from ``seeds`` (node).

    ``edges`` are (src, dst, relation); the score is that of the last edge, not a product along the path.
    """
    weight = functools.reduce(lambda rest, r: F.when(F.col("relation") == r, weights[r]).otherwise(rest), weights, F.lit(other))
    at, found = seeds.select("node").distinct(), []
    for hop in range(1, hops + 1):
        step = edges.join(at.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(weight * decay**hop).alias("score"))
        found.append(step)
        at = step.select("node")
    reached = functools.reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("score").alias("score"))
    return reached.join(seeds.select("node").distinct(), "node", "left_anti")


def pagerank(edges: DataFrame, *, iterations: int = 20, damping: float = 0.85, written_every: int = 5) -> DataFrame:
    """(node, rank) of the different ``edges`` (src, dst); nodes without a way out give to all.

    Ranks are written to the shared folder every few rounds, so plans stay short.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "rank-edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    base = materialise(nodes.join(degree, "node", "left"), "rank-nodes")
    n = max(base.count(), 1)
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        sent = edges.join(ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("part")), "src")
        inflow = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("inflow"))
        lost = ranks.filter("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        rank = (1 - damping) / n + damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("lost") / n)
        ranks = base.join(inflow, "node", "left").crossJoin(F.broadcast(lost)).select("node", "degree", rank.alias("rank"))
        if i % written_every == 0:
            ranks = materialise(ranks, f"rank-{i}")
    return ranks.select("node", "rank")


def chain_ends(links: DataFrame) -> DataFrame:
    """(node, last, steps): where the successors of each node of ``links`` (node, next) end.

    A node without a successor has a null ``next``. Pointers are doubled, so a
    chain of n nodes takes log2(n) rounds; nodes on a cycle have a null ``last``.
    """
    at = materialise(links.select("node", F.coalesce("next", "node").alias("last"), F.col("next").isNotNull().cast("long").alias("steps"), F.col("next").isNull().alias("ended")), "chain")
    rounds = max(1, at.count()).bit_length()
    for _ in range(rounds):
        if at.filter("not ended").isEmpty():
            break
        ahead = at.select(F.col("node").alias("last"), F.col("last").alias("last2"), F.col("steps").alias("steps2"), F.col("ended").alias("ended2"))
        joined = at.join(ahead, "last", "left")
        # a successor that is no node itself ends its chain
        at = materialise(
            joined.select("node", F.when(F.col("ended"), F.col("last")).otherwise(F.coalesce("last2", "last")).alias("last"), F.when(F.col("ended"), F.col("steps")).otherwise(F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("ended") | F.coalesce("ended2", F.lit(True))).alias("ended")),
            "chain",
        )
    return at.select("node", F.when(F.col("ended"), F.col("last")).alias("last"), F.when(F.col("ended"), F.col("steps")).alias("steps"))

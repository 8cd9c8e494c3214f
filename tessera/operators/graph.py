"""PageRank over edges (src, dst). Ranks sum to the number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..persist import checkpointed


def weighted_edges(edges: DataFrame, beta: float = 0.8) -> DataFrame:
    """Distinct edges with ``beta`` over the number of edges that leave src."""
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    return edges.join(degree, "src").select("src", "dst", (F.lit(beta) / F.col("out")).alias("w"))


def step(weights: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """One round: ranks flow along edges, and what is lost goes to every node alike."""
    flow = weights.join(ranks, weights["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("x"))
    got = ranks.select("node").join(flow, F.col("node") == F.col("dst"), "left").select("node", F.coalesce("x", F.lit(0.0)).alias("x"))
    lost = got.agg((1 - F.sum("x") / n).alias("lost"))
    return got.crossJoin(F.broadcast(lost)).select("node", (F.col("x") + F.col("lost")).alias("rank"))


def pagerank(edges: DataFrame, nodes: DataFrame, beta: float = 0.8, epsilon: float = 1.0, rounds: int | None = None) -> DataFrame:
    """node and rank, from all ranks 1 until the total change of a round is below ``epsilon``.

    ``rounds`` fixes their number instead. With ``beta`` below 1 the change shrinks by ``beta`` or
    more in each round, so the end always comes. The first change is the distance from all zeros, as the
    old ranks start at 0. Each round's ranks are checkpointed, so plans stay short.
    """
    if rounds is None and not (epsilon > 0 and 0 <= beta < 1):
        raise ValueError("beta below 1 and a positive epsilon are needed to come to an end")
    n = nodes.count()
    weights = checkpointed(weighted_edges(edges, beta))
    ranks = checkpointed(nodes.select("node", F.lit(1.0).alias("rank")))
    change, done = float(n), 0
    while (done < rounds) if rounds is not None else change >= epsilon:
        new = checkpointed(step(weights, ranks, n))
        if rounds is None:
            moved = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()
            change = moved["d"] or 0.0
        ranks, done = new, done + 1
    return ranks


def node_range(spark, n: int) -> DataFrame:
    """Nodes 1 to n."""
    return spark.range(1, n + 1).withColumnRenamed("id", "node")


def top_ranked(ranks: DataFrame, n: int = 10) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), F.asc("node")).limit(n)

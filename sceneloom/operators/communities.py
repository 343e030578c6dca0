"""Components and communities of weighted undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.runtime import Rounds, cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each node's component.

    Every round each node takes the least label around it, then the label of its label, so distances shrink by half
    or better; each round is a written table. Edges are aggregated by node before they meet, so hubs are pre-combined.
    Edge cases: null ends are dropped, self loops keep their node, repeated edges count once.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    rounds = Rounds(edges.sparkSession)
    moved = rounds.add(e.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")).withColumn("moved", F.lit(True)), F.col("moved"))
    while moved:
        state = rounds.last().drop("moved")
        around = e.join(state.select(F.col("x").alias("y"), F.col("c").alias("cy")), "y").groupBy("x").agg(F.min("cy").alias("cy"))
        near = state.join(around, "x").select("x", F.col("c").alias("was"), F.least("c", "cy").alias("c"))
        jump = near.join(state.select(F.col("x").alias("c"), F.col("c").alias("cc")), "c", "left").select("x", "was", F.least("c", F.coalesce("cc", "c")).alias("c"))
        moved = rounds.add(jump.select("x", "c", (F.col("was") != F.col("c")).alias("moved")), F.col("moved"))
    return rounds.last().select(F.col("x").alias("node"), F.col("c").alias("component"))


def communities(edges: DataFrame, weight: str = "weight", resolution: float = 1.0, rounds: int = 10, a: str = "a", b: str = "b") -> DataFrame:
    """(node, community): local moves towards higher modularity, the smallest node naming a community.

    In each round the nodes of one half (by hash, halves taking turns) move to the neighbouring community with the
    largest gain, ties to the smaller name; it ends when neither half moves, or after ``rounds`` turns of both. All
    sums are partial aggregates over edges; communities are sums, never gathered. Deterministic, unlike seeded methods.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.col(weight).cast("double").alias("w")).groupBy("x", "y").agg(F.max("w").alias("w"))
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")))
    degree = cut(e.groupBy("x").agg(F.sum("w").alias("k")))
    twice = degree.agg(F.sum("k")).first()[0] or 1.0
    turns, still = Rounds(edges.sparkSession), 0
    turns.add(degree.select("x", F.col("x").alias("c"), F.lit(False).alias("moved")), F.col("moved"))
    for turn in range(2 * rounds):
        state = turns.last().select("x", "c")
        size = state.join(degree, "x").groupBy("c").agg(F.sum("k").alias("kc"))
        links = e.join(state.select(F.col("x").alias("y"), F.col("c").alias("to")), "y").groupBy("x", "to").agg(F.sum("w").alias("w"))
        mine = state.join(degree, "x").where(F.pmod(F.xxhash64("x"), F.lit(2)) == turn % 2)
        choice = links.unionByName(mine.select("x", F.col("c").alias("to"), F.lit(0.0).alias("w"))).groupBy("x", "to").agg(F.sum("w").alias("w"))
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("kc") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / twice, 9)
        best = Window.partitionBy("x").orderBy(F.desc("gain"), (F.col("to") != F.col("c")), "to")
        moves = (
            choice.join(mine, "x").join(size.select(F.col("c").alias("to"), "kc"), "to").withColumn("gain", gain)
            .withColumn("r", F.row_number().over(best)).where("r = 1 and to <> c").select("x", "to")
        )
        moved = turns.add(state.join(moves, "x", "left").select("x", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), F.col("moved"))
        still = 0 if moved else still + 1
        if still == 2:
            break
    state = turns.last().select("x", "c")
    names = state.groupBy("c").agg(F.min("x").alias("community"))
    return state.join(names, "c").select(F.col("x").alias("node"), "community")


def modularity(edges: DataFrame, members: DataFrame, weight: str = "weight", a: str = "a", b: str = "b", resolution: float = 1.0) -> float:
    """Modularity of a partition (node, community) of an undirected graph given with each edge once."""
    m = members.select("node", "community")
    e = edges.join(m.select(F.col("node").alias(a), F.col("community").alias("ca")), a).join(m.select(F.col("node").alias(b), F.col("community").alias("cb")), b)
    total = e.agg(F.sum(weight)).first()[0] or 1.0
    inside = e.where("ca = cb").agg(F.sum(weight)).first()[0] or 0.0
    k = e.select(F.col("ca").alias("c"), weight).unionByName(e.select(F.col("cb").alias("c"), weight)).groupBy("c").agg(F.sum(weight).alias("k"))
    return inside / total - resolution * (k.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0) / (4 * total * total)

"""From scored hits to labelled evidence: best hit per video, votes, lean and confidence, tiers and blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_video(hits: DataFrame, query: str = "query", video: str = "video_id", score: str = "cosine", order: str = "row") -> DataFrame:
    """The highest-scoring hit of each video for each query; equal scores go to the earlier hit. Other columns are kept."""
    w = Window.partitionBy(query, video).orderBy(F.desc(score), order)
    return hits.withColumn("_best", F.row_number().over(w)).where("_best = 1").drop("_best")


def top_k(hits: DataFrame, k: int, query: str = "query", score: str = "cosine", tie: str = "video_id") -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``; ties by ``tie``."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def votes(hits: DataFrame, query: str = "query", label: str = "video_label") -> DataFrame:
    """(query, label, n); hits without a label do not vote."""
    return hits.where(F.col(label).isNotNull()).groupBy(query, label).agg(F.count("*").alias("n"))


def lean(hits: DataFrame, query: str = "query", label: str = "video_label") -> DataFrame:
    """(query, lean, confidence): the label with most votes; null and 'mixed' if two lead, 'weak' by one vote, else 'strong'."""
    w = Window.partitionBy(query).orderBy(F.desc("n"), label)
    v = votes(hits, query, label).withColumn("next", F.coalesce(F.lead("n").over(w), F.lit(0))).withColumn("r", F.row_number().over(w)).where("r = 1")
    gap = F.col("n") - F.col("next")
    return v.select(query, F.when(gap > 0, F.col(label)).alias("lean"), F.when(gap == 0, "mixed").when(gap == 1, "weak").otherwise("strong").alias("confidence"))


def binary_lean(positive: Column, total: Column) -> tuple[Column, Column]:
    """(lean, confidence) of two labels: whatever is not positive counts as negative; null and 'none' without votes."""
    diff = 2 * positive - total
    return (
        F.when((total > 0) & (diff != 0), F.when(diff > 0, 1).otherwise(0)),
        F.when(total == 0, "none").when(diff == 0, "mixed").when(F.abs(diff) <= 1, "weak").otherwise("strong"),
    )


def tiered(first: DataFrame, second: DataFrame, query: str = "query") -> DataFrame:
    """Hits of the first tier, and those of the second for queries that have none there; ``tier`` says which."""
    rest = second.join(first.select(query).distinct(), query, "left_anti")
    return first.withColumn("tier", F.lit(1)).unionByName(rest.withColumn("tier", F.lit(2)))


def prior(df: DataFrame, *keys: str, label: str = "video_label") -> DataFrame:
    """(keys, prior): the share of label 1 with one success and one failure added; rows without a label don't count."""
    return df.where(F.col(label).isNotNull()).groupBy(*keys).agg(((F.count_if(F.col(label) == 1) + 1) / (F.count("*") + 2)).alias("prior"))


def edge_score(cosine: Column, prior: Column, similarity: float = 0.85) -> Column:
    """Similarity and prior in fixed weights; an unknown prior is a half."""
    return similarity * cosine + (1 - similarity) * F.coalesce(prior, F.lit(0.5))


def depth_penalty(a: Column, b: Column, weight: float) -> Column:
    """Grows with the difference of two depths up to three; none if either is unknown (negative)."""
    return F.when((a >= 0) & (b >= 0), weight * F.least(F.abs(a - b), F.lit(3)) / 3).otherwise(0.0)

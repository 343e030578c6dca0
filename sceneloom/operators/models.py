"""Fitted models over scene vectors and concept triples: components, clusters, a scorer, and their diagnostics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.discourse import GLOSS
from sceneloom.functions.vectors import unit


def features(df: DataFrame, vec: str) -> DataFrame:
    """``x``: the unit vector as an ML vector; rows without a vector are dropped."""
    return df.where(F.col(vec).isNotNull()).withColumn("x", array_to_vector(unit(vec)))


def cluster_model(df: DataFrame, vec: str, k: int, dims: int | None = None, mixture: bool = False, seed: int = 42) -> PipelineModel:
    """Principal components, then k-means or a Gaussian mixture (of full covariance; the diagonal kind is not offered by the library)."""
    stages, at = [], "x"
    if dims:
        stages.append(PCA(k=dims, inputCol="x", outputCol="pc"))
        at = "pc"
    stages.append((GaussianMixture if mixture else KMeans)(k=k, featuresCol=at, predictionCol="cluster", seed=seed))
    return Pipeline(stages=stages).fit(features(df, vec))


def clustered(model: PipelineModel, df: DataFrame, vec: str) -> DataFrame:
    out = model.transform(features(df, vec))
    soft = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    return out.withColumn("proba", soft).drop("x", "pc", "probability")


def top_clusters(proba: str | Column, p: int) -> Column:
    """The ``p`` most probable clusters as struct(cluster, p), most probable first."""
    c = F.col(proba) if isinstance(proba, str) else proba
    order = F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("o"), i.alias("i"))))
    return F.transform(F.slice(order, 1, p), lambda x: F.struct(x["i"].alias("cluster"), (-x["o"]).alias("p")))


def diagnostics(df: DataFrame, tiny: int = 5) -> DataFrame:
    """(clusters, largest_share, tiny) of an assignment with column ``cluster``."""
    n = df.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), (F.max("n") / F.sum("n")).alias("largest_share"), F.count_if(F.col("n") < tiny).alias("tiny"))


def silhouette(df: DataFrame, vec: str) -> float:
    return ClusteringEvaluator(featuresCol="x", predictionCol="cluster", distanceMeasure="cosine").evaluate(features(df, vec))


def triple_features(triples: DataFrame, k: int) -> DataFrame:
    """``x`` of (cosine, rel, prior, c_src, c_tgt): cosine, the relation one-hot, prior (a half if unknown), both concepts over k."""
    hot = [F.when(F.col("rel") == r, 1.0).otherwise(0.0) for r in GLOSS]
    return triples.withColumn("x", array_to_vector(F.array(F.col("cosine"), *hot, F.coalesce("prior", F.lit(0.5)), F.col("c_src") / k, F.col("c_tgt") / k)))


def fit_split(df: DataFrame, *keys: str, share: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(rows to fit on, rows held out) by a hash of the keys: the same ones whatever the partitioning."""
    first = F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))
    return df.where(first), df.where(~first)


def triple_scorer(triples: DataFrame, k: int, label: str = "label", seed: int = 42):
    """A perceptron 24-32-16-2 over ``triple_features``; the second class's probability is the score."""
    net = MultilayerPerceptronClassifier(layers=[len(GLOSS) + 4, 32, 16, 2], featuresCol="x", labelCol=label, maxIter=60, seed=seed)
    return net.fit(triple_features(triples.withColumn(label, F.col(label).cast("double")), k))

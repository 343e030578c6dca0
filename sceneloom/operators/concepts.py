"""Concepts: groups of scenes, their centres, labels, sizes and members, and triples of concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.vectors import dot, unit
from sceneloom.operators.tables import ranked

CENTRE_BYTES = 16 << 20  # of concept centres in one broadcast row


def number_by_size(members: DataFrame, least: int = 2, prefix: str = "concept_") -> DataFrame:
    """(node, concept_id, concept_no): communities numbered by falling size, equal sizes by a digest of the name; those under ``least`` are dropped, which leaves gaps only at the end.

    Communities of one size are ranked in parts, and shifted by the number of larger ones: there are few different sizes.
    """
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    larger = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("n").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(larger), F.lit(0))).drop("c")
    inside = ranked(sizes, ["n"], F.md5(F.col("community").cast("string")), "community")
    numbered = inside.join(before, "n").where(F.col("n") >= least).select("community", (F.col("rank") + F.col("before")).alias("concept_no"))
    return members.join(numbered, "community").select("node", F.concat(F.lit(prefix), F.col("concept_no")).alias("concept_id"), "concept_no")


def centres(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, centre, scenes): mean vector of each group scaled to unit length, by map-side combined sums."""
    mean = Summarizer.mean(array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return df.where(F.col(vec).isNotNull()).groupBy(key).agg(vector_to_array(mean).alias("m"), F.count("*").alias("scenes")).select(key, unit("m").alias("centre"), "scenes")


def means(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, mean): plain mean vector of each group."""
    mean = Summarizer.mean(array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return df.where(F.col(vec).isNotNull()).groupBy(key).agg(vector_to_array(mean).alias("mean"))


def weighted_representation(df: DataFrame, queries: DataFrame, key: str, vec: str, temperature: float = 0.01) -> DataFrame:
    """(key, v): sum of a group's vectors weighted by the softmax of their products with the group's query vector ``q``.

    The maximum and the weight sums are aggregates, so a group of any size is combined map-side.
    """
    s = df.where(F.col(vec).isNotNull()).join(queries, key).withColumn("s", dot(vec, "q"))
    top = s.groupBy(key).agg(F.max("s").alias("top"))
    w = s.join(top, key).withColumn("w", F.exp((F.col("s") - F.col("top")) / temperature))
    mean = Summarizer.metrics("mean").summary(array_to_vector(F.transform(vec, lambda x: x.cast("double"))), F.col("w"))
    return w.groupBy(key).agg(vector_to_array(mean["mean"]).alias("v"))


def text_queries(scenes: DataFrame, key: str, vec: str, text: str) -> DataFrame:
    """(key, q): mean of the vectors of a group's texts; blank texts don't count, and a group of none but blank ones has no row."""
    return means(scenes.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), key, vec).withColumnRenamed("mean", "q")


def representation(scenes: DataFrame, key: str, vec: str, text: str, text_vec: str, temperature: float = 0.01) -> DataFrame:
    """(key, v): ``weighted_representation`` by the mean text vector; the plain mean for groups without any text."""
    q = text_queries(scenes, key, text_vec, text)
    plain = means(scenes.join(q.select(key), key, "left_anti"), key, vec).withColumnRenamed("mean", "v")
    return weighted_representation(scenes, q, key, vec, temperature).unionByName(plain)


def label_distribution(scenes: DataFrame, concept: str = "concept_id", video: str = "video_id", label: str = "video_label") -> DataFrame:
    """(concept, label, videos): distinct videos, not scenes, per label."""
    return scenes.groupBy(concept, label).agg(F.countDistinct(video).alias("videos"))


def concept_sizes(scenes: DataFrame, concept: str = "concept_id", video: str = "video_id", label: str = "video_label") -> DataFrame:
    """(concept, num_scenes, num_videos, num_labels, largest_video): sizes, and the scenes of the video that has most, by two-level counts."""
    by_video = scenes.groupBy(concept, video).agg(F.count("*").alias("n"), F.max(label).alias("label"))
    return by_video.groupBy(concept).agg(
        F.sum("n").alias("num_scenes"), F.count("*").alias("num_videos"), F.countDistinct("label").alias("num_labels"), F.max("n").alias("largest_video")
    )


def network_report(concepts: DataFrame, members: DataFrame, concept: str = "concept_id") -> DataFrame:
    """(concepts, linked_scenes, avg_scenes, max_scenes, min_scenes) over all concepts; those without a member count with 0."""
    n = members.groupBy(concept).agg(F.count("*").alias("n"))
    each = concepts.select(concept).distinct().join(n, concept, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return each.agg(
        F.count("*").alias("concepts"), F.coalesce(F.sum("n"), F.lit(0)).alias("linked_scenes"), F.avg("n").alias("avg_scenes"), F.max("n").alias("max_scenes"), F.min("n").alias("min_scenes")
    )


def top_captions(scenes: DataFrame, n: int = 3, concept: str = "concept_id", caption: str = "caption") -> DataFrame:
    """(concept, caption, rank): the ``n`` longest different captions of each concept, ties in code-point order; blank ones don't count."""
    c = scenes.where(F.trim(caption) != "").select(concept, caption).distinct()
    w = Window.partitionBy(concept).orderBy(F.desc(F.length(caption)), caption)
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def widest_concepts(distribution: DataFrame, group: str, n: int = 5, concept: str = "concept_id", label: str = "video_label") -> DataFrame:
    """(group, concept, labels, rank): of each group's concepts the ``n`` with most distinct labels, ties by concept."""
    d = distribution.groupBy(group, concept).agg(F.countDistinct(label).alias("labels"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("labels"), concept))).where(F.col("rank") <= n)


def scene_concept(members: DataFrame, scenes: DataFrame, on: str, concept: str = "concept_id") -> DataFrame:
    """``scenes`` with one concept each, the smallest of several; null for those of none."""
    return scenes.join(members.groupBy(on).agg(F.min(concept).alias(concept)), on, "left")


def concept_metadata(scenes: DataFrame, concept: str = "concept_id") -> DataFrame:
    """(concept, metadata): JSON of all videos, those with most scenes first, each with all its scenes in order, with captions."""
    return _as_json(_by_video(scenes, concept), concept)


def concept_prompt(scenes: DataFrame, concept: str = "concept_id", videos: int = 5, each: int = 3) -> DataFrame:
    """(concept, metadata): what a prompt shows of ``concept_metadata``: at most ``videos`` videos and the first ``each`` scenes of each."""
    return _as_json(_by_video(scenes, concept).where(F.col("rank") <= videos).withColumn("scenes", F.slice("scenes", 1, each)), concept)


def _by_video(scenes: DataFrame, concept: str) -> DataFrame:
    c = F.coalesce("caption", F.lit("No caption available"))
    v = scenes.groupBy(concept, "video_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("scene_id", c.alias("caption")))).alias("scenes"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy(concept).orderBy(F.desc("n"), "video_id")))


def _as_json(v: DataFrame, concept: str) -> DataFrame:
    return v.groupBy(concept).agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "video_id", "n", "scenes")))).alias("metadata"))


def co_members(scenes: DataFrame, is_query: str, most: int = 5, rows: int = 20, concept: str = "concept_id", video: str = "video_id", label: str = "video_label", predicted: str | None = None) -> DataFrame:
    """(query, concept, scene_count, video, label, overlap, rank): for each query video its ``most`` strongest concepts and the other videos' distinct scenes in them, the ``rows`` best rows a query.

    Rows go by scene_count, then overlap (both falling), then concept and video. Other videos need a label, or else a
    predicted one; a concept without any stays as a row with a null video and overlap 0. As a query's rows of one
    concept differ in the overlap only, a concept needs no more than its ``rows`` first videos, so these are picked
    before they meet the queries, and a giant concept meets nobody in full.
    """
    q = scenes.where(is_query).groupBy(F.col(video).alias("query"), concept).agg(F.count("*").alias("scene_count"))
    q = q.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("scene_count"), concept))).where(F.col("r") <= most).drop("r")
    known = F.coalesce(label, predicted) if predicted else F.col(label)
    other = scenes.where(f"not ({is_query})").where(known.isNotNull()).groupBy(concept, video).agg(F.max(known).alias("label"), F.countDistinct("scene_id").alias("overlap"))
    other = other.withColumn("r", F.row_number().over(Window.partitionBy(concept).orderBy(F.desc("overlap"), video))).where(F.col("r") <= rows).drop("r")
    both = q.join(other, concept, "left").select("query", concept, "scene_count", video, "label", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    w = Window.partitionBy("query").orderBy(F.desc("scene_count"), F.desc("overlap"), concept, video)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows)


def assign(scenes: DataFrame, centres: DataFrame, key: str, vec: str, top: int = 1, temperature: float = 0.1) -> DataFrame:
    """(key, concept, p, rank): the ``top`` nearest concepts of each scene with softmax weights over all concepts.

    The centres go along in broadcast rows of at most CENTRE_BYTES, as many as their number takes. Of each row a scene
    keeps its best concepts and the row's share of the softmax; where there are several, these are merged by scene.
    """
    n, dim = centres.agg(F.count("*"), F.coalesce(F.max(F.size("centre")), F.lit(1))).first()
    blocks = max(1, -(-n * dim * 8 // CENTRE_BYTES))
    u = scenes.where(F.col(vec).isNotNull()).select(key, unit(vec).alias("u"), F.lit(1).alias("_one"))
    parts = []
    for b in range(blocks):
        rows = centres.where(F.pmod(F.xxhash64("concept_id"), F.lit(blocks)) == b).agg(F.array_sort(F.collect_list(F.struct("concept_id", "centre"))).alias("cs"), F.lit(1).alias("_one"))
        scored = u.join(F.broadcast(rows), "_one").where("size(cs) > 0").select(key, F.transform("cs", lambda c: F.struct((-dot(F.col("u"), c["centre"])).alias("o"), c["concept_id"].alias("id"))).alias("s"))
        most = -F.array_min(F.transform("s", lambda x: x["o"]))
        scored = scored.select(key, "s", most.alias("m"))
        share = F.aggregate("s", F.lit(0.0), lambda t, x: t + F.exp((-x["o"] - F.col("m")) / temperature))
        parts.append(scored.select(key, F.slice(F.array_sort("s"), 1, top).alias("s"), "m", share.alias("z")))
    each = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        each = each.groupBy(key).agg(F.max("m").alias("top"), F.collect_list(F.struct("s", "m", "z")).alias("l"))
        z = F.aggregate("l", F.lit(0.0), lambda t, x: t + x["z"] * F.exp((x["m"] - F.col("top")) / temperature))
        each = each.select(key, F.slice(F.array_sort(F.flatten(F.transform("l", lambda x: x["s"]))), 1, top).alias("s"), F.col("top").alias("m"), z.alias("z"))
    out = each.select(key, F.posexplode("s").alias("i", "b"), "m", "z")
    return out.select(key, F.col("b.id").alias("concept_id"), (F.exp((-F.col("b.o") - F.col("m")) / temperature) / F.col("z")).alias("p"), (F.col("i") + 1).alias("rank"))


def triples(links: DataFrame, scene_concepts: DataFrame) -> DataFrame:
    """(video_id, c_src, rel, c_tgt): every link with each combination of its ends' concepts."""
    s = scene_concepts.select("video_id", F.col("scene_id").alias("parent"), F.col("concept_id").alias("c_src"))
    t = scene_concepts.select("video_id", F.col("scene_id").alias("child"), F.col("concept_id").alias("c_tgt"))
    return links.join(s, ["video_id", "parent"]).join(t, ["video_id", "child"]).select("video_id", "c_src", "rel", "c_tgt")


def diversity(scene_concepts: DataFrame) -> DataFrame:
    """(video_id, diversity): distinct concepts over scenes."""
    return scene_concepts.groupBy("video_id").agg((F.countDistinct("concept_id") / F.count("*")).alias("diversity"))

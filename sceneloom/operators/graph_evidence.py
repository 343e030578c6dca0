"""Evidence from the graph: structural and similar videos as voters, concept triples, captions for hits, text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.discourse import GLOSS, known_relation
from sceneloom.functions.text import first_number, relation_label, same_caption
from sceneloom.operators.discourse import tree_text, undirected


def best_structural(matches: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` matches of each query with most nodes, then most sequences, then by video; ``rank`` from 1. Rows of one match_no are one."""
    m = matches.where("query_video_id is not null and video_id is not null").groupBy("match_no").agg(
        F.max(F.struct("query_video_id", "video_id", "video_label", "max_nodes_matched", "total_matched_sequences")).alias("m")
    )
    w = Window.partitionBy("query_video_id").orderBy(F.desc_nulls_last("max_nodes_matched"), F.desc_nulls_last("total_matched_sequences"), "video_id", "match_no")
    return m.select("match_no", "m.*").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_similar(similar: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most similar videos of each query: highest score of a video's rows, ties by video; null and NaN scores don't count."""
    s = similar.where("query_video_id is not null and video_id is not null and avg_score is not null and not isnan(avg_score)")
    s = s.groupBy("query_video_id", "video_id").agg(F.max("avg_score").alias("avg_score"), F.max("video_label").alias("video_label"))
    w = Window.partitionBy("query_video_id").orderBy(F.desc("avg_score"), "video_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def graph_voters(matches: DataFrame, similar: DataFrame, k: int = 5) -> DataFrame:
    """(query, video_label): one vote of each of the best structural and the best similar videos."""
    both = best_structural(matches, k).select("query_video_id", "video_label").unionByName(best_similar(similar, k).select("query_video_id", "video_label"))
    return both.withColumnRenamed("query_video_id", "query")


def match_triples(asked: DataFrame, held: DataFrame, limit: int = 200) -> DataFrame:
    """(query, video_id, c_src, rel, c_tgt, row): library triples equal to one of a query's, at most ``limit`` a query in the order of triple and video.

    The asked triples are made distinct before they meet the library's, so a triple that is asked often is joined once.
    As matches go by triple and then by video, of each triple only the first ``limit`` videos (and one more, as the
    query itself is none) can be among them: a hot triple is cut to these before it meets the queries, which loses nothing.
    """
    keys = ["c_src", "rel", "c_tgt"]
    first = Window.partitionBy(*keys).orderBy("video_id")
    few = held.select("video_id", *keys).where("video_id is not null").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit + 1).drop("_r")
    m = asked.select("query", *keys).distinct().join(few, keys).where("query <> video_id")
    w = Window.partitionBy("query").orderBy(*keys, "video_id")
    return m.withColumn("row", F.row_number().over(w)).where(F.col("row") <= limit)


def hit_captions(hits: DataFrame, captions: DataFrame, n: int = 40) -> DataFrame:
    """``caption`` for hits(hit, video_id, scene_id, said): the scene's own, else that of the first scene whose caption holds the first ``n`` characters of ``said`` or the other way round, else the video's first."""
    own = captions.select("video_id", "scene_id", F.col("caption").alias("own"))
    alike = (
        hits.where("said <> ''").join(own.where("own is not null"), ["video_id", "scene_id"], "left_anti").select("hit", "video_id", "said")
        .join(captions.where("caption <> ''").select("video_id", F.col("scene_id").alias("s"), F.col("caption").alias("c")), "video_id")
        .where(same_caption("said", "c", n))
        .groupBy("hit").agg(F.min_by("c", "s").alias("alike"))
    )
    first = captions.where("caption is not null").groupBy("video_id").agg(F.min_by("caption", "scene_id").alias("first"))
    out = hits.join(own, ["video_id", "scene_id"], "left").join(alike, "hit", "left").join(first, "video_id", "left")
    return out.withColumn("caption", F.coalesce("own", "alike", "first")).drop("own", "alike", "first")


def evidence_block(hits: DataFrame, query: str, line: Column, title: str, none: str, queries: DataFrame | None = None) -> DataFrame:
    """(query, block): a title and a line a hit in rank order; ``none`` for queries without hits. Hits are few a query: a top-k."""
    b = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("x"))
    b = b.select(query, F.concat(F.lit(title + "\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n")).alias("block"))
    return b if queries is None else queries.select(query).distinct().join(b, query, "left").select(query, F.coalesce("block", F.lit(none)).alias("block"))


def pruned_tree(clean: DataFrame, captions: DataFrame, hits: DataFrame) -> DataFrame:
    """``tree_text`` of each hit scene (video_id, scene_id) with its parents and children only."""
    near = undirected(clean).select("video_id", F.col("a").alias("scene_id"), F.col("b").alias("kept")).join(hits.select("video_id", "scene_id").distinct(), ["video_id", "scene_id"])
    kept = near.select("video_id", F.col("kept").alias("scene_id")).unionByName(hits.select("video_id", "scene_id")).distinct()
    h = hits.select("video_id", F.col("scene_id").alias("h")).distinct()
    down, up = (clean.join(h.withColumnRenamed("h", end), ["video_id", end], "left_semi") for end in ("parent", "child"))
    edges = down.unionByName(up).distinct()
    return tree_text(edges, captions.join(kept, ["video_id", "scene_id"], "left_semi"))


def valid_edges(raw: DataFrame, sizes: DataFrame) -> DataFrame:
    """(video_id, src, tgt, rel) of edges(video_id, src, tgt, rel) written as free text: the first number of each end, in range, not a loop, known relation."""
    e = raw.select("video_id", first_number("src").alias("src"), first_number("tgt").alias("tgt"), relation_label("rel").alias("rel"))
    ok = e.join(sizes.select("video_id", "n"), "video_id").where("src >= 0 and src < n and tgt >= 0 and tgt < n and src <> tgt")
    return ok.where(F.col("rel").isin(*GLOSS)).select("video_id", "src", "tgt", known_relation("rel").alias("rel"))


def unit_tokens(tokens: DataFrame) -> DataFrame:
    """(doc, edu, sent, first_tok, last_tok, deps) of merged token rows: each unit's extent and its dependency labels in order."""
    return tokens.groupBy("doc", "edu").agg(
        F.min("sent").alias("sent"), F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"), F.array_sort(F.collect_list(F.struct("tok", "dep"))).alias("d")
    ).select("doc", "edu", "sent", "first_tok", "last_tok", F.transform("d", lambda x: x["dep"]).alias("deps"))


def fidelity(original: Column, occluded: Column) -> Column:
    """What a prediction loses without an explanation's scenes."""
    return original - occluded


def sparsity(kept: Column, total: Column) -> Column:
    """The share of scenes an explanation leaves out; null without scenes."""
    return F.when(total > 0, 1 - kept / total)


def top_in(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """(group, item, n, rank): the most frequent items of each group, ties by item."""
    c = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))).where(F.col("rank") <= n)


def clip_number(path: str | Column) -> Column:
    """The scene number in a clip's name: ``clip_<n>_...``, else digits alone before the extension; null for other names."""
    c = F.col(path) if isinstance(path, str) else path
    n = F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"clip_(\d+)_[^/\\]*$", r"(?:^|[/\\])(\d+)\.[A-Za-z0-9]+$")))
    return n.try_cast("int")


def clip_scenes(clips: DataFrame, key: str, path: str, order: str) -> DataFrame:
    """``clip_scene``: the number in a clip's name, else its place (from 0) among the clips of its key by ``order``."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return clips.withColumn("clip_scene", F.coalesce(clip_number(path), at))


def graph_inputs(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(video_id, scene_ids, vectors, edges): what a graph network reads of each video: its scenes by number, and its edges (a, b, code) by place.

    One row a video is the contract of that boundary; the latest row of a scene counts, edges may be missing.
    """
    v = vectors.where("embedding is not null").groupBy("video_id", "scene_id").agg(F.max_by("embedding", "written_at").alias("embedding"))
    v = v.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("scene_id", "embedding"))).alias("v"))
    e = edges.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("link_pos", "a", "b", "code"))).alias("e"))
    none = F.array().cast("array<struct<a:int,b:int,code:int>>")
    kept = F.transform("e", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["code"].alias("code")))
    return v.join(e, "video_id", "left").select("video_id", F.col("v.scene_id").alias("scene_ids"), F.col("v.embedding").alias("vectors"), F.coalesce(kept, none).alias("edges"))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """``batch``: the number of the group of ``size`` that a row's place in its key's numbering (from 0) falls in."""
    return df.withColumn("batch", F.floor(F.col(key) / size).cast("bigint"))

"""Queries of evidence from the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneloom.functions.discourse import GLOSS, relation_code
from sceneloom.operators import discourse as ds
from sceneloom.operators import evidence as ev
from sceneloom.operators import graph_evidence as ge
from sceneloom.plans.discourse import LINKS
from sceneloom.runtime import table


def structural_top(spark: SparkSession, sf: str) -> DataFrame:
    return ge.best_structural(table(spark, sf, "structural_matches")).select("query_video_id", "video_id", "match_no", "rank")


def similar_top(spark: SparkSession, sf: str) -> DataFrame:
    return ge.best_similar(table(spark, sf, "similarity_videos")).select("query_video_id", "video_id", F.round("avg_score", 6).alias("avg_score"), "rank")


def graph_lean(spark: SparkSession, sf: str) -> DataFrame:
    return ev.lean(ge.graph_voters(table(spark, sf, "structural_matches"), table(spark, sf, "similarity_videos")))


def concept_triple_match(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of test videos among all candidates' triples."""
    held = table(spark, sf, "scored_candidates").where("video_id is not null").select("video_id", "c_src", F.col("rst_type").alias("rel"), "c_tgt")
    test = table(spark, sf, "video_samples").where("lower(trim(split)) = 'test'").select("video_id").distinct()
    asked = held.join(test, "video_id", "left_semi").withColumnRenamed("video_id", "query")
    return ge.match_triples(asked, held)


def similarity_block(spark: SparkSession, sf: str) -> DataFrame:
    top = ge.best_similar(table(spark, sf, "similarity_videos"), 3)
    line = F.format_string("#%d %s label %s score %.4f", "rank", "video_id", F.coalesce(F.col("video_label").cast("string"), F.lit("unknown")), "avg_score")
    return ge.evidence_block(top, "query_video_id", line, "Similar videos:", "No similar video.", table(spark, sf, "structural_matches").where("query_video_id is not null"))


def hit_caption(spark: SparkSession, sf: str) -> DataFrame:
    """Captions for the scenes after those of the vectors, some of which are not there; what was said is a part of the vector's own scene's caption."""
    caps = table(spark, sf, "scenes").groupBy("video_id", "scene_id").agg(F.max_by("caption", "scene_no").alias("caption"))
    hits = table(spark, sf, "scene_vectors").select(F.col("scene_uid").alias("hit"), "video_id", (F.col("scene_id") + 1).alias("scene_id")).distinct()
    said = caps.select("video_id", (F.col("scene_id") + 1).alias("scene_id"), F.substring("caption", 3, 60).alias("said"))
    return ge.hit_captions(hits.join(said, ["video_id", "scene_id"], "left"), caps).select("hit", "caption")


def tag_top(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "scenes").dropDuplicates(["scene_no"]).select("source", F.explode("audio_tags").alias("tag"))
    return ge.top_in(tags, "source", "tag", 3)


def clip_scene_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"]).where("clip_path is not null")
    n = F.col("clip_scene")
    return ge.clip_scenes(s, "video_id", "clip_path", "scene_no").select("scene_no", n, (n == F.col("scene_id")).alias("same"))


def sound_top(spark: SparkSession, sf: str) -> DataFrame:
    """The two most frequent sounds of each source, apart for tags (one word) and vibes (several)."""
    tags = table(spark, sf, "scenes").dropDuplicates(["scene_no"]).select("source", F.explode("audio_tags").alias("tag")).where("source is not null")
    kind = F.when(F.col("tag").contains(" "), "vibe").otherwise("tag")
    return ge.top_in(tags.select(F.concat_ws("/", "source", kind).alias("source"), "tag"), "source", "tag", 2)


def graph_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of what a graph network reads of each video."""
    links = ds.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))
    edges = links.select("video_id", "link_pos", (F.col("src") - 1).alias("a"), (F.col("tgt") - 1).alias("b"), relation_code("rel").alias("code"))
    g = ge.graph_inputs(table(spark, sf, "scene_vectors"), edges)
    return g.select("video_id", F.size("scene_ids").alias("scenes"), F.get("scene_ids", F.lit(0)).alias("first_scene"), F.size("edges").alias("edges"), F.aggregate("edges", F.lit(0), lambda s, x: s + x["code"]).alias("codes"))


def explanation_sparsity(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with a caption over all scenes of a video, as an explanation's size."""
    v = table(spark, sf, "scenes").dropDuplicates(["scene_no"]).groupBy("video_id").agg(F.count_if(F.length("caption") > 60).alias("k"), F.count("*").alias("n"))
    return v.select("video_id", F.round(ge.sparsity(F.col("k"), F.col("n")), 6).alias("sparsity"))


def explanation_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    """What the best score of each query loses where its best candidate's source concept is left out."""
    s = table(spark, sf, "scored_candidates").where("query_video_id is not null and c_src is not null and mlp_score is not null and not isnan(mlp_score)")
    best = s.groupBy("query_video_id", "c_src").agg(F.max("mlp_score").alias("m"))
    w = Window.partitionBy("query_video_id").orderBy(F.desc("m"), "c_src")
    two = best.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("query_video_id").agg(F.max("m").alias("a"), F.max(F.when(F.col("r") == 2, F.col("m"))).alias("b"))
    return two.select("query_video_id", F.round(ge.fidelity(F.col("a"), F.coalesce("b", F.lit(0.0))), 6).alias("fidelity"))


def relation_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    links = ds.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))
    return links.groupBy("rel").agg(F.count("*").alias("links"), F.countDistinct("video_id").alias("videos"))


def first_scene_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The pruned tree around each video's first scene."""
    links = ds.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))
    caps = table(spark, sf, "scenes").groupBy("video_id", "scene_id").agg(F.max_by("caption", "scene_no").alias("caption"))
    return ge.pruned_tree(links, caps, caps.where("scene_id = 0").select("video_id", "scene_id"))


QUERIES = {
    f.__name__: f
    for f in (
        structural_top, similar_top, graph_lean, concept_triple_match, similarity_block, hit_caption, tag_top, clip_scene_ids, sound_top, graph_inputs, explanation_sparsity, explanation_fidelity, relation_type_counts, first_scene_tree,
    )
}
_TOP = """
with m as (select distinct on (match_no) * from structural_matches where query_video_id is not null and video_id is not null),
st as (select query_video_id, video_id, match_no, video_label, row_number() over (partition by query_video_id order by max_nodes_matched desc nulls last, total_matched_sequences desc nulls last, video_id, match_no) as rank from m qualify rank <= 5),
sv as (select query_video_id, video_id, max(avg_score) as avg_score, max(video_label) as video_label from similarity_videos where avg_score is not null and not isnan(avg_score) and query_video_id is not null and video_id is not null group by 1, 2),
si as (select *, row_number() over (partition by query_video_id order by avg_score desc, video_id) as rank from sv qualify rank <= 5)
"""
_S = "(select distinct on (scene_no) * from scenes)"
SQL = {
    "structural_top": _TOP + "select query_video_id, video_id, match_no, rank::int as rank from st",
    "similar_top": _TOP + "select query_video_id, video_id, round(avg_score, 6) as avg_score, rank::int as rank from si",
    "graph_lean": _TOP + """, v as (select query_video_id as query, video_label as l, count(*) as n from (select query_video_id, video_label from st union all select query_video_id, video_label from si) where video_label is not null group by 1, 2),
r as (select *, coalesce(lead(n) over (partition by query order by n desc, l), 0) as nx, row_number() over (partition by query order by n desc, l) as r from v)
select query, case when n > nx then l end as lean, case when n = nx then 'mixed' when n = nx + 1 then 'weak' else 'strong' end as confidence from r where r = 1""",
    "concept_triple_match": """with h as (select distinct video_id, c_src, rst_type as rel, c_tgt from scored_candidates where video_id is not null),
q as (select distinct video_id as query, c_src, rel, c_tgt from h where video_id in (select video_id from video_samples where lower(trim(split)) = 'test'))
select query, video_id, c_src, rel, c_tgt, (row_number() over (partition by query order by c_src, rel, c_tgt, video_id))::int as row
from q join h using (c_src, rel, c_tgt) where query <> video_id qualify row <= 200""",
    "similarity_block": _TOP + """, b as (select query_video_id, 'Similar videos:' || chr(10) || string_agg('#' || rank || ' ' || video_id || ' label ' || coalesce(video_label::varchar, 'unknown') || ' score ' || printf('%.4f', avg_score), chr(10) order by rank) as block
from si where rank <= 3 group by 1) select query_video_id, coalesce(block, 'No similar video.') as block from (select distinct query_video_id from structural_matches where query_video_id is not null) left join b using (query_video_id)""",
    "hit_caption": """with c as (select video_id, scene_id, arg_max(caption, scene_no) as caption from scenes group by 1, 2), f as (select video_id, arg_min(caption, scene_id) as first from c where caption is not null group by 1),
h as (select distinct v.scene_uid as hit, v.video_id, v.scene_id + 1 as scene_id, substr(o.caption, 3, 60) as said from scene_vectors v left join c o on o.video_id = v.video_id and o.scene_id = v.scene_id),
a as (select hit, arg_min(c.caption, c.scene_id) as alike from h join c on c.video_id = h.video_id and c.caption <> '' where said <> '' and (contains(said, substr(c.caption, 1, 40)) or contains(c.caption, substr(said, 1, 40))) group by 1)
select hit, coalesce(c.caption, alike, first) as caption from h left join c on c.video_id = h.video_id and c.scene_id = h.scene_id left join a using (hit) left join f on f.video_id = h.video_id""",
    "tag_top": f"""select source, tag, count(*) as n, (row_number() over (partition by source order by count(*) desc, tag))::int as rank from (select source, unnest(audio_tags) as tag from {_S})
where source is not null and tag is not null group by 1, 2 qualify rank <= 3""",
    "clip_scene_ids": rf"select scene_no, regexp_extract(clip_path, '(\d+)\.mp4$', 1)::int as clip_scene, clip_scene = scene_id as same from {_S} where clip_path is not null",
    "sound_top": f"""select source || '/' || case when contains(tag, ' ') then 'vibe' else 'tag' end as source, tag, count(*) as n, (row_number() over (partition by source || '/' || case when contains(tag, ' ') then 'vibe' else 'tag' end order by count(*) desc, tag))::int as rank
from (select source, unnest(audio_tags) as tag from {_S}) where source is not null and tag is not null group by 1, 2 qualify rank <= 2""",
    "graph_inputs": LINKS + f""", v as (select distinct video_id, scene_id from scene_vectors where embedding is not null), ed as (select video_id, count(*) as n, sum(list_position([{', '.join(repr(t) for t in GLOSS)}], rel) - 1) as c from k group by 1)
select video_id, count(*)::int as scenes, min(scene_id) as first_scene, coalesce(max(n), 0)::int as edges, coalesce(max(c), 0)::int as codes from v left join ed using (video_id) group by 1""",
    "explanation_sparsity": f"""select video_id, round(1 - count(*) filter (length(caption) > 60) / count(*)::double, 6) as sparsity from {_S} group by 1""",
    "explanation_fidelity": """with b as (select query_video_id, c_src, max(mlp_score) as m from scored_candidates where query_video_id is not null and c_src is not null and mlp_score is not null and not isnan(mlp_score) group by 1, 2),
r as (select *, row_number() over (partition by query_video_id order by m desc, c_src) as r from b)
select query_video_id, round(max(m) - coalesce(max(m) filter (r = 2), 0.0), 6) as fidelity from r where r <= 2 group by 1""",
    "relation_type_counts": LINKS + "select rel, count(*) as links, count(distinct video_id) as videos from k group by 1",
}

"""Queries of the discourse channel, of graph evidence by rank, and of what is written for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneloom.functions import text as tx
from sceneloom.functions.captions import json_object, parsed_captions
from sceneloom.functions.discourse import CANONICAL, GLOSS
from sceneloom.functions.rst_tree import aligned_units
from sceneloom.operators import channels as ch
from sceneloom.operators import concepts as cp
from sceneloom.operators import discourse as ds
from sceneloom.operators import ensemble as en
from sceneloom.operators import tables as tb
from sceneloom.plans.discourse import LINKS, PATHS
from sceneloom.plans.retrieval import DIM, EDGES, SCENES, edges, scenes
from sceneloom.runtime import cut, table
from sceneloom.sources.readers import scene_guard, video_records


def _topologies(spark: SparkSession, sf: str) -> DataFrame:
    return ds.topology(edges(spark, sf).select("video_id", "rel")).select("video_id", "topology")


def discourse_blend_topk(spark: SparkSession, sf: str) -> DataFrame:
    """For each scene of the test videos thirty library scenes; content and discourse blended, the best of each video, five videos."""
    s = cut(scenes(spark, sf))
    hits = ch.discourse_evidence(s.where("is_test"), s.where("not is_test"), cut(_topologies(spark, sf)), "vec_id", "embedding", DIM)
    return hits.select("query", "rank", "video_id", F.col("hit").alias("scene"), *(F.round(c, 6).alias(c) for c in ("dense", "topology", "score")))


def discourse_video_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The variant with one search a video, by its mean vector."""
    s = cut(scenes(spark, sf))
    q = cp.means(s.where("is_test"), "video_id", "embedding").select((-F.col("video_id") - 1).alias("vec_id"), "video_id", F.col("mean").alias("embedding"))
    hits = ch.discourse_evidence(q, s.where("not is_test"), cut(_topologies(spark, sf)), "vec_id", "embedding", DIM)
    return hits.select("query", "rank", "video_id", F.col("hit").alias("scene"), *(F.round(c, 6).alias(c) for c in ("dense", "topology", "score")))


def _structural(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked chains of the test videos, paths of the labelled other videos, matches)."""
    paths = cut(ds.relation_paths(cut(ds.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples")))))
    predicted = table(spark, sf, "predictions").groupBy(F.col("folder_name").alias("video_id")).agg(F.max("predicted_label").alias("predicted"))
    known = table(spark, sf, "video_samples").groupBy(tx.canonical_video_id("video_id").alias("video_id")).agg(F.max("video_label").alias("label"), F.max(F.lower(F.trim("split")) == "test").alias("test"))
    known = cut(known.join(predicted, "video_id", "left").select("video_id", F.coalesce("test", F.lit(False)).alias("test"), F.coalesce("label", "predicted").alias("label")))
    asked = cut(ds.asked_chains(paths.join(known.where("test"), "video_id", "left_semi")))
    library = paths.join(known.where("not test and label is not null"), "video_id", "left_semi")
    return asked, library, cut(ds.structural_matches(asked, library))


def structural_match(spark: SparkSession, sf: str) -> DataFrame:
    return _structural(spark, sf)[2]


def structural_match_details(spark: SparkSession, sf: str) -> DataFrame:
    """The paths behind the matches, counted by chain, with the smallest scene they touch."""
    asked, library, matches = _structural(spark, sf)
    d = ds.match_details(matches, asked, library)
    return d.groupBy("query_id", "video_id", "chain", "length").agg(F.count("*").alias("paths"), F.min(F.array_min("nodes")).alias("first_scene"))


def matched_video_details(spark: SparkSession, sf: str) -> DataFrame:
    """Label and discourse of the videos that structural matches or similar videos name."""
    wanted = table(spark, sf, "structural_matches").select("video_id").union(table(spark, sf, "similarity_videos").select("video_id")).where("video_id is not null").distinct()
    links = ds.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))
    s = ds.discourse_summary(links).join(wanted, "video_id", "left_semi")
    labels = table(spark, sf, "video_samples").groupBy(tx.canonical_video_id("video_id").alias("video_id")).agg(F.max("video_label").alias("label"))
    return s.join(labels, "video_id", "left").select("video_id", "label", "dominant", "num_relations", "relation_statistics")


def concept_network_report(spark: SparkSession, sf: str) -> DataFrame:
    """Over twelve concepts, of which the labels fill at most ten."""
    members = table(spark, sf, "embeddings").select(F.concat(F.lit("concept_"), "label").alias("concept_id"))
    names = spark.range(12).select(F.concat(F.lit("concept_"), "id").alias("concept_id"))
    return cp.network_report(names, members).withColumn("avg_scenes", F.round("avg_scenes", 6))


def concept_captions(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest captions of each source, as of a concept."""
    return cp.top_captions(table(spark, sf, "scenes").where("source is not null").withColumnRenamed("source", "concept_id"))


def widest_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each relation the five source concepts with most labels."""
    c = table(spark, sf, "scored_candidates").where("rst_type is not null and c_src is not null")
    return cp.widest_concepts(c, "rst_type", concept="c_src")


def similar_video_concept(spark: SparkSession, sf: str) -> DataFrame:
    """The concept of each scene that a link joins to its parent, where it has one: of concepts over every label but 9."""
    s = scenes(spark, sf)
    members = s.where("rel_code <> 9").select("vec_id", F.concat(F.lit("concept_"), "rel_code").alias("concept_id"))
    return cp.scene_concept(members, s.select("vec_id", "video_id"), "vec_id").groupBy("video_id").agg(F.count("*").alias("scenes"), F.count("concept_id").alias("with_concept"), F.min("concept_id").alias("first_concept"))


def video_representation_captioned(spark: SparkSession, sf: str) -> DataFrame:
    """Representation by the mean of the text vectors (here the reversed ones) of captioned scenes; videos without any caption take the plain mean."""
    captions = table(spark, sf, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("text").alias("caption"))
    s = scenes(spark, sf).join(captions, "vec_id", "left").withColumn("caption", F.when(F.col("video_id") % 9 > 0, F.col("caption"))).withColumn("said", F.reverse("embedding"))
    r = cp.representation(cut(s), "video_id", "embedding", "caption", "said")
    return r.select("video_id", F.posexplode("v").alias("i", "x")).select("video_id", "i", F.round("x", 5).alias("x"))


def graph_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and maximum of each dimension over a video's scenes."""
    p = ch.pooled(scenes(spark, sf), "video_id", "embedding", DIM)
    return p.select("video_id", F.posexplode("pooled").alias("i", "x")).select("video_id", "i", F.round("x", 6).alias("x"))


def nearest_code(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of ten codes, the label means, for each scene."""
    s = scenes(spark, sf)
    codes = cp.means(s.withColumnRenamed("rel_code", "code"), "code", "embedding").withColumnRenamed("mean", "embedding")
    return ch.nearest_code(s, codes, "vec_id", "embedding", "code").withColumn("distance", F.round("distance", 5))


_TASK = "Give the label, an explanation and improvements."
_OPENING = "You judge how engaging a video is."
_SOURCES = {"milvus": "Similar videos show what worked elsewhere.", "graph": "The graph shows how scenes hang together."}
_ALONE = "There is no reference; judge by the video alone."
_MEANING = {0: "low", 1: "neutral", 2: "high"}


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with their blocks: scene captions, and a line for each channel that has a lean."""
    p = table(spark, sf, "predictions").dropDuplicates(["record_no"])
    line = lambda c: F.when(F.col(f"{c}_lean").isNotNull(), F.format_string(f"{c} %d (%s)", f"{c}_lean", F.coalesce(f"{c}_confidence", F.lit("none"))))
    scenes_ = F.array_join(F.transform("input_scene_captions", lambda x, i: F.format_string("[%d] %s", i, F.coalesce(x, F.lit("No caption")))), "\n")
    return p.select("record_no", "evidence_mode", "token_count", scenes_.alias("scenes"), *(line(c).alias(c) for c in ("content", "narrative", "graph")))


def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each prediction: blocks by mode, those that overflow replaced by their notice."""
    kept = ch.fitted_blocks("token_count", 512, graph="graph", narrative="narrative", content="content")
    body = ch.user_prompt(
        "evidence_mode", ch.titled("Scenes:", "scenes", "No scenes."), ch.titled("Similar videos:", kept["content"]), ch.titled("Discourse:", kept["narrative"]), ch.titled("Graph:", kept["graph"]), _TASK
    )
    return _prompts(spark, sf).select("record_no", body.alias("prompt"))


def prompt_system(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "predictions").select("evidence_mode", ch.system_prompt("evidence_mode", _OPENING, _SOURCES, _ALONE, _MEANING).alias("prompt")).distinct()


def discourse_block(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten links of each video as lines of a block, in words."""
    links = ds.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))
    first = links.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy("link_pos"))).where("r <= 10")
    words = F.create_map(*(F.lit(x) for kv in GLOSS.items() for x in kv))
    return ch.numbered_lines(first, "video_id", "link_pos", F.format_string("Scene %d %s Scene %d", "parent", F.element_at(words, F.col("rel")), "child"))


def ensemble_content_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The two-label variant whose ties fall back to the verdict and then to the content channel alone."""
    c = {n: (F.col(f"{n}_lean"), F.col(f"{n}_confidence")) for n in ("content", "narrative", "graph")}
    p = table(spark, sf, "predictions").dropDuplicates(["record_no"])
    of = lambda *n: en.ensemble(F.col("predicted_label"), *(c[x] for x in n), labels=(0, 1), first_only=True)
    return p.select("record_no", of("content", "narrative").alias("hybrid"), of("content", "narrative", "graph").alias("full"))


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Video nodes: registrations before 2025 upserted with the later ones, field by field."""
    v = table(spark, sf, "video_samples").select(tx.canonical_video_id("video_id").alias("video_id"), "video_label", "source", F.struct("ingested_at", "sample_no").alias("at"))
    split = F.timestamp_micros(F.lit(1735689600000000))
    return tb.merge_nodes(v.where(F.col("at.ingested_at") < split), v.where(F.col("at.ingested_at") >= split), ["video_id"], "at").select("video_id", "video_label", "source")


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Typed edges between scenes, each once, and the edge from each video to its scenes."""
    links = cut(ds.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples")))
    uid = lambda c: tx.scene_uid("video_id", c)
    typed = links.select(uid("parent").alias("src"), uid("child").alias("tgt"), "rel")
    has = links.select("video_id", F.explode(F.array("parent", "child")).alias("s")).select(F.col("video_id").alias("src"), uid("s").alias("tgt"), F.lit("HAS_SCENE").alias("rel"))
    return tb.merge_edges(typed, has, ["src", "tgt"], "rel").groupBy("rel").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


def label_map_update(spark: SparkSession, sf: str) -> DataFrame:
    """The map of the videos registered so far, with the predicted labels of videos whose vectors are there."""
    now = table(spark, sf, "video_samples").where("video_label >= 0 and video_id is not null").select("video_id", F.col("video_label").alias("label")).distinct()
    more = table(spark, sf, "predictions").select(F.col("folder_name").alias("video_id"), F.col("predicted_label").alias("label"))
    return tb.add_labels(now, more, table(spark, sf, "scene_vectors"), "video_id", "label")


def tried_videos(spark: SparkSession, sf: str) -> DataFrame:
    return tb.add_keys(table(spark, sf, "predictions").select(F.col("folder_name").alias("video_id")), table(spark, sf, "video_samples").select("video_id"), "video_id")


def complete_records(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of complete videos by video, and what the rest is rejected for."""
    rows, bad = video_records(table(spark, sf, "scenes"), table(spark, sf, "scene_vectors"), table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))
    good = rows.groupBy("video_id").agg(F.count("*").alias("scenes"), F.max("links").alias("links"))
    reasons = bad.groupBy("reason").agg(F.count("*").alias("scenes"), F.lit(None).cast("bigint").alias("links"))
    return reasons.withColumnRenamed("reason", "what").unionByName(good.withColumnRenamed("video_id", "what"))


def caption_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each video has enough text units (the captions with an end) and a caption for each scene."""
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"]).groupBy("video_id").agg(F.collect_list(F.struct("scene_id", "caption")).alias("s"))
    units = F.filter(F.transform("s", lambda x: x["caption"]), lambda c: c.endswith("."))
    return scene_guard(s, units, F.transform("s", lambda x: F.coalesce(x["caption"], F.lit("")))).select("video_id", "reason")


def video_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' line numbers and quantities as frames and rates."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("frames"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") * 12.5).alias("fps"))
    return li.select("l_orderkey", "l_linenumber", F.round(tx.duration(F.col("frames"), F.col("fps")), 6).alias("seconds"))


def vision_json(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a raw output holds a sound JSON object, and its label there."""
    p = table(spark, sf, "predictions").dropDuplicates(["record_no"]).select("record_no", json_object("raw_llm_output").alias("j"))
    return p.select("record_no", F.col("j").isNotNull().alias("sound"), F.get_json_object("j", "$.predicted_label").alias("label"))


def caption_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Captions written as batches of JSON, some of them fenced, and read back."""
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"]).where("caption is not null and scene_id >= 0").select("video_id", "scene_id", "caption").distinct()
    rows = s.groupBy("video_id").agg(F.to_json(F.collect_list(F.struct("scene_id", "caption"))).alias("j"))
    fenced = F.when(F.length("video_id") % 2 == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.concat(F.lit('{"scenes": '), "j", F.lit("}")))
    return rows.select("video_id", F.explode(parsed_captions(fenced)).alias("c")).select("video_id", "c.*")


def token_units(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each caption aligned to its sentences: the number of words in each."""
    s = table(spark, sf, "scenes").dropDuplicates(["scene_no"]).where("trim(caption) <> ''").select("scene_no", F.split(F.trim("caption"), r"\s+").alias("t"), F.split(F.trim("caption"), r"(?<=\.) +").alias("u"))
    return s.select("scene_no", F.explode(aligned_units("t", "u")).alias("unit")).groupBy("scene_no", "unit").agg(F.count("*").alias("words"))


_CANON = ", ".join(f"'{t}'" for t in CANONICAL)
_TOPO = f""", c as (select unnest([{_CANON}]) as t, unnest(range({len(CANONICAL)})) as o), vids as (select distinct video_id from e),
tp as (select v.video_id, list(coalesce(k.n, 0)::double order by o) as t from vids v cross join c left join (select video_id, rel, count(*) as n from e group by 1, 2) k on k.video_id = v.video_id and k.rel = c.t group by 1),
tv as (select video_id, t, sqrt(list_sum([x * x for x in t])) as z from tp)
"""
_TOP = """, b as (select x.asker, x.video_id, x.hit, x.c, case when qa.z * ta.z > 0 then list_dot_product(qa.t, ta.t) / (qa.z * ta.z) else 0.0 end as topo
  from x join tv ta on ta.video_id = x.video_id left join tv qa on qa.video_id = x.asker),
f as (select *, round(0.7 * c + (1 - 0.7) * topo, 9) as score from b qualify row_number() over (partition by asker, video_id order by score desc, hit) = 1)
select asker as query, (row_number() over (partition by asker order by score desc, video_id))::int as rank, video_id, hit as scene, round(c, 6) as dense, round(topo, 6) as topology, round(score, 6) as score from f qualify rank <= 5"""
_P = "(select distinct on (record_no) * from predictions)"
_S = "(select distinct on (scene_no) * from scenes)"
_DIMS = "(select unnest(range(64)) as i)"
_STRUCT = LINKS + PATHS + r""", vs as (select case when regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) <> '' then regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) else trim(video_id) end as video_id, video_label, lower(trim(split)) = 'test' as t from video_samples),
kn as (select vs.video_id, coalesce(bool_or(t), false) as test, coalesce(max(video_label), max(predicted_label)) as label from vs left join (select folder_name, max(predicted_label) as predicted_label from predictions group by 1) on folder_name = vs.video_id group by 1),
lp as (select p.* from p join kn using (video_id) where test qualify row_number() over (partition by video_id order by len(chain) desc, array_to_string(chain, '>'), links) <= 50),
ac as (select distinct video_id as query_id, array_to_string(chain, '>') as chain from lp),
ml as (select distinct video_id, array_to_string(chain, '>') as chain, nodes, links from p join kn using (video_id) where not test and label is not null),
mm as (select query_id, video_id, max(len(nodes))::int as max_nodes, count(*) as matched from ac join ml using (chain) where query_id <> video_id group by 1, 2),
mt as (select *, (row_number() over (partition by query_id order by max_nodes desc, matched desc, video_id))::int as rank from mm qualify rank <= 5)
"""


def _tie(channels: tuple[str, ...]) -> str:
    votes = ["predicted_label", *(f"{c}_lean" for c in channels)]
    zero, one = (" + ".join(f"coalesce(({v} = {k})::int, 0)" for v in votes) for k in (0, 1))
    strong = ", ".join(f"case when {c}_confidence = 'strong' and {c}_lean in (0, 1) then {c}_lean end" for c in channels)
    return f"case when {zero} = 0 and {one} = 0 then -1 when {zero} > {one} then 0 when {one} > {zero} then 1 else coalesce({strong}, case when predicted_label in (0, 1) then predicted_label end, content_lean) end"


_NOTICE = dict(ch.OVERFLOW)
QUERIES = {
    f.__name__: f
    for f in (
        discourse_blend_topk, discourse_video_topk, structural_match, structural_match_details, matched_video_details, concept_network_report, concept_captions, widest_concepts, similar_video_concept,
        video_representation_captioned, graph_pooling, nearest_code, prompt_text, prompt_system, discourse_block, ensemble_content_fallback, graph_nodes, graph_edges, label_map_update, tried_videos,
        complete_records, caption_guard, video_durations, vision_json, caption_batches, token_units,
    )
}
SQL = {
    "discourse_blend_topk": EDGES + _TOPO + """, x as (select q.video_id as asker, l.video_id, l.vec_id as hit, round(list_dot_product(q.u, l.u), 9) as c from n q, n l where q.is_test and not l.is_test
  qualify row_number() over (partition by q.vec_id order by c desc, l.vec_id) <= 30)""" + _TOP,
    "discourse_video_topk": EDGES + _TOPO + f""", m as (select video_id, list(x order by i) as v from (select video_id, i, avg(e[i + 1]) as x from s, {_DIMS} where is_test group by 1, 2) group by 1),
q as (select video_id, [x / sqrt(list_sum([y * y for y in v])) for x in v] as u from m),
x as (select q.video_id as asker, l.video_id, l.vec_id as hit, round(list_dot_product(q.u, l.u), 9) as c from q, n l where not l.is_test qualify row_number() over (partition by q.video_id order by c desc, l.vec_id) <= 30)""" + _TOP,
    "structural_match": _STRUCT + "select query_id, video_id, max_nodes, matched, rank from mt",
    "structural_match_details": _STRUCT + """select query_id, video_id, chain, len(nodes)::int as length, count(*) as paths, min(list_min(nodes)) as first_scene from mt join ac using (query_id) join ml using (video_id, chain) group by 1, 2, 3, 4""",
    "matched_video_details": LINKS + r""", c as (select video_id, rel, count(*) as n, min(link_pos) as f from k group by 1, 2),
t as (select video_id, cast(sum(n) as bigint) as num_relations, arg_max(rel, n * 1000000 - f) as dominant, '{' || string_agg('"' || rel || '":' || n, ',' order by rel) || '}' as relation_statistics from c group by 1),
y as (select case when regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) <> '' then regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) else trim(video_id) end as video_id, max(video_label) as label from video_samples group by 1)
select video_id, label, dominant, num_relations, relation_statistics from t left join y using (video_id) where video_id in (select video_id from structural_matches union select video_id from similarity_videos)""",
    "concept_network_report": """select count(*) as concepts, sum(n)::bigint as linked_scenes, round(avg(n), 6) as avg_scenes, max(n) as max_scenes, min(n) as min_scenes
from (select id, count(label) as n from range(12) r(id) left join embeddings on label = id group by 1)""",
    "concept_captions": """select source as concept_id, caption, (row_number() over (partition by source order by length(caption) desc, caption))::int as rank from (select distinct source, caption from scenes where source is not null and trim(caption) <> '') qualify rank <= 3""",
    "widest_concepts": """select rst_type, c_src, count(distinct video_label) as labels, (row_number() over (partition by rst_type order by count(distinct video_label) desc, c_src))::int as rank
from scored_candidates where rst_type is not null and c_src is not null group by 1, 2 qualify rank <= 5""",
    "similar_video_concept": SCENES + "select video_id, count(*) as scenes, count(*) filter (rel_code <> 9) as with_concept, min('concept_' || rel_code) filter (rel_code <> 9) as first_concept from s group by 1",
    "video_representation_captioned": SCENES + f""", d as (select doc_id, max(text) as t from documents group by 1), cs as (select s.*, list_reverse(e) as r, video_id % 9 > 0 and coalesce(trim(t, ' '), '') <> '' as told from s left join d on doc_id = vec_id),
m as (select video_id, list(x order by i) as q from (select video_id, i, avg(r[i + 1]) as x from cs, {_DIMS} where told group by 1, 2) group by 1),
w as (select cs.video_id, e, list_dot_product(e, q) as d from cs join m using (video_id)), v as (select *, exp((d - max(d) over (partition by video_id)) / 0.01) as w from w)
select video_id, i::int as i, round(sum(w * e[i + 1]) / sum(w), 5) as x from v, {_DIMS} group by 1, 2
union all select video_id, i::int as i, round(avg(e[i + 1]), 5) as x from cs, {_DIMS} where video_id not in (select video_id from m) group by 1, 2""",
    "graph_pooling": SCENES + f"select video_id, i::int as i, round(avg(e[i + 1]), 6) as x from s, {_DIMS} group by 1, 2 union all select video_id, (i + 64)::int, round(max(e[i + 1]), 6) from s, {_DIMS} group by 1, 2",
    "nearest_code": SCENES + f""", m as (select rel_code as code, list(x order by i) as v from (select rel_code, i, avg(e[i + 1]) as x from s, {_DIMS} group by 1, 2) group by 1)
select vec_id, code, round(round(list_sum([(x - v[j]) * (x - v[j]) for x, j in e]), 9), 5) as distance from s, m qualify row_number() over (partition by vec_id order by round(list_sum([(x - v[j]) * (x - v[j]) for x, j in e]), 9), code) = 1""",
    "prompt_text": f"""with b as (select record_no, evidence_mode as m, token_count > 512 as over, array_to_string([format('[{{}}] {{}}', i - 1, coalesce(input_scene_captions[i], 'No caption')) for i in range(1, len(input_scene_captions) + 1)], chr(10)) as s,
  {', '.join(f"case when {c}_lean is not null then format('{c} {{}} ({{}})', {c}_lean, coalesce({c}_confidence, 'none')) end as {c}" for c in ('content', 'narrative', 'graph'))} from {_P}),
f as (select record_no, m, s, case when over and graph is not null then '{_NOTICE['graph']}' else graph end as g, case when over and graph is null and narrative is not null then '{_NOTICE['narrative']}' else narrative end as n,
  case when over and graph is null and narrative is null and content is not null then '{_NOTICE['content']}' else content end as c from b)
select record_no, concat_ws(chr(10) || chr(10), 'Scenes:' || chr(10) || case when coalesce(trim(s, ' '), '') <> '' then s else 'No scenes.' end, case when m in ('milvus', 'full') then 'Similar videos:' || chr(10) || c end,
  case when m in ('milvus', 'full') then 'Discourse:' || chr(10) || n end, case when m in ('graph', 'full') then 'Graph:' || chr(10) || g end, '{_TASK}') as prompt from f""",
    "prompt_system": f"""select distinct evidence_mode, concat_ws(chr(10) || chr(10), '{_OPENING}', '0 = low' || chr(10) || '1 = neutral' || chr(10) || '2 = high', case when evidence_mode in ('milvus', 'full') then '{_SOURCES['milvus']}' end,
  case when evidence_mode in ('graph', 'full') then '{_SOURCES['graph']}' end, case when coalesce(evidence_mode not in ('milvus', 'graph', 'full'), true) then '{_ALONE}' end) as prompt from predictions""",
    "discourse_block": LINKS + f""", f as (select *, row_number() over (partition by video_id order by link_pos) as r from k), w as (select unnest([{', '.join(f"'{t}'" for t in GLOSS)}]) as rel, unnest([{', '.join(f"'{t}'" for t in GLOSS.values())}]) as words)
select video_id, string_agg(format('Scene {{}} {{}} Scene {{}}', parent, words, child), chr(10) order by link_pos) as block from f join w using (rel) where r <= 10 group by 1""",
    "ensemble_content_fallback": f"select record_no, {_tie(('content', 'narrative'))} as hybrid, {_tie(('content', 'narrative', 'graph'))} as full from {_P}",
    "graph_nodes": r"""with v as (select case when regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) <> '' then regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) else trim(video_id) end as video_id, video_label, source, {'a': ingested_at, 'b': sample_no} as o from video_samples)
select video_id, arg_max(video_label, o) filter (video_label is not null) as video_label, arg_max(source, o) filter (source is not null) as source from v where video_id is not null group by 1""",
    "graph_edges": LINKS + """, ed as (select video_id || '_scene_' || parent as src, video_id || '_scene_' || child as tgt, rel from k union select video_id, video_id || '_scene_' || parent, 'HAS_SCENE' from k union select video_id, video_id || '_scene_' || child, 'HAS_SCENE' from k)
select rel, count(*) as edges, count(distinct src) as sources from (select distinct * from ed where src is not null and tgt is not null) group by 1""",
    "label_map_update": """select distinct video_id, video_label as label from video_samples where video_label >= 0 and video_id is not null
union select folder_name, predicted_label from predictions where folder_name is not null and predicted_label is not null and folder_name in (select video_id from scene_vectors)""",
    "tried_videos": "select folder_name as video_id from predictions where folder_name is not null union select video_id from video_samples where video_id is not null",
    "complete_records": """with s as (select video_id, bool_or(scene_ids is not null) as listed, coalesce(max(video_label), -1) as label from video_samples group by 1),
r as (select video_id, case when not listed then 'no scene list' when label < 0 then 'no label' when video_id not in (select video_id from scene_vectors where video_id is not null) then 'no vectors'
  when video_id not in (select video_id from rst_links where video_id is not null) then 'no links' else 'ok' end as reason from s),
v as (select video_id, scene_id, arg_max({'e': embedding}, written_at).e as e from scene_vectors where video_id in (select video_id from r where reason = 'ok') group by 1, 2),
o as (select *, e is not null and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0 as sound from v), l as (select video_id, count(distinct link_pos) as links from rst_links group by 1)
select video_id as what, count(*) as scenes, max(links)::bigint as links from o left join l using (video_id) where sound group by 1
union all select reason, count(*), null from (select reason from r where reason <> 'ok' union all select 'unusable vector' from o where not sound) group by 1""",
    "caption_guard": f"""with g as (select video_id, count(*) as n, count(*) filter (caption like '%.') as u, count(*) filter (trim(coalesce(caption, ''), ' ') = '') as blank from {_S} group by 1)
select video_id, case when u < 2 then 'too few units' when blank > 0 then 'empty caption' else 'ok' end as reason from g""",
    "video_durations": "select l_orderkey, l_linenumber, round(l_quantity::double / case when l_linenumber % 3 > 0 then l_linenumber * 12.5 else 30.0 end, 6) as seconds from lineitem",
    "vision_json": rf"""with j as (select record_no, regexp_extract(raw_llm_output, '\{{.*\}}', 0, 's') as j from {_P})
select record_no, coalesce(json_valid(j), false) as sound, case when json_valid(j) then json_extract_string(j, '$.predicted_label') end as label from j""",
    "token_units": rf"""with u as (select scene_no, string_split(regexp_replace(trim(caption, ' '), '\. +', '.' || chr(1), 'g'), chr(1)) as u from {_S} where trim(caption, ' ') <> ''), n as (select scene_no, unnest(u) as t, generate_subscripts(u, 1)::int as unit from u)
select scene_no, unit, len(string_split_regex(t, '\s+')) as words from n""",
    "caption_batches": f"select distinct video_id, scene_id, caption from {_S} where caption is not null and scene_id >= 0",
}

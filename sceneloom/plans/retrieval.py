"""Queries of retrieval, similarity graph and concepts, over ``embeddings`` read as scenes of videos of eight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.vectors import cosine, unit_score
from sceneloom.operators import communities as cm
from sceneloom.operators import concepts as cp
from sceneloom.operators import evidence as ev
from sceneloom.operators.nearest import nearest
from sceneloom.runtime import cut, table

DIM = 64
# The relation that each of the labels 0 to 9 of the table stands for.
RELS = ("TEMPORAL", "JOINT", "ELABORATION", "CONTRAST", "CAUSE", "BACKGROUND", "EVALUATION", "TOPIC_CHANGE", "CONDITION", "SUMMARY")


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    video = F.expr("vec_id div 8")
    return table(spark, sf, "embeddings").select(
        "vec_id", "embedding", video.alias("video_id"), F.expr("vec_id % 8").cast("int").alias("scene_id"), F.col("label").alias("rel_code"),
        (video % 3).cast("int").alias("video_label"), (video % 5 == 0).alias("is_test"),
    )


def _hits(spark: SparkSession, sf: str, limit: int = 50) -> DataFrame:
    """The ``limit`` nearest library scenes of each test video's mean vector."""
    s = scenes(spark, sf)
    q = cp.means(s.where("is_test"), "video_id", "embedding").select(F.col("video_id").alias("vec_id"), F.col("mean").alias("embedding"))
    lib = s.where("not is_test")
    near = nearest(q, lib, limit, "vec_id", "embedding", DIM)
    return near.join(lib.select(F.col("vec_id").alias("hit"), "video_id", "video_label"), "hit")


def content_topk_videos(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: fifty nearest scenes, the best of each video, the five best videos."""
    top = ev.top_k(ev.best_per_video(_hits(spark, sf)), 5)
    return top.select("query", "rank", "video_id", F.col("hit").alias("scene"), "video_label", F.round("cosine", 6).alias("score"))


def content_votes(spark: SparkSession, sf: str) -> DataFrame:
    return ev.votes(ev.top_k(ev.best_per_video(_hits(spark, sf)), 5))


def content_lean(spark: SparkSession, sf: str) -> DataFrame:
    return ev.lean(ev.top_k(ev.best_per_video(_hits(spark, sf)), 5))


def content_binary_lean(spark: SparkSession, sf: str) -> DataFrame:
    top = ev.top_k(ev.best_per_video(_hits(spark, sf)), 5).groupBy("query").agg(F.count_if(F.col("video_label") == 1).alias("pos"), F.count("*").alias("total"))
    lean, confidence = ev.binary_lean(F.col("pos"), F.col("total"))
    return top.select("query", lean.alias("lean"), confidence.alias("confidence"))


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, cosine, weight): the five nearest scenes of other videos for every twentieth scene, both written as an edge."""
    s = scenes(spark, sf)
    return nearest(s.where("vec_id % 20 = 0"), s, 5, "vec_id", "embedding", DIM, skip="video_id").select(
        F.col("query").alias("a"), F.col("hit").alias("b"), "cosine", unit_score("cosine").alias("weight")
    )


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, cosine, weight): every scene's nearest scene of another video: the graph that components and concepts rest on."""
    s = scenes(spark, sf)
    return nearest(s, s, 1, "vec_id", "embedding", DIM, skip="video_id").select(F.col("query").alias("a"), F.col("hit").alias("b"), "cosine", unit_score("cosine").alias("weight"))


def similar_to(spark: SparkSession, sf: str) -> DataFrame:
    return _similar(spark, sf).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("weight", 6).alias("cosine_score"))


def similar_overfetch(spark: SparkSession, sf: str) -> DataFrame:
    """Over-fetch seven times k with the scene itself among the hits, drop self and same-video hits and those under the threshold, keep k."""
    s = scenes(spark, sf)
    h = nearest(s.where("vec_id % 20 = 0"), s, 35, "vec_id", "embedding", DIM).where("query <> hit and query div 8 <> hit div 8").where(unit_score("cosine") >= 0.55)
    return ev.top_k(h, 5, tie="hit").select("query", "hit", "rank")


def similar_to_summary(spark: SparkSession, sf: str) -> DataFrame:
    return similar_to(spark, sf).agg(F.count("*").alias("relationships"), F.round(F.avg("cosine_score"), 6).alias("avg_score"))


def neighbor_videos_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of each neighbouring video and its three best scenes."""
    e = similar_to(spark, sf).select(F.expr("a div 8").alias("video"), F.expr("b div 8").alias("neighbour"), "b", "cosine_score")
    g = e.groupBy("video", "neighbour").agg(F.round(F.avg("cosine_score"), 6).alias("avg_score"), F.array_sort(F.collect_set(F.struct((-F.col("cosine_score")).alias("o"), "b"))).alias("l"))
    return g.select("video", "neighbour", "avg_score", F.array_join(F.transform(F.slice("l", 1, 3), lambda x: x["b"]), ",").alias("samples"))


def similarity_components(spark: SparkSession, sf: str) -> DataFrame:
    return cm.connected_components(_graph(spark, sf))


def _concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with the concept of their component."""
    m = cp.number_by_size(cut(cm.connected_components(_graph(spark, sf)).select("node", F.col("component").alias("community"))))
    return scenes(spark, sf).join(m, F.col("vec_id") == F.col("node")).drop("node")


def similarity_communities(spark: SparkSession, sf: str) -> DataFrame:
    return cm.communities(_graph(spark, sf))


def concept_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return cp.label_distribution(_concepts(spark, sf))


def concept_size_report(spark: SparkSession, sf: str) -> DataFrame:
    return cp.concept_sizes(_concepts(spark, sf))


def concept_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = cp.centres(_concepts(spark, sf), "concept_id", "embedding")
    return c.select("concept_id", "scenes", F.posexplode("centre").alias("i", "x")).select("concept_id", "scenes", "i", F.round("x", 6).alias("x"))


def concept_overlap_videos(spark: SparkSession, sf: str) -> DataFrame:
    """With a label missing in every seventh video, for which every second of these has a predicted one."""
    c = _concepts(spark, sf).withColumn("video_label", F.when(F.col("video_id") % 7 > 0, F.col("video_label")))
    return cp.co_members(c.withColumn("predicted_label", F.when(F.col("video_id") % 2 == 0, 1)), "is_test", predicted="predicted_label")


def _captioned(spark: SparkSession, sf: str) -> DataFrame:
    captions = table(spark, sf, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("text").alias("caption"))
    return _concepts(spark, sf).join(captions, "vec_id", "left")


def concept_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return cp.concept_metadata(_captioned(spark, sf))


def concept_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return cp.concept_prompt(_captioned(spark, sf))


def video_mean(spark: SparkSession, sf: str) -> DataFrame:
    return cp.means(scenes(spark, sf), "video_id", "embedding").select("video_id", F.posexplode("mean").alias("i", "x")).select("video_id", "i", F.round("x", 6).alias("x"))


def video_representation(spark: SparkSession, sf: str) -> DataFrame:
    s = scenes(spark, sf)
    q = cp.means(s, "video_id", "embedding").withColumnRenamed("mean", "q")
    return cp.weighted_representation(s, q, "video_id", "embedding").select("video_id", F.posexplode("v").alias("i", "x")).select("video_id", "i", F.round("x", 5).alias("x"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each scene linked to its half, as in a heap, with both vectors."""
    s = scenes(spark, sf)
    rel = F.element_at(F.array(*map(F.lit, RELS)), F.col("rel_code") + 1)
    src = s.where("scene_id >= 1").select("video_id", "video_label", "is_test", rel.alias("rel"), F.col("scene_id").alias("src"), F.expr("(scene_id + 1) div 2 - 1").cast("int").alias("tgt"), F.col("embedding").alias("u"))
    tgt = s.select("video_id", F.col("scene_id").alias("tgt"), F.col("embedding").alias("v"))
    return src.join(tgt, ["video_id", "tgt"]).withColumn("edge", F.col("video_id") * 8 + F.col("src")).withColumn("pair", F.concat("u", "v"))


def edge_type_priors(spark: SparkSession, sf: str) -> DataFrame:
    return ev.prior(edges(spark, sf).where("not is_test"), "rel").select("rel", F.round("prior", 6).alias("prior"))


def edge_retrieval_tiered(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest library edges of one type for each test edge; of any type where there is none; scored with the type's prior. Edges of one type ask for a type that the library lacks."""
    e = cut(edges(spark, sf))
    q, lib = e.where("is_test").withColumn("rel", F.when(F.col("rel") == "SUMMARY", "EXPLANATION").otherwise(F.col("rel"))), e.where("not is_test")
    first = cut(nearest(q, lib, 3, "edge", "pair", 2 * DIM, match="rel"))
    rest = q.join(first.select(F.col("query").alias("edge")).distinct(), "edge", "left_anti")
    hits = ev.tiered(first, nearest(rest, lib, 3, "edge", "pair", 2 * DIM))
    own = lib.select(F.col("edge").alias("hit"), "rel", "video_label").join(F.broadcast(ev.prior(lib, "rel")), "rel", "left")  # a row a relation type
    return hits.join(own, "hit").select("query", "hit", "tier", "rel", "video_label", F.round(ev.edge_score(F.col("cosine"), F.col("prior")), 6).alias("score"))


def triple_priors(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scored_candidates").where("c_src is not null and rst_type is not null and c_tgt is not null")
    return ev.prior(s, "c_src", "rst_type", "c_tgt").select("c_src", "rst_type", "c_tgt", F.round("prior", 6).alias("prior"))


def pair_cosines(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of consecutive scenes of a video."""
    s = scenes(spark, sf)
    n = s.select("video_id", (F.col("scene_id") - 1).alias("scene_id"), F.col("embedding").alias("nxt"))
    return s.join(n, ["video_id", "scene_id"]).select("video_id", "scene_id", F.round(cosine("embedding", "nxt"), 6).alias("cosine"))


def concept_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The two nearest of the label centres for each scene."""
    s = scenes(spark, sf)
    c = cp.centres(s.withColumn("concept_id", F.concat(F.lit("concept_"), "rel_code")), "concept_id", "embedding")
    return cp.assign(s, c, "vec_id", "embedding", top=2).select("vec_id", "concept_id", "rank", F.round("p", 5).alias("p"))


def concept_triples(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).select("video_id", F.col("src").alias("parent"), F.col("tgt").alias("child"), "rel")
    sc = scenes(spark, sf).select("video_id", "scene_id", F.concat(F.lit("concept_"), "rel_code").alias("concept_id"))
    return cp.triples(e, sc).groupBy("c_src", "rel", "c_tgt").agg(F.count("*").alias("n"))


def concept_diversity(spark: SparkSession, sf: str) -> DataFrame:
    sc = scenes(spark, sf).select("video_id", F.col("rel_code").alias("concept_id"))
    d = cp.diversity(sc)
    return d.agg(F.round(F.avg("diversity"), 6).alias("mean"), F.round(F.percentile("diversity", 0.5), 6).alias("median"), F.count_if(F.col("diversity") < 0.6).alias("low"), F.count("*").alias("videos"))


SCENES = """
with recursive s as (select vec_id, cast(embedding as double[]) as e, vec_id // 8 as video_id, cast(vec_id % 8 as int) as scene_id, label as rel_code,
  cast((vec_id // 8) % 3 as int) as video_label, (vec_id // 8) % 5 = 0 as is_test from embeddings),
n as (select *, [x / sqrt(list_sum([y * y for y in e])) for x in e] as u from s)
"""
_DIMS = "(select unnest(range(64)) as i)"
_HITS = SCENES + f""", m as (select video_id as query, list(x order by i) as v from (select video_id, i, avg(e[i + 1]) as x from s, {_DIMS} where is_test group by 1, 2) group by 1),
q as (select query, [x / sqrt(list_sum([y * y for y in v])) for x in v] as v from m),
h as (select query, vec_id as hit, video_id, video_label, round(list_dot_product(v, u), 9) as c from q, n where not is_test qualify row_number() over (partition by query order by c desc, vec_id) <= 50),
b as (select * from h qualify row_number() over (partition by query, video_id order by c desc, hit) = 1),
t as (select *, row_number() over (partition by query order by c desc, video_id) as rank from b qualify rank <= 5)
"""
_SIM = SCENES + """, sim as (select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.u, b.u), 9) as c from n a, n b
  where a.vec_id % 20 = 0 and a.video_id <> b.video_id qualify row_number() over (partition by a.vec_id order by c desc, b.vec_id) <= 5)
"""
_CONCEPT = SCENES + """, sim as (select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.u, b.u), 9) as c from n a, n b where a.video_id <> b.video_id qualify row_number() over (partition by a.vec_id order by c desc, b.vec_id) = 1),
g as (select a as x, b as y from sim union select b, a from sim), w as (select x, x as r from g union select w.x, g.y from w join g on w.r = g.x),
cc as (select x as node, min(r) as component from w group by 1), z as (select component, count(*) as n, row_number() over (order by count(*) desc, md5(component::varchar)) as no from cc group by 1),
c as (select s.*, 'concept_' || no as concept_id from s join cc on vec_id = node join z using (component) where n >= 2)
"""
_META = _CONCEPT + """, dc as (select doc_id, max(text) as t from documents group by 1),
vd as (select concept_id, video_id, count(*) as n, list({'scene_id': scene_id, 'caption': coalesce(t, 'No caption available')} order by scene_id) as sc, (row_number() over (partition by concept_id order by count(*) desc, video_id))::int as rank
  from c left join dc on doc_id = vec_id group by 1, 2)
"""
_REL = "([" + ", ".join(f"'{r}'" for r in RELS) + "])[rel_code + 1]"
EDGES = SCENES + f""", e as (select a.video_id, a.video_label, a.is_test, {_REL.replace('rel_code', 'a.rel_code')} as rel, a.scene_id as src, b.scene_id as tgt, a.video_id * 8 + a.scene_id as edge,
  list_concat(a.e, b.e) as v from s a join s b on a.video_id = b.video_id and b.scene_id = (a.scene_id + 1) // 2 - 1 where a.scene_id >= 1)
"""
QUERIES = {
    f.__name__: f
    for f in (
        content_topk_videos, content_votes, content_lean, content_binary_lean, similar_to, similar_overfetch, similar_to_summary, neighbor_videos_avg, similarity_components,
        similarity_communities, concept_label_distribution, concept_size_report, concept_centroids, concept_overlap_videos, concept_metadata, concept_prompt, video_mean, video_representation,
        edge_type_priors, edge_retrieval_tiered, triple_priors, pair_cosines, concept_assignment, concept_triples, concept_diversity,
    )
}
SQL = {
    "content_topk_videos": _HITS + "select query, rank::int as rank, video_id, hit as scene, video_label, round(c, 6) as score from t",
    "content_votes": _HITS + "select query, video_label, count(*) as n from t group by 1, 2",
    "content_lean": _HITS + """, v as (select query, video_label, count(*) as n from t group by 1, 2),
r as (select *, coalesce(lead(n) over (partition by query order by n desc, video_label), 0) as nx, row_number() over (partition by query order by n desc, video_label) as r from v)
select query, case when n > nx then video_label end as lean, case when n = nx then 'mixed' when n = nx + 1 then 'weak' else 'strong' end as confidence from r where r = 1""",
    "content_binary_lean": _HITS + """, v as (select query, 2 * count(*) filter (video_label = 1) - count(*) as d from t group by 1)
select query, case when d > 0 then 1 when d < 0 then 0 end as lean, case when d = 0 then 'mixed' when abs(d) <= 1 then 'weak' else 'strong' end as confidence from v""",
    "similar_to": _SIM + "select a, b, round(c, 6) as cosine, round((1 + c) / 2, 6) as cosine_score from sim",
    "similar_overfetch": SCENES + """, h as (select a.vec_id as query, b.vec_id as hit, round(list_dot_product(a.u, b.u), 9) as c from n a, n b where a.vec_id % 20 = 0
  qualify row_number() over (partition by a.vec_id order by c desc, b.vec_id) <= 35)
select query, hit, (row_number() over (partition by query order by c desc, hit))::int as rank from h where query // 8 <> hit // 8 and (1 + c) / 2 >= 0.55 qualify rank <= 5""",
    "similar_to_summary": _SIM + "select count(*) as relationships, round(avg(round((1 + c) / 2, 6)), 6) as avg_score from sim",
    "neighbor_videos_avg": _SIM + """, d as (select distinct a // 8 as video, b // 8 as neighbour, b, round((1 + c) / 2, 6) as w from sim), r as (select *, row_number() over (partition by video, neighbour order by w desc, b) as r from d),
o as (select a // 8 as video, b // 8 as neighbour, round(avg(round((1 + c) / 2, 6)), 6) as avg_score from sim group by 1, 2)
select video, neighbour, avg_score, string_agg(b::varchar, ',' order by r) filter (r <= 3) as samples from o join r using (video, neighbour) group by 1, 2, 3""",
    "similarity_components": _CONCEPT + "select node, component from cc",
    "concept_label_distribution": _CONCEPT + "select concept_id, video_label, count(distinct video_id) as videos from c group by 1, 2",
    "concept_size_report": _CONCEPT + """select concept_id, cast(sum(n) as bigint) as num_scenes, count(*) as num_videos, count(distinct l) as num_labels, max(n) as largest_video
from (select concept_id, video_id, count(*) as n, max(video_label) as l from c group by 1, 2) group by 1""",
    "concept_centroids": _CONCEPT + f""", m as (select concept_id, i, avg(e[i + 1]) as x, count(*) as scenes from c, {_DIMS} group by 1, 2)
select concept_id, scenes, i::int as i, round(x / sqrt(sum(x * x) over (partition by concept_id)), 6) as x from m""",
    "concept_overlap_videos": _CONCEPT + """, q as (select video_id as query, concept_id, count(*) as scene_count from c where is_test group by 1, 2 qualify row_number() over (partition by video_id order by count(*) desc, concept_id) <= 5),
o as (select concept_id, video_id, max(case when video_id % 7 > 0 then video_label else 1 end) as label, count(distinct scene_id) as overlap from c where not is_test and (video_id % 7 > 0 or video_id % 2 = 0) group by 1, 2)
select query, concept_id, scene_count, video_id, label, coalesce(overlap, 0) as overlap, (row_number() over (partition by query order by scene_count desc, coalesce(overlap, 0) desc, concept_id, video_id nulls first))::int as rank from q left join o using (concept_id) qualify rank <= 20""",
    "concept_metadata": _META + "select concept_id, to_json(list({'rank': rank, 'video_id': video_id, 'n': n, 'scenes': sc} order by rank))::varchar as metadata from vd group by 1",
    "concept_prompt": _META + "select concept_id, to_json(list({'rank': rank, 'video_id': video_id, 'n': n, 'scenes': sc[1:3]} order by rank))::varchar as metadata from vd where rank <= 5 group by 1",
    "video_mean": SCENES + f"select video_id, i::int as i, round(avg(e[i + 1]), 6) as x from s, {_DIMS} group by 1, 2",
    "video_representation": SCENES + f""", m as (select video_id, list(x order by i) as q from (select video_id, i, avg(e[i + 1]) as x from s, {_DIMS} group by 1, 2) group by 1),
w as (select s.video_id, e, list_dot_product(e, q) as d from s join m using (video_id)), v as (select *, exp((d - max(d) over (partition by video_id)) / 0.01) as w from w)
select video_id, i::int as i, round(sum(w * e[i + 1]) / sum(w), 5) as x from v, {_DIMS} group by 1, 2""",
    "edge_type_priors": EDGES + "select rel, round((count(*) filter (video_label = 1) + 1) / (count(*) + 2)::double, 6) as prior from e where not is_test group by 1",
    "edge_retrieval_tiered": EDGES + """, f as (select *, [x / sqrt(list_sum([y * y for y in v])) for x in v] as u from e), l as (select * from f where not is_test), q as (select * replace (case when rel = 'SUMMARY' then 'EXPLANATION' else rel end as rel) from f where is_test),
p as (select rel, (count(*) filter (video_label = 1) + 1) / (count(*) + 2)::double as prior from l group by 1),
x as (select q.edge as query, l.edge as hit, round(list_dot_product(q.u, l.u), 9) as c, q.rel = l.rel as same, l.rel, l.video_label from q, l),
a as (select *, 1 as tier from x where same qualify row_number() over (partition by query order by c desc, hit) <= 3),
b as (select *, 2 as tier from x where query not in (select query from a) qualify row_number() over (partition by query order by c desc, hit) <= 3)
select query, hit, tier, rel, video_label, round(0.85 * c + (1 - 0.85) * prior, 6) as score from (select * from a union all select * from b) join p using (rel)""",
    "triple_priors": """select c_src, rst_type, c_tgt, round((count(*) filter (video_label = 1) + 1) / (count(*) + 2)::double, 6) as prior from scored_candidates
where c_src is not null and rst_type is not null and c_tgt is not null and video_label is not null group by 1, 2, 3""",
    "pair_cosines": SCENES + "select a.video_id, a.scene_id, round(list_dot_product(a.u, b.u), 6) as cosine from n a join n b on a.video_id = b.video_id and b.scene_id = a.scene_id + 1",
    "concept_assignment": SCENES + f""", m as (select rel_code, i, avg(e[i + 1]) as x from s, {_DIMS} group by 1, 2), c as (select 'concept_' || rel_code as concept_id, list(x order by i) as v from m group by 1),
k as (select concept_id, [x / sqrt(list_sum([y * y for y in v])) for x in v] as v from c), d as (select vec_id, concept_id, list_dot_product(u, v) as d from n, k),
p as (select vec_id, concept_id, exp((d - max(d) over (partition by vec_id)) / 0.1) as w from d), r as (select vec_id, concept_id, w / sum(w) over (partition by vec_id) as p from p)
select vec_id, concept_id, (row_number() over (partition by vec_id order by p desc, concept_id))::int as rank, round(p, 5) as p from r qualify rank <= 2""",
    "concept_triples": EDGES + """select 'concept_' || a.rel_code as c_src, e.rel, 'concept_' || b.rel_code as c_tgt, count(*) as n from e join s a on a.video_id = e.video_id and a.scene_id = e.src
join s b on b.video_id = e.video_id and b.scene_id = e.tgt group by 1, 2, 3""",
    "concept_diversity": SCENES + """, d as (select video_id, count(distinct rel_code) / count(*)::double as d from s group by 1)
select round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as median, count(*) filter (d < 0.6) as low, count(*) as videos from d""",
}

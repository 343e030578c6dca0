"""Queries over discourse links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.discourse import CANONICAL, DYNAMIC, GLOSS, chain_gloss, gloss, relation_code
from sceneloom.functions.text import relation_label
from sceneloom.operators import discourse as op
from sceneloom.runtime import cut, table


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return op.clean_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))


def _captions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scenes").groupBy("video_id", "scene_id").agg(F.max_by("caption", "scene_no").alias("caption"))


def clean_links(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf)


def link_void_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return op.void_links(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))


def edge_index(spark: SparkSession, sf: str) -> DataFrame:
    """Links as edges between positions from 0, with the relation's code and that of a model of 18 types."""
    return _links(spark, sf).select("video_id", "link_pos", (F.col("src") - 1).alias("a"), (F.col("tgt") - 1).alias("b"), relation_code("rel").alias("code"), relation_code("rel", 17).alias("clamped"))


def relation_normalize(spark: SparkSession, sf: str) -> DataFrame:
    label = relation_label("rel")
    return table(spark, sf, "rst_links").groupBy(label.alias("rel"), gloss(label).alias("phrase")).agg(F.count("*").alias("n"))


def chain_explained(spark: SparkSession, sf: str) -> DataFrame:
    chains = table(spark, sf, "structural_matches").where("size(rst_chain) > 0").select("match_no", F.filter(F.transform("rst_chain", relation_label), lambda x: x.isNotNull()).alias("c"))
    return chains.groupBy("match_no").agg(F.max("c").alias("c")).select("match_no", chain_gloss("c").alias("explained"))


def relation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return op.relation_statistics(_links(spark, sf))


def discourse_summary(spark: SparkSession, sf: str) -> DataFrame:
    return op.discourse_summary(_links(spark, sf))


def relation_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return op.relation_sequence(_links(spark, sf))


def topology_vector(spark: SparkSession, sf: str) -> DataFrame:
    t = op.topology(_links(spark, sf)).select("video_id", F.posexplode("topology").alias("i", "share"), F.round("tension", 6).alias("tension"))
    return t.select("video_id", F.element_at(F.array(*map(F.lit, CANONICAL)), F.col("i") + 1).alias("rel"), F.round("share", 6).alias("share"), "tension")


def undirected_links(spark: SparkSession, sf: str) -> DataFrame:
    return op.undirected(_links(spark, sf))


def linked_scene(spark: SparkSession, sf: str) -> DataFrame:
    return op.linked_scene(_links(spark, sf))


def local_subgraph_context(spark: SparkSession, sf: str) -> DataFrame:
    return op.local_context(_links(spark, sf))


def two_hop_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    links = cut(_links(spark, sf))
    return op.within_hops(links, links.where("link_pos = 1").select("video_id", F.col("parent").alias("scene_id")), 2)


def relation_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = op.relation_paths(cut(_links(spark, sf)))
    return p.groupBy(F.array_join("chain", ">").alias("chain")).agg(F.count("*").alias("paths"), F.countDistinct("video_id").alias("videos"))


def scene_depth(spark: SparkSession, sf: str) -> DataFrame:
    return op.depths(_links(spark, sf))


def path_to_root(spark: SparkSession, sf: str) -> DataFrame:
    return op.paths_to_root(_links(spark, sf))


def discourse_tree(spark: SparkSession, sf: str) -> DataFrame:
    return op.tree_text(_links(spark, sf), _captions(spark, sf))


_NORM = "replace(replace(upper(trim({})), ' ', '_'), '-', '_')"
_KNOWN = "(" + ", ".join(f"'{t}'" for t in GLOSS) + ")"
_ORDER = "[" + ", ".join(f"'{t}'" for t in GLOSS) + "]"
LINKS = rf"""
with recursive l as (select video_id, link_pos, arg_max({{'s': src, 't': tgt, 'r': rel}}, ingested_at) as e from rst_links group by 1, 2),
s as (select regexp_extract(video_id, '([A-Za-z0-9_-]{{11}})(\.[A-Za-z0-9]+)?\s*$', 1) as video_id, any_value(scene_ids) as ids
  from video_samples where scene_ids is not null group by 1),
k as (select video_id, link_pos, e.s as src, e.t as tgt, case when {_NORM.format('e.r')} in {_KNOWN} then {_NORM.format('e.r')} else 'JOINT' end as rel,
  ids[e.s] as parent, ids[e.t] as child from l join s using (video_id) where e.s between 1 and len(ids) and e.t between 1 and len(ids)),
u as (select video_id, a, b, arg_max(rel, list_position({_ORDER}, rel)) as rel from (select video_id, parent as a, child as b, rel from k union all select video_id, child, parent, rel from k) where a <> b group by 1, 2, 3)
"""
_PHRASE = "case " + " ".join(f"when r = '{k}' then '{v}'" for k, v in GLOSS.items()) + " else replace(lower(r), '_', ' ') end"
PATHS = """, p2 as (select a.video_id, b.child as head, [a.rel, b.rel] as chain, [a.parent, a.child, b.child] as nodes, [a.link_pos, b.link_pos] as links
  from k a join k b on a.video_id = b.video_id and a.child = b.parent and a.link_pos <> b.link_pos),
p3 as (select a.video_id, b.child as head, list_append(chain, b.rel) as chain, list_append(nodes, b.child) as nodes, list_append(links, b.link_pos) as links
  from p2 a join k b on a.video_id = b.video_id and a.head = b.parent and not list_contains(a.links, b.link_pos)),
p4 as (select a.video_id, b.child as head, list_append(chain, b.rel) as chain, list_append(nodes, b.child) as nodes, list_append(links, b.link_pos) as links
  from p3 a join k b on a.video_id = b.video_id and a.head = b.parent and not list_contains(a.links, b.link_pos)),
p as (select * from p2 union all select * from p3 union all select * from p4)
"""
_WAYS = """, ed as (select video_id, link_pos, rel, parent as a, child as b from k union all select video_id, link_pos, rel, child, parent from k),
nodes as (select distinct video_id, a as s from ed), root as (select video_id, coalesce(min(parent) filter (rel = 'ROOT'), min(least(parent, child))) as s from k group by 1),
w(video_id, s, d, way) using key (video_id, s) as (select video_id, s, 0, '' from root union
  select ed.video_id, ed.b, arg_min(w.d, [link_pos, a]) + 1, arg_min(rel || '>' || a || case when w.way = '' then '' else ' ' || w.way end, [link_pos, a]) from w join ed on w.video_id = ed.video_id and w.s = ed.a
  left join recurring.w as r on r.video_id = ed.video_id and r.s = ed.b where r.s is null group by 1, 2)
"""
QUERIES = {
    f.__name__: f
    for f in (
        clean_links, edge_index, link_void_reasons, relation_normalize, chain_explained, relation_statistics, discourse_summary, relation_sequence, topology_vector,
        undirected_links, linked_scene, local_subgraph_context, two_hop_subgraph, relation_paths, scene_depth, path_to_root, discourse_tree,
    )
}
SQL = {
    "clean_links": LINKS + "select * from k",
    "edge_index": LINKS + f"select video_id, link_pos, src - 1 as a, tgt - 1 as b, list_position([{', '.join(repr(t) for t in GLOSS)}], rel) - 1 as code, least(list_position([{', '.join(repr(t) for t in GLOSS)}], rel) - 1, 17) as clamped from k",
    "link_void_reasons": LINKS + r""", n as (select regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) as video_id, max(len(scene_ids)) as n from video_samples group by 1)
select case when n is null then 'no scene list' when e.s is null or e.t is null then 'null end' when not (e.s between 1 and n and e.t between 1 and n) then 'out of range' else 'valid' end as reason,
count(*) as links from l left join n using (video_id) group by 1""",
    "relation_normalize": f"select r as rel, {_PHRASE} as phrase, count(*) as n from (select {_NORM.format('rel')} as r from rst_links) group by 1, 2",
    "chain_explained": f"""select match_no, array_to_string([{_PHRASE} for r in c], ' -> ') as explained from
(select match_no, [{_NORM.format('x')} for x in max(rst_chain) if x is not null] as c from structural_matches where len(rst_chain) > 0 group by 1)""",
    "relation_statistics": LINKS + "select video_id, rel, count(*) as links, min(link_pos) as first_pos from k group by 1, 2",
    "discourse_summary": LINKS + """, c as (select video_id, rel, count(*) as n, min(link_pos) as f from k group by 1, 2),
t as (select video_id, cast(sum(n) as bigint) as num_relations, arg_max(rel, n * 1000000 - f) as dominant, '{' || string_agg('"' || rel || '":' || n, ',' order by rel) || '}' as relation_statistics from c group by 1)
select video_id, num_relations, dominant, relation_statistics,
  num_relations || ' rhetorical relations, mostly ' || dominant || ': ' || string_agg(printf('%d %s (%.1f%%)', n, rel, n * 100.0::double / num_relations), ', ' order by n desc, f) as summary
from t join c using (video_id) group by video_id, num_relations, dominant, relation_statistics""",
    "relation_sequence": LINKS + "select video_id, string_agg('S' || src || ' --' || rel || '--> S' || tgt, chr(10) order by src, tgt, link_pos) as sequence from k group by 1",
    "topology_vector": LINKS + f""", c as (select unnest([{", ".join(f"'{t}'" for t in CANONICAL)}]) as rel),
n as (select video_id, count(*) filter (rel in (select rel from c)) as n, round(count(*) filter (rel in {DYNAMIC}) / (count(*) + 1e-6), 6) as tension from k group by 1)
select n.video_id, c.rel, round(case when n.n > 0 then count(k.rel) / n.n::double else 0 end, 6) as share, tension
from n cross join c left join k on k.video_id = n.video_id and k.rel = c.rel group by n.video_id, c.rel, n.n, tension""",
    "undirected_links": LINKS + "select * from u",
    "linked_scene": LINKS + """, p as (select video_id, child as scene_id, arg_max(parent, link_pos) as p from k group by 1, 2), c as (select video_id, parent as scene_id, arg_min(child, link_pos) as c from k group by 1, 2)
select video_id, scene_id, coalesce(p, c) as linked from p full join c using (video_id, scene_id)""",
    "local_subgraph_context": LINKS + "select video_id, a as scene_id, b as neighbour, rel, row_number() over (partition by video_id, a order by b)::int as row from u qualify row <= 2",
    "two_hop_subgraph": LINKS + """, h0 as (select distinct video_id, parent as s from k where link_pos = 1),
h as (select video_id, s, 0 as h from h0 union all select h0.video_id, u.b, 1 from h0 join u on h0.video_id = u.video_id and h0.s = u.a
  union all select h0.video_id, v.b, 2 from h0 join u on h0.video_id = u.video_id and h0.s = u.a join u v on u.video_id = v.video_id and u.b = v.a)
select video_id, s as scene_id, min(h) as hops from h group by 1, 2""",
    "relation_paths": LINKS + PATHS + "select array_to_string(chain, '>') as chain, count(*) as paths, count(distinct video_id) as videos from p group by 1",
    "scene_depth": LINKS + _WAYS + "select video_id, s as scene_id, coalesce(d, -1)::int as depth from nodes left join w using (video_id, s)",
    "path_to_root": LINKS + _WAYS + "select video_id, s as scene_id, coalesce(way, '') as path from nodes left join w using (video_id, s)",
}

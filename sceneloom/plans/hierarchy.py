"""Queries of the hierarchy operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.operators.hierarchy import descendants
from sceneloom.operators.scene_links import scene_hierarchy
from sceneloom.runtime import table


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return scene_hierarchy(table(spark, sf, "rst_links"), table(spark, sf, "video_samples"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select(
        "video_id", "scene_id",
        F.coalesce("root", F.lit(-1)).alias("root_scene_id"),
        F.col("depth").cast("int").alias("depth"),
        F.array_join("path", ">").alias("path"),
    )


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """The number, height and smallest id of each scene's descendants; the descendants are in ``p1_descendant_rows``."""
    return (
        descendants(_resolved(spark, sf), "video_id", "scene_id")
        .groupBy("video_id", F.col("ancestor").alias("scene_id"))
        .agg(F.count("*").alias("n_descendants"), F.max("distance").cast("int").alias("height"), F.min("descendant").alias("first_descendant"))
    )


def p1_descendant_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each scene with each of its descendants and the distance between them."""
    d = descendants(_resolved(spark, sf), "video_id", "scene_id")
    return d.select("video_id", F.col("ancestor").alias("scene_id"), F.col("descendant"), F.col("distance").cast("int").alias("distance"))


LINKED = r"""
with recursive l as (
  select video_id, link_pos, arg_max({'s': src, 't': tgt}, ingested_at) as e from rst_links group by 1, 2),
s as (select regexp_extract(video_id, '([A-Za-z0-9_-]{11})(\.[A-Za-z0-9]+)?\s*$', 1) as video_id, any_value(scene_ids) as ids
  from video_samples where scene_ids is not null group by 1),
e as (select l.video_id, link_pos, ids[e.s] as p, ids[e.t] as c from l join s using (video_id)
  where e.s between 1 and len(ids) and e.t between 1 and len(ids)),
n as (select video_id, c as scene_id, arg_min(p, link_pos) as p from e group by 1, 2
  union all select distinct video_id, p, null from e where (video_id, p) not in (select video_id, c from e)),
up as (select video_id, scene_id, scene_id as root, 0 as depth, cast(scene_id as varchar) as path from n where p is null
  union all select n.video_id, n.scene_id, up.root, up.depth + 1, up.path || '>' || n.scene_id from up join n on n.video_id = up.video_id and n.p = up.scene_id)
"""
QUERIES = {"p1_found": p1_found, "p1_descendants": p1_descendants, "p1_descendant_rows": p1_descendant_rows}
SQL = {
    "p1_found": LINKED + """select n.video_id, n.scene_id, coalesce(root, -1) as root_scene_id, coalesce(depth, -1) as depth, coalesce(path, '') as path
from n left join up using (video_id, scene_id)""",
    "p1_descendants": LINKED + """, b as (select a.video_id, a.scene_id, d.scene_id as below, d.depth - a.depth as distance
  from up a join up d on a.video_id = d.video_id and starts_with(d.path, a.path || '>'))
select video_id, scene_id, count(*) as n_descendants, max(distance) as height, min(below) as first_descendant from b group by 1, 2""",
    "p1_descendant_rows": LINKED + """select a.video_id, a.scene_id, d.scene_id as descendant, d.depth - a.depth as distance
from up a join up d on a.video_id = d.video_id and starts_with(d.path, a.path || '>')""",
}

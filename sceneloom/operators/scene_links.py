"""Scene hierarchies from discourse links and the scene lists of the registered videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.text import canonical_video_id
from sceneloom.operators.hierarchy import resolve_hierarchy


def link_ends(links: DataFrame, samples: DataFrame) -> DataFrame:
    """(video_id, link_pos, parent, child) as scene ids, of the links that are not void.

    Of rows with equal video and position only the latest counts. Positions are 1-based; a link
    with a null or out-of-range end, or of a video without a scene list, is void.
    """
    latest = (
        links.groupBy("video_id", "link_pos")
        .agg(F.max_by(F.struct("src", "tgt"), F.struct("ingested_at", "src", "tgt")).alias("l"))
        .select("video_id", "link_pos", "l.src", "l.tgt")
        .where("src >= 1 and tgt >= 1")
    )
    lists = (
        samples.where("scene_ids is not null")
        .groupBy(canonical_video_id("video_id").alias("video_id"))
        .agg(F.max_by("scene_ids", "ingested_at").alias("scene_ids"))
    )
    return (
        latest.join(lists, "video_id")
        .where("src <= size(scene_ids) and tgt <= size(scene_ids)")
        .select("video_id", "link_pos", F.expr("get(scene_ids, src - 1)").alias("parent"), F.expr("get(scene_ids, tgt - 1)").alias("child"))
        .where("parent is not null and child is not null")
    )


def scene_hierarchy(links: DataFrame, samples: DataFrame) -> DataFrame:
    """(video_id, scene_id, root, depth, path) of every linked scene; see ``resolve_hierarchy``.

    The parent with the lowest position holds; a scene is linked if it is an end of any non-void link.
    """
    ends = link_ends(links, samples)
    parents = (
        ends.select("video_id", F.expr("inline(array(struct(child as scene_id, link_pos as pos, parent), struct(parent as scene_id, int(null) as pos, int(null) as parent)))"))
        .groupBy("video_id", "scene_id")
        .agg(F.min_by("parent", "pos").alias("parent"))
    )
    return resolve_hierarchy(parents, "video_id", "scene_id", "parent")

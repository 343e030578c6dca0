"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.runtime import Rounds


def resolve_hierarchy(parents: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """Path, depth and root of every node, and the nodes from which the way up never ends.

    ``parents`` holds one row per (group, node); ``parent`` is null for a root. Returns
    ``(group, node, root, depth, path)`` with ``path`` an array from the root to the node;
    a node on or below a cycle gets null root, depth -1 and an empty path.

    Every node carries a pointer to an ancestor and the path segment below it. A round joins
    the pointers with the ancestors' own rows, which doubles the distance and concatenates the
    segments, so a tree of depth d takes about log2(d) rounds. A node that meets itself in its
    own segment lies on a cycle. Only unresolved nodes take part in a round; each round's state
    is a written table. Joins are on (group, ancestor), so a group of any size is spread out,
    and the hot ancestors of one round are split by adaptive skew joins.

    Edge cases: rows with a null group or node are dropped; a parent that has no row of its own
    counts as a root of that name; repeated (group, node) rows keep the smallest parent; an empty
    input gives an empty result; other columns are ignored, whatever their names.
    """
    base = (
        parents.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(parent).alias("p"))
        .where("g is not null and n is not null")
        .groupBy("g", "n")
        .agg(F.min("p").alias("p"))
    )
    orphans = base.where("p is not null").select("g", F.col("p").alias("n")).distinct().join(base.select("g", "n"), ["g", "n"], "left_anti")
    base = base.unionByName(orphans.withColumn("p", F.lit(None).cast(base.schema["p"].dataType)))
    # state 0: climbing, 1: resolved (seg is the full path), 2: never ends
    climbing = F.col("state") == 0
    rounds = Rounds(parents.sparkSession)
    left = rounds.add(
        base.select(
            "g", "n", F.col("p").alias("up"), F.array("n").alias("seg"),
            F.when(F.col("p").isNull(), 1).when(F.col("p") == F.col("n"), 2).otherwise(0).alias("state"),
        ),
        climbing,
    )
    while left:
        active = rounds.last().where(climbing)
        known = rounds.all().where(~climbing).unionByName(active)
        above = known.select("g", F.col("n").alias("up"), F.col("up").alias("up2"), F.col("seg").alias("seg2"), F.col("state").alias("state2"))
        own = F.expr("state2 = 2 or (state2 = 0 and (up2 = n or array_contains(seg2, n)))")
        step = (
            active.drop("state")
            .join(above, ["g", "up"])
            .select(
                "g", "n", F.when(F.col("state2") == 0, F.col("up2")).alias("up"),
                F.when(own, F.array("n")).otherwise(F.concat("seg2", "seg")).alias("seg"),
                F.when(own, 2).otherwise(F.col("state2")).alias("state"),
            )
        )
        left = rounds.add(step, climbing)
    ended = F.col("state") == 1
    return rounds.all().where(~climbing).select(
        F.col("g").alias(group), F.col("n").alias(node),
        F.when(ended, F.get("seg", F.lit(0))).alias("root"),
        F.when(ended, F.size("seg") - 1).otherwise(-1).alias("depth"),
        F.when(ended, F.col("seg")).otherwise(F.expr("slice(seg, 1, 0)")).alias("path"),
    )


def descendants(resolved: DataFrame, group: str, node: str) -> DataFrame:
    """(group, ancestor, descendant, distance) for every resolved node and each of its proper ancestors.

    Reads ``resolve_hierarchy``'s output; nodes that never reach a root have no rows. The rows come
    straight from the paths, without a join or a gathered group.
    """
    return resolved.select(
        F.col(group), F.col(node).alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor")
    ).where("level < depth").select(group, "ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))

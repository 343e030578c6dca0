"""Statistics, structure and paths of the discourse links between a video's scenes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.discourse import CANONICAL, DYNAMIC, GLOSS, known_relation, relation_code
from sceneloom.functions.text import canonical_video_id
from sceneloom.operators.hierarchy import resolve_hierarchy
from sceneloom.runtime import Rounds, cut

LARGEST = 100_000  # links of a video that one task walks
CHAINS = 200_000  # rows of asked chains sent to the executors at once, some 20 MB
SCORED = 2_000  # library rows that meet them at once


def clean_links(links: DataFrame, samples: DataFrame) -> DataFrame:
    """(video_id, link_pos, src, tgt, rel, parent, child): the latest row of each link whose ends are scenes of the video.

    ``src`` and ``tgt`` are 1-based positions, ``parent`` and ``child`` the scene ids there; ``rel`` is normalised,
    unknown and null relations are JOINT. Links with null or out-of-range ends, or of videos without a scene list, are dropped.
    """
    latest = links.groupBy("video_id", "link_pos").agg(F.max_by(F.struct("src", "tgt", "rel"), F.struct("ingested_at", "src", "tgt")).alias("l"))
    lists = samples.where("scene_ids is not null").groupBy(canonical_video_id("video_id").alias("video_id")).agg(F.max_by("scene_ids", "ingested_at").alias("ids"))
    return (
        latest.select("video_id", "link_pos", "l.src", "l.tgt", known_relation("l.rel").alias("rel"))
        .where("src >= 1 and tgt >= 1")
        .join(lists, "video_id")
        .where("src <= size(ids) and tgt <= size(ids)")
        .select("video_id", "link_pos", "src", "tgt", "rel", F.expr("get(ids, src - 1)").alias("parent"), F.expr("get(ids, tgt - 1)").alias("child"))
    )


def void_links(links: DataFrame, samples: DataFrame) -> DataFrame:
    """(reason, links): what the latest rows of the links are void for; 'valid' for the rest."""
    latest = links.groupBy("video_id", "link_pos").agg(F.max_by(F.struct("src", "tgt"), F.struct("ingested_at", "src", "tgt")).alias("l"))
    lists = samples.groupBy(canonical_video_id("video_id").alias("video_id")).agg(F.max(F.size("scene_ids")).alias("n"))
    reason = (
        F.when(F.col("n").isNull() | (F.col("n") < 0), "no scene list")
        .when(F.col("l.src").isNull() | F.col("l.tgt").isNull(), "null end")
        .when(~(F.col("l.src").between(1, F.col("n")) & F.col("l.tgt").between(1, F.col("n"))), "out of range")
        .otherwise("valid")
    )
    return latest.join(lists, "video_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("links"))


def relation_statistics(clean: DataFrame) -> DataFrame:
    """(video_id, rel, links, first_pos): how often each relation occurs in a video, and where first."""
    return clean.groupBy("video_id", "rel").agg(F.count("*").alias("links"), F.min("link_pos").alias("first_pos"))


def discourse_summary(clean: DataFrame) -> DataFrame:
    """One row a video: number of links, counts as JSON in label order, the dominant relation (ties: first seen), and a sentence.

    Rests on the per-relation counts, at most as many as there are relations, so no video's links are gathered.
    """
    by_label = F.array_sort(F.collect_list(F.struct("rel", "links")))
    by_count = F.array_sort(F.collect_list(F.struct((-F.col("links")).alias("order"), "first_pos", "rel", "links")))
    s = relation_statistics(clean).groupBy("video_id").agg(F.sum("links").alias("num_relations"), by_label.alias("l"), by_count.alias("c"))
    share = lambda x: F.format_string("%d %s (%.1f%%)", x["links"], x["rel"], F.bround(x["links"] * 100.0 / F.col("num_relations"), 1))
    top = F.col("c")[0]["rel"]
    return s.select(
        "video_id", "num_relations", F.to_json(F.map_from_entries("l")).alias("relation_statistics"), top.alias("dominant"),
        F.format_string(
            "%d rhetorical relations, mostly %s: %s", F.col("num_relations"), top, F.array_join(F.transform("c", share), ", ")
        ).alias("summary"),
    )


def relation_sequence(clean: DataFrame) -> DataFrame:
    """(video_id, sequence): a line ``S<src> --<rel>--> S<tgt>`` for each link, by source and target. The text is the feature, so a video's lines meet in one row."""
    line = F.format_string("S%d --%s--> S%d", "src", "rel", "tgt")
    lines = F.array_sort(F.collect_list(F.struct("src", "tgt", "link_pos", line.alias("line"))))
    return clean.groupBy("video_id").agg(lines.alias("l")).select("video_id", F.array_join(F.col("l.line"), "\n").alias("sequence"))


def topology(clean: DataFrame) -> DataFrame:
    """(video_id, topology, tension): shares of the canonical types (all zero if there is none of them) and the share of dynamic links."""
    is_of = lambda *t: F.col("rel").isin(*t)
    counts = clean.groupBy("video_id").agg(
        *(F.count_if(is_of(t)).alias(t) for t in CANONICAL), F.count_if(is_of(*CANONICAL)).alias("n"), F.count_if(is_of(*DYNAMIC)).alias("moving"), F.count("*").alias("all")
    )
    share = lambda t: F.when(F.col("n") > 0, F.col(t) / F.col("n")).otherwise(0.0)
    return counts.select("video_id", F.array(*map(share, CANONICAL)).alias("topology"), (F.col("moving") / (F.col("all") + 1e-6)).alias("tension"))


def undirected(clean: DataFrame) -> DataFrame:
    """(video_id, a, b, rel): every link in both directions once; of several relations between two scenes the one with the greatest code holds."""
    there = clean.select("video_id", F.col("parent").alias("a"), F.col("child").alias("b"), "rel")
    back = clean.select("video_id", F.col("child").alias("a"), F.col("parent").alias("b"), "rel")
    return there.unionByName(back).where("a <> b").groupBy("video_id", "a", "b").agg(F.element_at(F.array(*map(F.lit, GLOSS)), F.max(relation_code("rel")) + 1).alias("rel"))


def linked_scene(clean: DataFrame) -> DataFrame:
    """(video_id, scene_id, linked): a scene's parent by its last link, else its first child."""
    parent = clean.groupBy("video_id", F.col("child").alias("scene_id")).agg(F.max_by("parent", "link_pos").alias("parent"))
    child = clean.groupBy("video_id", F.col("parent").alias("scene_id")).agg(F.min_by("child", "link_pos").alias("child"))
    return parent.join(child, ["video_id", "scene_id"], "full").select("video_id", "scene_id", F.coalesce("parent", "child").alias("linked"))


def local_context(clean: DataFrame, most: int = 2) -> DataFrame:
    """(video_id, scene_id, neighbour, rel, row): the first ``most`` neighbours of each scene over links in either direction."""
    w = Window.partitionBy("video_id", "a").orderBy("b")
    return undirected(clean).withColumn("row", F.row_number().over(w)).where(F.col("row") <= most).select("video_id", F.col("a").alias("scene_id"), F.col("b").alias("neighbour"), "rel", "row")


def within_hops(clean: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(video_id, scene_id, hops): scenes at most ``hops`` links from a seed (video_id, scene_id), by one join a hop."""
    edges = undirected(clean).select("video_id", F.col("a").alias("scene_id"), "b")
    reached = seeds.select("video_id", "scene_id", F.lit(0).alias("hops")).distinct()
    front = reached
    for h in range(1, hops + 1):
        step = front.join(edges, ["video_id", "scene_id"]).select("video_id", F.col("b").alias("scene_id")).distinct()
        front = step.join(reached.select("video_id", "scene_id"), ["video_id", "scene_id"], "left_anti").withColumn("hops", F.lit(h))
        reached = reached.unionByName(front)
    return reached


def relation_paths(clean: DataFrame, shortest: int = 2, longest: int = 4) -> DataFrame:
    """(video_id, chain, nodes, links): paths of ``shortest`` to ``longest`` links inside a video that repeat no link, by self joins.

    A path may pass a scene twice. ``chain`` holds the relations, ``nodes`` the scenes, ``links`` the positions.
    """
    step = clean.select("video_id", F.col("parent").alias("tail"), F.col("child").alias("head"), F.col("rel").alias("r"), F.col("link_pos").alias("l"))
    paths = step.select("video_id", "head", F.array("r").alias("chain"), F.array("tail", "head").alias("nodes"), F.array("l").alias("links"))
    out = []
    for n in range(2, longest + 1):
        nxt = step.select("video_id", F.col("tail").alias("head"), F.col("head").alias("to"), "r", "l")
        paths = (
            paths.join(nxt, ["video_id", "head"])
            .where(~F.array_contains("links", F.col("l")))
            .select("video_id", F.col("to").alias("head"), F.concat("chain", F.array("r")).alias("chain"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("links", F.array("l")).alias("links"))
        )
        if n >= shortest:
            out.append(paths.drop("head"))
    return reduce(DataFrame.unionByName, out)


def asked_chains(paths: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, chain): the relation chains of each video's ``limit`` longest paths, ties in the order of chain and links; each once."""
    w = Window.partitionBy("video_id").orderBy(F.desc(F.size("chain")), F.array_join("chain", ">"), "links")
    longest = paths.withColumn("row", F.row_number().over(w)).where(F.col("row") <= limit)
    return longest.select(F.col("video_id").alias("query_id"), F.array_join("chain", ">").alias("chain")).distinct()


def structural_matches(asked: DataFrame, paths: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, video_id, max_nodes, matched, rank): the ``k`` library videos of each query with the longest common chain, then most distinct paths of common chains, then by video.

    ``asked``(query_id, chain) is a stated query set, ``paths``(video_id, chain, nodes, links) the library's. The asked
    chains go to the executors in blocks of at most CHAINS rows, and every partition of the library, one row a video
    and chain, scores its videos against a block and keeps its best ``k`` per query. So a chain that all videos have
    makes no pairs of rows, and what is shuffled afterwards is queries x k per partition. A query is no match of its own.
    """
    kind = paths.schema["video_id"].dataType.simpleString()
    out = f"query_id {kind}, video_id {kind}, max_nodes int, matched bigint"
    held = paths.select("video_id", F.array_join("chain", ">").alias("chain"), F.size("chain").alias("n"), "nodes", "links").groupBy("video_id", "chain", "n").agg(F.countDistinct("nodes", "links").alias("paths"))
    held = held.repartition("video_id").sortWithinPartitions("video_id")
    wanted = cut(asked.select("query_id", "chain").distinct())
    parts = []
    for b in range(blocks := max(1, -(-wanted.count() // CHAINS))):
        ask = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        if not len(ask):
            continue
        shared = paths.sparkSession.sparkContext.broadcast(ask)

        def score(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best, rest = [], None
            for pdf in it:
                # rows are sorted by video: the last one of a batch may go on in the next
                pdf = pdf if rest is None else pd.concat([rest, pdf])
                last = pdf["video_id"] == pdf["video_id"].iloc[-1]
                rest = pdf[last]
                best = [_best_matches([*best, _scored(shared.value, pdf[~last])], k)]
            if rest is not None:
                yield _best_matches([*best, _scored(shared.value, rest)], k)

        parts.append(held.mapInPandas(score, out))
    if not parts:
        return paths.sparkSession.createDataFrame([], f"{out}, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("max_nodes"), F.desc("matched"), "video_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(ask: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for a in range(0, len(held), SCORED):  # rows of a batch; those of one video in two parts are added up below
        m = ask.merge(held.iloc[a : a + SCORED], on="chain")
        m = m[m["query_id"] != m["video_id"]]
        parts.append(m.groupby(["query_id", "video_id"], as_index=False).agg(max_nodes=("n", "max"), matched=("paths", "sum")))
    if not parts:
        return pd.DataFrame({"query_id": [], "video_id": [], "max_nodes": [], "matched": []})
    both = pd.concat(parts).groupby(["query_id", "video_id"], as_index=False).agg({"max_nodes": "max", "matched": "sum"})
    return both.assign(max_nodes=both["max_nodes"] + 1)


def _best_matches(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    return pd.concat(parts).sort_values(["query_id", "max_nodes", "matched", "video_id"], ascending=[True, False, False, True]).groupby("query_id", sort=False).head(k)


def match_details(matches: DataFrame, asked: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, video_id, chain, nodes, links, length): a row for each path of a matched video whose chain its query asks for; ``length`` counts scenes.

    Only the matches that ``structural_matches`` kept are joined back, and rows stay rows: nothing is collected.
    """
    p = paths.select("video_id", F.array_join("chain", ">").alias("chain"), "nodes", "links")
    return matches.select("query_id", "video_id").join(asked, "query_id").join(p, ["video_id", "chain"]).select("query_id", "video_id", "chain", "nodes", "links", F.size("nodes").alias("length")).distinct()


def depths(clean: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(video_id, scene_id, depth): links between each scene and the anchor, the smallest source of a ROOT link, else the smallest scene; -1 if there is no way."""
    return breadth_first(clean, largest).select("video_id", "scene_id", "depth")


def paths_to_root(clean: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(video_id, scene_id, path): relation and scene of every step on a shortest way to the anchor, "" for the anchor and scenes without a way.

    Of several ways on, the one over the earliest link is taken.
    """
    seen = cut(breadth_first(clean, largest))
    ways = resolve_hierarchy(seen.where("depth >= 0").select("video_id", "scene_id", "before"), "video_id", "scene_id", "before")
    steps = ways.select("video_id", F.col("scene_id").alias("from"), F.posexplode(F.reverse("path")).alias("i", "scene_id")).join(seen, ["video_id", "scene_id"]).where("before is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("rel", F.lit(">"), "before").alias("s")))), lambda x: x["s"]), " ")
    told = steps.groupBy("video_id", F.col("from").alias("scene_id")).agg(text.alias("path"))
    return seen.select("video_id", "scene_id").join(told, ["video_id", "scene_id"], "left").select("video_id", "scene_id", F.coalesce("path", F.lit("")).alias("path"))


def breadth_first(clean: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(video_id, scene_id, depth, before, rel): each scene's depth and the link to the scene before it, of several the earliest.

    Videos of up to ``largest`` links are walked in one task each; larger ones level by level, one join a level.
    """
    size = clean.groupBy("video_id").agg(F.count("*").alias("size"))
    sized = cut(clean.join(size, "video_id").select("video_id", "link_pos", "parent", "child", "rel", "size"))
    small = sized.where(F.col("size") <= largest).drop("size").groupBy("video_id").applyInPandas(_walk, "video_id string, scene_id int, depth int, before int, rel string")
    big = sized.where(F.col("size") > largest)
    if big.isEmpty():
        return small
    ends = F.inline(F.array(*(F.struct(F.col(a).alias("scene_id"), F.col(b).alias("to")) for a, b in (("parent", "child"), ("child", "parent")))))
    edges = cut(big.select("video_id", "link_pos", "rel", ends))
    anchor = big.groupBy("video_id").agg(F.coalesce(F.min(F.when(F.col("rel") == "ROOT", F.col("parent"))), F.min(F.least("parent", "child"))).alias("scene_id"))
    rounds = Rounds(clean.sparkSession)
    rounds.add(anchor.select("video_id", "scene_id", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("before"), F.lit(None).cast("string").alias("rel")), F.lit(True))
    depth = 0
    while True:
        depth += 1
        step = rounds.last().select("video_id", "scene_id").join(edges, ["video_id", "scene_id"]).join(rounds.all().select("video_id", F.col("scene_id").alias("to")), ["video_id", "to"], "left_anti")
        first = F.min_by(F.struct(F.col("scene_id").alias("before"), "rel"), F.struct("link_pos", "scene_id")).alias("l")
        found = step.groupBy("video_id", F.col("to").alias("scene_id")).agg(first).select("video_id", "scene_id", F.lit(depth).alias("depth"), "l.before", "l.rel")
        if not rounds.add(found, F.lit(True)):
            break
    nodes = edges.select("video_id", "scene_id").distinct().join(rounds.all(), ["video_id", "scene_id"], "left")
    return small.unionByName(nodes.withColumn("depth", F.coalesce("depth", F.lit(-1))).select("video_id", "scene_id", "depth", "before", "rel"))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, list[tuple[int, int, str]]] = {}
    roots = []
    for pos, p, c, rel in zip(pdf["link_pos"], pdf["parent"], pdf["child"], pdf["rel"]):
        near.setdefault(p, []).append((pos, c, rel))
        near.setdefault(c, []).append((pos, p, rel))
        if rel == "ROOT":
            roots.append(p)
    anchor = min(roots or near)
    seen: dict[int, tuple] = {anchor: (0, None, None)}
    front, depth = [anchor], 0
    while front:
        depth += 1
        best: dict[int, tuple[int, int, str]] = {}
        for a in front:
            for pos, b, rel in near[a]:
                if b not in seen and (b not in best or (pos, a) < best[b][:2]):
                    best[b] = (pos, a, rel)
        seen |= {b: (depth, a, rel) for b, (_, a, rel) in best.items()}
        front = list(best)
    rows = [(pdf["video_id"].iloc[0], s, *seen.get(s, (-1, None, None))) for s in near]
    return pd.DataFrame(rows, columns=["video_id", "scene_id", "depth", "before", "rel"]).astype({"before": "Int32"})


def tree_text(clean: DataFrame, captions: DataFrame) -> DataFrame:
    """(video_id, tree): the scenes as an indented tree, depth first in link order, with relation and caption; scenes off the tree follow at the end.

    A scene is written once, under the parent that reaches it first, so cycles end.
    """
    order = clean.select("video_id", "link_pos", "parent", "child", "rel")
    text = order.groupBy("video_id").agg(F.collect_list(F.struct("link_pos", "parent", "child", "rel")).alias("links")).join(
        captions.groupBy("video_id").agg(F.collect_list(F.struct("scene_id", "caption")).alias("captions")), "video_id"
    )

    def run(it):
        for pdf in it:
            out = []
            for links, caps in zip(pdf["links"], pdf["captions"]):
                said = {c["scene_id"]: c["caption"] for c in sorted(caps, key=lambda c: c["scene_id"])}
                kids: dict[int, list[tuple[int, str]]] = {}
                has_parent = set()
                for ln in sorted(links, key=lambda x: x["link_pos"]):
                    kids.setdefault(ln["parent"], []).append((ln["child"], ln["rel"]))
                    has_parent.add(ln["child"])
                lines, seen = [], set()
                starts = [s for s in [*sorted(kids), *sorted(said)] if s not in has_parent] + sorted(kids) + sorted(said)
                for start in starts:
                    todo = [(start, "", 0)]
                    while todo:
                        s, rel, d = todo.pop()
                        if s not in seen:
                            seen.add(s)
                            lines.append("  " * d + (f"[{rel}] " if rel else "") + f"Scene {s}: {said.get(s) or ''}")
                            todo += [(c, r, d + 1) for c, r in reversed(kids.get(s, []))]
                out.append("\n".join(lines))
            yield pd.DataFrame({"video_id": pdf["video_id"], "tree": out})

    return text.mapInPandas(run, "video_id string, tree string")

import pytest
from pyspark.sql import functions as F

from sceneloom.functions import rst_tree as rt
from sceneloom.functions.discourse import chain_gloss, gloss
from sceneloom.functions.text import relation_label
from sceneloom.operators import discourse as op

CLEAN = "video_id string, link_pos int, src int, tgt int, rel string, parent int, child int"


@pytest.fixture
def clean(spark):
    return spark.createDataFrame(
        [("v", 1, 1, 2, "TEMPORAL", 0, 1), ("v", 2, 2, 3, "TEMPORAL", 1, 2), ("v", 3, 3, 4, "JOINT", 2, 3), ("v", 4, 1, 4, "ATTRIBUTION", 0, 3), ("w", 1, 2, 1, "SPAN", 1, 0), ("w", 2, 1, 2, "SPAN", 0, 1)], CLEAN
    )


def test_labels(spark):
    df = spark.createDataFrame([("same-unit",), (" Topic Comment ",), (None,), ("odd_one",)], "r string")
    assert [r[0] for r in df.select(relation_label("r")).collect()] == ["SAME_UNIT", "TOPIC_COMMENT", None, "ODD_ONE"]
    assert [r[0] for r in df.select(gloss(relation_label("r"))).collect()] == ["continues from", "comments on", None, "odd one"]
    assert df.select(chain_gloss(F.array(F.lit("CAUSE"), F.lit("JOINT")))).first()[0] == "causes -> alongside"


def test_topology_and_summary(spark, clean):
    t = {r.video_id: r for r in op.topology(clean).collect()}
    assert t["v"].topology[:2] == [pytest.approx(2 / 3), pytest.approx(1 / 3)] and sum(t["v"].topology) == pytest.approx(1)
    assert t["v"].tension == pytest.approx(2 / (4 + 1e-6))
    s = {r.video_id: r for r in op.discourse_summary(clean).collect()}
    assert s["v"].dominant == "TEMPORAL" and "2 TEMPORAL (50.0%)" in s["v"].summary
    assert s["v"].relation_statistics == '{"ATTRIBUTION":1,"JOINT":1,"TEMPORAL":2}'


def test_empty_statistics(spark, clean):
    none = clean.where("false")
    for f in (op.topology, op.discourse_summary, op.relation_sequence, op.undirected, op.linked_scene, op.depths, op.relation_paths):
        assert f(none).count() == 0


def test_depths_differ_by_one_over_links(spark, clean):
    d = {(r.video_id, r.scene_id): r.depth for r in op.depths(clean).collect()}
    assert d["v", 0] == 0 and d["v", 3] == 1
    assert all(abs(d[r.video_id, r.parent] - d[r.video_id, r.child]) <= 1 for r in clean.collect())


def test_large_videos_are_walked_level_by_level(spark, clean):
    from random import Random

    rng = Random(3)
    links = [("r", i, 0, 0, rng.choice(["CAUSE", "ROOT", "JOINT"]), rng.randrange(25), rng.randrange(25)) for i in range(30)]
    df = clean.unionByName(spark.createDataFrame([(v, i, 0, 0, r, p, c) for v, i, _, _, r, p, c in links], CLEAN))
    for f in (op.depths, op.paths_to_root, op.breadth_first):
        one, two = ({tuple(r) for r in f(df, n).collect()} for n in (0, 100))
        assert one == two and len(one) > 10
    paths = {(r.video_id, r.scene_id): r.path for r in op.paths_to_root(clean).collect()}
    assert paths["v", 2] == "TEMPORAL>1 TEMPORAL>0" and paths["v", 3] == "ATTRIBUTION>0" and paths["v", 0] == ""


def test_paths_repeat_no_link(spark, clean):
    p = op.relation_paths(clean).collect()
    assert all(len(set(r.links)) == len(r.links) for r in p)
    assert sorted(tuple(r.nodes) for r in p if r.video_id == "v") == [(0, 1, 2), (0, 1, 2, 3), (1, 2, 3)]
    assert sorted(tuple(r.nodes) for r in p if r.video_id == "w") == [(0, 1, 0), (1, 0, 1)]


def test_hops_and_tree(spark, clean):
    seeds = spark.createDataFrame([("v", 0)], "video_id string, scene_id int")
    assert sorted((r.scene_id, r.hops) for r in op.within_hops(clean, seeds, 2).collect()) == [(0, 0), (1, 1), (2, 2), (3, 1)]
    caps = spark.createDataFrame([("v", 0, "a"), ("v", 7, "z"), ("w", 0, None)], "video_id string, scene_id int, caption string")
    trees = {r.video_id: r.tree.split("\n") for r in op.tree_text(clean, caps).collect()}
    assert trees["v"][0] == "Scene 0: a" and trees["v"][-1] == "Scene 7: z" and "    [TEMPORAL] Scene 2: " in trees["v"]
    assert len(trees["w"]) == 2  # a cycle is written once


def test_trees():
    t = rt.parse_tree("(nucleus-satellite:elaboration (text 0) (nucleus-nucleus:joint (text 1) (text 2)))")
    assert rt.spans(t) == [(1, 1, "N", "span"), (2, 2, "N", "joint"), (3, 3, "N", "joint"), (2, 3, "S", "elaboration"), (1, 3, "N", "ROOT")]
    assert rt.links(t) == [(2, 3, "elaboration"), (1, 2, "ROOT")]
    assert rt.links(rt.parse_tree("(satellite-nucleus:cause (text 0) (text 1))")) == [(1, 2, "ROOT")]
    for bad in ("", "(a:b (text 0)", "(a:b (text 0)) x", "(a:b)", "(text x)", "text", "(a (text 0) (text 1)"):
        with pytest.raises(ValueError):
            rt.parse_tree(bad)


def test_tree_columns(spark):
    df = spark.createDataFrame([("(nucleus-nucleus:joint (text 0) (text 1))",), ("(",), (None,)], "t string")
    got = df.select(rt.tree_links("t").alias("l"), rt.tree_spans("t").alias("s")).collect()
    assert [tuple(x) for x in got[0].l] == [(1, 2, "ROOT")] and got[1].l is None and got[2].s is None


def test_unit_alignment():
    assert rt.align_units(["It", "’s", "fun", "."], ["It's", "fun."]) == [1, 1, 2, 2]
    for bad in (["x"], ["It's fun. more"]):
        with pytest.raises(ValueError):
            rt.align_units(["It", "'s", "fun", "."], bad)

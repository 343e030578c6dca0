from pyspark.sql import functions as F

from sceneloom.operators import graph_evidence as ge


def test_best_and_votes(spark, rows):
    m = spark.createDataFrame(
        [(1, "q", "a", 1, 3, 2), (1, "q", "a", 1, 3, 2), (2, "q", "b", 2, 3, 5), (3, "q", "c", None, None, 9), (4, None, "d", 1, 9, 9)],
        "match_no int, query_video_id string, video_id string, video_label int, max_nodes_matched int, total_matched_sequences int",
    )
    assert rows(ge.best_structural(m, 5), "rank", "video_id") == [(1, "b"), (2, "a"), (3, "c")]
    s = spark.createDataFrame([("q", "x", 1, 0.5), ("q", "x", 1, 0.9), ("q", "y", 0, float("nan")), ("q", "z", 0, 0.9)], "query_video_id string, video_id string, video_label int, avg_score double")
    assert rows(ge.best_similar(s, 5), "rank", "video_id") == [(1, "x"), (2, "z")]
    assert sorted(str(r.video_label) for r in ge.graph_voters(m, s, 2).collect()) == ["0", "1", "1", "2"]
    assert ge.best_structural(m.where("false")).count() == 0 and ge.best_similar(s.where("false")).count() == 0


def test_triples(spark, rows):
    a = spark.createDataFrame([("q", "c1", "CAUSE", "c2"), ("q", "c1", "CAUSE", "c2"), ("r", "c9", "CAUSE", None)], "query string, c_src string, rel string, c_tgt string")
    h = spark.createDataFrame([("v", "c1", "CAUSE", "c2"), ("q", "c1", "CAUSE", "c2"), ("w", "c1", "CAUSE", "c2")], "video_id string, c_src string, rel string, c_tgt string")
    assert rows(ge.match_triples(a, h, 1), "query", "video_id", "row") == [("q", "v", 1)]


def test_captions_fall_back(spark, rows):
    caps = spark.createDataFrame([("v", 0, "first"), ("v", 1, "x" * 40 + "one"), ("v", 2, None)], "video_id string, scene_id int, caption string")
    hits = spark.createDataFrame([("a", "v", 1, None), ("b", "v", 7, "x" * 40 + "two"), ("c", "v", 2, "short"), ("d", "w", 0, None)], "hit string, video_id string, scene_id int, said string")
    assert rows(ge.hit_captions(hits, caps), "hit", "caption") == [("a", "x" * 40 + "one"), ("b", "x" * 40 + "one"), ("c", "first"), ("d", None)]


def test_edges_blocks_and_units(spark, rows):
    raw = spark.createDataFrame([("v", "scene 0", "Scene_2", "cause"), ("v", "1", "9", "cause"), ("v", "1", "1", "cause"), ("v", "0", "1", "odd"), ("v", None, "1", "cause")], "video_id string, src string, tgt string, rel string")
    assert rows(ge.valid_edges(raw, spark.createDataFrame([("v", 3)], "video_id string, n int")), "src", "tgt", "rel") == [(0, 2, "CAUSE")]
    hits = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a")], "query string, rank int, v string")
    asked = spark.createDataFrame([("q",), ("r",)], "query string")
    assert rows(ge.evidence_block(hits, "query", F.col("v"), "Hits:", "None.", asked)) == [("q", "Hits:\na\nb"), ("r", "None.")]
    tok = spark.createDataFrame([("d", 0, 2, "obj", 1), ("d", 0, 1, "nsubj", 1), ("d", 0, 3, "punct", 2)], "doc string, sent int, tok int, dep string, edu int")
    assert rows(ge.unit_tokens(tok), "edu", "first_tok", "last_tok", "deps") == [(1, 1, 2, ["nsubj", "obj"]), (2, 3, 3, ["punct"])]
    assert [r.batch for r in ge.batches(spark.range(3), "id", 2).orderBy("id").collect()] == [0, 0, 1]
    assert spark.range(1).select(ge.sparsity(F.lit(1), F.lit(4))).first()[0] == 0.75


def test_pruned_tree(spark):
    clean = spark.createDataFrame([("v", 1, 1, 2, "CAUSE", 0, 1), ("v", 2, 2, 3, "JOINT", 1, 2), ("v", 3, 3, 4, "SPAN", 2, 3)], "video_id string, link_pos int, src int, tgt int, rel string, parent int, child int")
    caps = spark.createDataFrame([("v", i, f"c{i}") for i in range(5)], "video_id string, scene_id int, caption string")
    hits = spark.createDataFrame([("v", 1)], "video_id string, scene_id int")
    assert ge.pruned_tree(clean, caps, hits).first().tree.split("\n") == ["Scene 0: c0", "  [CAUSE] Scene 1: c1", "    [JOINT] Scene 2: c2"]

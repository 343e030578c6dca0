from sceneloom.operators import graph_evidence as ge


def test_short_and_inner_captions_match(spark, rows):
    caps = spark.createDataFrame([("v", 0, "first"), ("v", 1, "a dog"), ("v", 2, "so: " + "y" * 50)], "video_id string, scene_id int, caption string")
    hits = spark.createDataFrame([("a", "v", 8, "then a dog runs"), ("b", "v", 9, "y" * 45), ("c", "v", 7, "else")], "hit string, video_id string, scene_id int, said string")
    assert rows(ge.hit_captions(hits, caps), "hit", "caption") == [("a", "a dog"), ("b", "so: " + "y" * 50), ("c", "first")]

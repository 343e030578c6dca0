import json

from sceneloom.operators import concepts as cp


def test_metadata_keeps_all_videos_and_scenes(spark):
    data = [("c", f"v{v}", s, "x" * 60) for v in range(7) for s in range(4)]
    df = spark.createDataFrame(data, "concept_id string, video_id string, scene_id int, caption string")
    whole, short = (json.loads(f(df).first()["metadata"]) for f in (cp.concept_metadata, cp.concept_prompt))
    assert [len(v["scenes"]) for v in whole] == [4] * 7 and [len(v["scenes"]) for v in short] == [3] * 5
    assert {s["caption"] for v in whole for s in v["scenes"]} == {"x" * 60}

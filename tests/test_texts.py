import json

import pytest
from pyspark.sql import functions as F

from sceneloom.functions import text as tx
from sceneloom.functions.boundaries import apply_model, narrate
from sceneloom.functions.captions import batch_captions, normal_caption, plain_caption
from sceneloom.operators import segmentation as sg
from sceneloom.sources import readers as rd
from sceneloom.sources import writers as wr
from sceneloom.streaming import incremental
from sceneloom.streaming.incremental import latest, new_videos, run_to_table, sessions, upsert_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_verdicts(spark):
    cases = {
        '```json\n{"predicted_label": 5, "explanation": "e"}\n```': (2, "e"), '{"predicted_label": "1", "explanation": null}': (1, None), 'so {"predicted_label": 0, "explanation": "x': (0, "Broad Regex"),
        "Prediction: 9": (2, "Broad Regex"), "nothing": (-1, "Parsing failed"), "": (-1, "Empty LLM response"), None: (-1, "Empty LLM response"), '{"predicted_label": 1.5}': (1, "Broad Regex"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", tx.verdict("r").alias("v"))
    assert {r.r: (r.v.predicted_label, r.v.explanation) for r in df.collect()} == cases


def test_strings(spark):
    assert one(spark, tx.shorten(F.lit("x" * 991), 990)) == "x" * 990 + "..." and one(spark, tx.shorten(F.lit("x" * 990), 990)) == "x" * 990
    assert one(spark, tx.timecode_seconds(F.lit("01:02:03.5"))) == 3723.5 and one(spark, tx.timecode_seconds(F.lit("a:b"))) is None
    assert one(spark, tx.scene_of_uid(F.lit("a_b_scene_12"))) == 12 and one(spark, tx.scene_of_uid(F.lit("a"))) is None
    assert one(spark, tx.fit(F.array(F.lit("a"), F.lit("b")), F.lit(3))) == ["a", "b", ""] and one(spark, tx.fit(F.array(F.lit("a"), F.lit("b")), F.lit(1))) == ["a"]
    assert one(spark, tx.spoken_lines(F.array(F.lit("A"), F.lit("B")), F.array(F.lit(" "), F.lit("hi ")), " / ")) == "B: hi"
    assert tuple(one(spark, tx.dominant_label(F.lit('{"0":2,"1":2}')))) == (0, 2, 4) and one(spark, tx.dominant_label(F.lit("x"))) is None
    assert one(spark, tx.same_caption(F.lit("abc"), F.lit("abcdef"))) and not one(spark, tx.same_caption(F.lit("abx"), F.lit("abcdef")))
    ids = ["EnTube/x/abcdefghijk", "https://v.example/watch?v=abcdefghijk", " abcdefghijk ", "abcdefghijk.MP4", "short"]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select(tx.canonical_video_id("i").alias("c"))
    assert [r.c for r in df.collect()] == ["abcdefghijk"] * 4 + ["short"]


def test_captions(spark):
    assert plain_caption("Đèn  “café”, OK!") == "den cafe , ok !" and plain_caption(None) == ""
    item = {"scene_id": 1, "caption": "a"}
    for raw in (json.dumps([item]), "```json\n" + json.dumps([item]) + "```", json.dumps({"scenes": [item]}), json.dumps(item) + "\n" + json.dumps(item | {"bad": 1}), '[{"scene_id": 1, "caption": "a"}, {"scene_id'):
        assert batch_captions(raw)[0] == item
    assert batch_captions(None) == [] and batch_captions("x") == []
    assert [r.c for r in spark.createDataFrame([("É",), (None,)], "t string").select(normal_caption("t").alias("c")).collect()] == ["e", ""]


def test_spacing_and_nodes(spark):
    assert one(spark, sg.spaced(F.array(*map(F.lit, (3.0, 1.0, 1.5, 2.0, 2.2))), 1.0)) == [1.0, 2.0, 3.0]
    cut = lambda b, d, n=3: [tuple(x) for x in one(spark, sg.nodes(F.array(*map(F.lit, b)).cast("array<double>"), F.lit(float(d)), n))]
    assert cut([], 9) == [(0, 3), (3, 6), (6, 9)] and cut([], 3) == [(0, 1), (1, 2), (2, 3)]
    assert cut([2.0, 2.5, 5.0, 8.0], 9) == [(0, 2), (2, 5), (5, 9)]


def test_alignment():
    said = [(0.2, 0.9, "a", "S"), (1.8, 2.6, "b", "S"), (3.5, 5.5, "c", "S")]
    got = sg.align([(0.0, 2.0), (2.0, 4.0), (4.0, 6.0)], said)
    assert got == [(0, 0.0, 0.2, "", ""), (0, 0.2, 0.9, "a", "S"), (0, 0.9, 2.0, "", ""), (1, 2.0, 2.6, "b", "S"), (1, 2.6, 4.0, "", ""), (2, 4.0, 5.5, "c", "S")]
    assert sg.align([(0.0, 0.5)], []) == [(0, 0.0, 0.5, "", "")]


def test_readers(spark, tmp_path, rows):
    for folder, body in {"a": json.dumps([{"caption": "x"}, {"caption": "y"}]), "b": json.dumps({"4": {"caption": "z"}, "k": {"caption": "?"}}), "c": "{oops"}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "segments.json").write_text(body)
    scenes, rejected = rd.scene_files(spark, f"{tmp_path}/*/segments.json")
    assert rows(scenes, "video_id", "scene_id", "caption") == [("a", 0, "x"), ("a", 1, "y"), ("b", 4, "z")]
    assert rows(rejected) == [("b", "scene key k"), ("c", "not a list or object")]
    done = spark.createDataFrame([("a",)], "folder string")
    assert rows(rd.unprocessed(rd.files(spark, f"{tmp_path}/*/segments.json"), done), "folder") == [("b",), ("c",)]
    (tmp_path / "l.json").write_text(json.dumps({"1": ["u", "v.mp4"], "x": ["w"]}))
    labels = rd.label_map(spark, str(tmp_path / "l.json"))
    assert rows(labels) == [("u", 1), ("v", 1), ("v.mp4", 1)]
    videos = spark.createDataFrame([("u", "u.mp4"), ("q", "v.mp4"), ("n", "n.mp4")], "video_id string, file_name string")
    assert rows(rd.resolve_labels(videos, labels), "video_id", "label") == [("n", -1), ("q", 1), ("u", 1)]
    (tmp_path / "s.json").write_text(json.dumps({"train": ["u", "u"], "val": []}))
    assert rows(rd.splits(spark, str(tmp_path / "s.json"))) == [("train", "u")]
    (tmp_path / "i.csv").write_text("video_id,video_link,engagement_rate_label\nu,l,1\nz,l,2\n")
    assert rows(rd.csv_index(spark, str(tmp_path / "i.csv"), labels), "video_id") == [("z",)]
    (tmp_path / "t.conll").write_text("0\t1\tHi\thi\tUH\troot\t0\tO\n\n0\t2\tx\n")
    assert rows(rd.token_rows(spark, str(tmp_path / "t.conll"), strict=False), "word", "head") == [("Hi", 0)]
    (tmp_path / "x").mkdir()
    tok = '<token id="1"><word>Hi</word><lemma>hi</lemma><POS>UH</POS><NER>O</NER></token>'
    dep = '<dependencies type="basic-dependencies"><dep type="root"><governor idx="0">ROOT</governor><dependent idx="1">Hi</dependent></dep></dependencies>'
    (tmp_path / "x" / "a.xml").write_text(f"<root><document><sentences><sentence id='1'><tokens>{tok}</tokens>{dep}</sentence></sentences></document></root>")
    (tmp_path / "x" / "b.xml").write_text("<broken")
    assert rows(rd.xml_token_rows(spark, f"{tmp_path}/x/*.xml"), "word", "dep", "head") == [("Hi", "root", 0)]
    (tmp_path / "a" / "audio.json").write_text(json.dumps({"segments": [{"start": 0, "end": 1, "text": "t"}]}))
    (tmp_path / "b" / "audio.json").write_text(json.dumps([{"start": 0, "end": 1, "text": "t", "speaker": "S"}]))
    assert rows(rd.transcript_files(spark, f"{tmp_path}/*/audio.json"), "video_id", "speaker") == [("a", None), ("b", "S")]
    assert rd.or_empty(spark, str(tmp_path / "gone"), "a int").count() == 0


def test_writers(spark, tmp_path, rows):
    df = spark.createDataFrame([("CAUSE", 1), ("JOINT", 2)], "rst_type string, n int")
    assert wr.create_table(df, f"{tmp_path}/t", "rst_type") and not wr.create_table(df.limit(0), f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 2
    wr.quarantine(spark.createDataFrame([("k", "r")], "key string, reason string"), f"{tmp_path}/q", "step")
    assert rows(spark.read.json(f"{tmp_path}/q"), "key", "step") == [("k", "step")]
    wr.append_csv(spark.createDataFrame([("v", 0.5)], "v string, score double"), f"{tmp_path}/c", "score")
    assert spark.read.csv(f"{tmp_path}/c", header=True).first().score == "0.5000"
    wr.write_lines(df, "rst_type", f"{tmp_path}/x")
    assert rows(wr.without(df, df.where("n = 1"), "n"), "rst_type", "n") == [("JOINT", 2)] and spark.read.text(f"{tmp_path}/x").count() == 2
    scenes = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, scene_id int")
    edges = spark.createDataFrame([("v", 1, 2), ("v", 1, 1)], "video_id string, parent int, child int")
    kept = wr.important_only(scenes, edges, scenes.where("scene_id = 1"))
    assert (kept[0].count(), rows(kept[1], "parent", "child")) == (1, [(1, 1)])


def test_models_fail_row_by_row(spark):
    def model(pdf):
        if (pdf["x"] < 0).any():
            raise ValueError("negative")
        return pdf.assign(y=pdf["x"] * 2)

    got = apply_model(spark.createDataFrame([("a", 1), ("b", -1), ("c", 3)], "k string, x long").coalesce(1), model, "k", "k string, y long").collect()
    assert sorted((r.k, r.y, r.status) for r in got) == [("a", 2, "ok"), ("b", None, "error"), ("c", 6, "ok")]
    df = spark.createDataFrame([("v", i, str(i)) for i in range(12)], "video_id string, n int, t string")
    said = narrate(df, lambda s, t: ([f"{s}|{x}" for x in t], f"upto {t[-1]}"), "video_id", "n", "t").collect()
    assert {r.n: r.caption for r in said}[11] == "upto 9|11"


def test_streams(spark, tmp_path, rows):
    src = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:05", 2), ("b", "2024-01-01 00:50:00", 1)], "k string, t string, v int").selectExpr("k", "timestamp(t) as t", "v")
    src.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    assert rows(run_to_table(new_videos(stream(), "k", "t"), f"{tmp_path}/o", f"{tmp_path}/c").select("k")) == [("a",), ("b",)]
    upsert_stream(stream(), f"{tmp_path}/u", f"{tmp_path}/uc", ["k"], "t")
    assert rows(latest(spark, f"{tmp_path}/u", src.schema, ["k"], "t", 0), "k", "v") == [("a", 2), ("b", 1)]
    assert rows(sessions(src, "k", "t"), "k", "n") == [("a", 2), ("b", 1)]
    assert sessions(src, "k", "t", late="1 hour").count() == 2


def test_upserted_deltas_are_merged(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    for i, batch in enumerate(([("a", 1, 1)], [("a", 3, 2), ("b", 1, 1)], [("a", 2, 9), ("c", 1, 1)])):
        spark.createDataFrame(batch, "k string, t int, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_stream(spark.readStream.schema("k string, t int, v int").parquet(f"{tmp_path}/in"), f"{tmp_path}/u", f"{tmp_path}/log", ["k"], "t")
        assert len(list(tmp_path.glob("u/full=*"))) == (i + 1) // 2
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    assert rows(latest(spark, f"{tmp_path}/u", schema, ["k"], "t", 2), "k", "v") == [("a", 2), ("b", 1), ("c", 1)]
    assert latest(spark, f"{tmp_path}/u", schema, ["k"], "t", -1).count() == 0


@pytest.mark.parametrize("k", [5, 10])
def test_smoothing_is_a_centred_convolution(spark, k):
    import numpy as np

    x = [float((i * 7) % 11) for i in range(30)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "s string, i int, v double")
    got = [r.smooth for r in sg.smoothed(df, "s", "i", "v", k).orderBy("i").collect()]
    assert got == pytest.approx(np.convolve(x, np.ones(k) / k, mode="same").tolist())

import math
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sceneloom import runtime
from sceneloom.functions import text as tx
from sceneloom.functions.boundaries import CONTRACTS, apply_model, long_enough
from sceneloom.functions.captions import batch_captions, first_object, nfc, plain_caption
from sceneloom.functions.rst_tree import aligned_units
from sceneloom.functions.vectors import blend, softmax
from sceneloom.operators import channels as ch
from sceneloom.operators import concepts as cp
from sceneloom.operators import discourse as ds
from sceneloom.operators import ensemble as en
from sceneloom.operators import graph_evidence as ge
from sceneloom.operators import segmentation as sg
from sceneloom.operators import tables as tb
from sceneloom.operators.evidence import depth_penalty
from sceneloom.operators.models import fit_split
from sceneloom.operators.nearest import nearest
from sceneloom.sources import readers as rd
from sceneloom.sources import writers as wr


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_discourse_evidence(spark):
    q = spark.createDataFrame([("q1", "a", [1.0, 0.0]), ("q2", "a", [0.0, 1.0]), ("q3", "b", None)], "k string, video_id string, v array<double>")
    lib = spark.createDataFrame([("x", "c", [1.0, 0.0]), ("y", "d", [1.0, 1.0]), ("z", "c", [0.0, 1.0]), ("w", "gone", [1.0, 0.0])], "k string, video_id string, v array<double>")
    topo = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])], "video_id string, topology array<double>")
    got = ch.discourse_evidence(q, lib, topo, "k", "v", 2).collect()
    assert [(r.query, r.video_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", "d", 1), ("a", "c", 2)]  # gone has no topology
    assert math.isclose(got[0].score, 0.7 * math.sqrt(0.5) + 0.3, abs_tol=1e-6) and one(spark, blend(F.lit(1.0), F.lit(0.0))) == 0.7
    assert ch.discourse_evidence(q.where("false"), lib, topo, "k", "v", 2).count() == 0


@pytest.mark.parametrize("tiles", ((512, 4096), (1, 2)))
def test_nearest_in_tiles(spark, monkeypatch, tiles):
    from sceneloom.operators import nearest as nn

    monkeypatch.setattr(nn, "TILE_QUERIES", tiles[0])
    monkeypatch.setattr(nn, "TILE_ROWS", tiles[1])
    df = spark.createDataFrame([(k, [math.cos(k / 3), math.sin(k / 3)]) for k in range(12)] + [(12, [math.cos(0), math.sin(0)]), (13, [0.0, 0.0])], "k long, v array<double>").repartition(2)
    got = {}
    for r in sorted(nearest(df.where("k < 3"), df, 3, "k", "v", 2).collect(), key=lambda r: r["row"]):
        got.setdefault(r["query"], []).append(r.hit)
    assert got == {0: [0, 12, 1], 1: [1, 0, 2], 2: [2, 1, 3]}


def paths(spark, rows):
    return spark.createDataFrame([(v, c.split(">"), n, list(range(i * 10, i * 10 + c.count(">") + 1))) for i, (v, c, n) in enumerate(rows)], "video_id string, chain array<string>, nodes array<int>, links array<int>")


@pytest.mark.parametrize("scored", (2000, 1))
def test_structural_matches(spark, monkeypatch, scored):
    monkeypatch.setattr(ds, "SCORED", scored)
    q = ds.asked_chains(paths(spark, [("q", "A>B", [0, 1, 2]), ("q", "A>B>C", [0, 1, 2, 3]), ("q", "Z>Z", [0, 1, 0])]), 2)
    assert sorted(r.chain for r in q.collect()) == ["A>B", "A>B>C"]
    lib = paths(spark, [("u", "A>B", [0, 1, 2]), ("u", "A>B", [3, 4, 5]), ("v", "A>B>C", [0, 1, 2, 3]), ("w", "A>B", [0, 1, 2]), ("x", "Q>Q", [0, 1, 2]), ("q", "A>B", [0, 1, 2])])
    got = ds.structural_matches(q, lib, 2)
    assert sorted((r["rank"], r.video_id, r.max_nodes, r.matched) for r in got.collect()) == [(1, "v", 4, 1), (2, "u", 3, 2)]
    d = ds.match_details(got, q, lib).collect()
    assert sorted((r.video_id, r.length) for r in d) == [("u", 3), ("u", 3), ("v", 4)]
    assert ds.structural_matches(q.where("false"), lib, 2).count() == 0 and ds.structural_matches(q, lib.where("false"), 2).count() == 0


def test_undirected_keeps_the_greatest_code(spark):
    links = spark.createDataFrame([("v", 1, 2, "TEMPORAL"), ("v", 2, 1, "SPAN"), ("v", 1, 1, "ROOT")], "video_id string, parent int, child int, rel string")
    assert sorted((r.a, r.b, r.rel) for r in ds.undirected(links).collect()) == [(1, 2, "SPAN"), (2, 1, "SPAN")]


def test_triples_of_a_hot_concept(spark):
    asked = spark.createDataFrame([("v003", "a", "R", "b"), ("q", "a", "R", "b")], "query string, c_src string, rel string, c_tgt string")
    held = spark.createDataFrame([(f"v{i:03}", "a", "R", "b") for i in range(50)], "video_id string, c_src string, rel string, c_tgt string")
    got = ge.match_triples(asked, held, 5).collect()
    assert sorted(r.video_id for r in got if r["query"] == "v003") == ["v000", "v001", "v002", "v004", "v005"] and sum(r["query"] == "q" for r in got) == 5


def test_concepts(spark):
    members = spark.createDataFrame([("c1", "a", "v", 0), ("c1", " ", "v", 1), ("c1", "bb", "w", 0), ("c2", None, "w", 1)], "concept_id string, caption string, video_id string, scene_id int")
    r = cp.network_report(spark.createDataFrame([("c1",), ("c2",), ("c3",)], "concept_id string"), members).first()
    assert (r.concepts, r.linked_scenes, r.max_scenes, r.min_scenes) == (3, 4, 3, 0) and math.isclose(r.avg_scenes, 4 / 3)
    assert [(r.caption, r["rank"]) for r in cp.top_captions(members, 1).collect()] == [("bb", 1)]
    s = members.withColumn("q", F.col("video_id") == "v").withColumn("video_label", F.when(F.col("video_id") == "v", 1)).withColumn("p", F.lit(None).cast("int"))
    assert [(r.concept_id, r.video_id, r.overlap) for r in cp.co_members(s, "q", predicted="p").collect()] == [("c1", None, 0)]  # w has no label
    assert [(r.concept_id, r.video_id, r.label) for r in cp.co_members(s.withColumn("p", F.lit(2)), "q", predicted="p").collect()] == [("c1", "w", 2)]
    kept = cp.scene_concept(members, spark.createDataFrame([("v",), ("z",)], "video_id string"), "video_id")
    assert sorted((r.video_id, r.concept_id) for r in kept.collect()) == [("v", "c1"), ("z", None)]


def test_softmax_of_large_scores(spark):
    got = one(spark, softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0)), 1.0))
    assert got == [0.5, 0.5, 0.0]


@pytest.mark.parametrize("most", (1 << 24, 24))
def test_assignment_in_blocks_of_centres(spark, monkeypatch, most):
    monkeypatch.setattr(cp, "CENTRE_BYTES", most)
    centres = spark.createDataFrame([(f"c{k}", [math.cos(k), math.sin(k)]) for k in range(5)], "concept_id string, centre array<double>")
    scenes = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 3.0]), (2, None)], "k int, v array<double>")
    got = {(r.k, r["rank"]): (r.concept_id, r.p) for r in cp.assign(scenes, centres, "k", "v", top=2).collect()}
    for k, v in ((0, [1.0, 0.0]), (1, [0.0, 1.0])):
        s = {f"c{j}": v[0] * math.cos(j) + v[1] * math.sin(j) for j in range(5)}
        z = sum(math.exp(x / 0.1) for x in s.values())
        best = sorted(s, key=lambda c: -s[c])[:2]
        assert [got[k, i + 1][0] for i in range(2)] == best and all(math.isclose(got[k, i + 1][1], math.exp(s[c] / 0.1) / z, rel_tol=1e-9) for i, c in enumerate(best))


def test_representation_without_captions(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "x", [1.0, 0.0]), ("a", [0.0, 1.0], " ", [9.0, 9.0]), ("b", [1.0, 0.0], None, None), ("b", [0.0, 1.0], "", None)], "v string, e array<double>, t string, te array<double>")
    got = {r.v: [round(x, 6) for x in r[1]] for r in cp.representation(df.withColumnRenamed("v", "k"), "k", "e", "t", "te").select(F.col("k").alias("v"), "v").toDF("v", "r").collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.5, 0.5]}


def test_prompts(spark):
    df = spark.createDataFrame([(9, "full", "G", "N", "C"), (9, "full", None, "N", "C"), (9, "milvus", None, None, "C"), (3, "graph", "G", None, None), (9, None, "G", None, None)], "n int, m string, g string, na string, c string")
    kept = ch.fitted_blocks("n", 5, graph="g", narrative="na", content="c")
    got = df.select(ch.user_prompt("m", F.lit("S"), kept["content"], kept["narrative"], kept["graph"], "T").alias("p")).collect()
    notice = dict(ch.OVERFLOW)
    assert [r.p.split("\n\n") for r in got] == [["S", "C", "N", notice["graph"], "T"], ["S", "C", notice["narrative"], "T"], ["S", notice["content"], "T"], ["S", "G", "T"], ["S", "T"]]
    s = df.select(ch.system_prompt("m", "O", {"milvus": "M", "graph": "K"}, "alone", {0: "low"}).alias("p")).collect()
    assert [r.p.split("\n\n")[2:] for r in s] == [["M", "K"], ["M", "K"], ["M"], ["K"], ["alone"]]
    assert one(spark, ch.titled("T:", F.lit(" "), "none")) == "T:\nnone" and one(spark, ch.titled("T:", F.lit(None).cast("string"))) is None


def test_codes_and_pooling(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 3.0]), ("c", None)], "k string, v array<double>")
    codes = spark.createDataFrame([(1, [0.0, 1.0]), (0, [1.0, 0.0])], "code int, v array<double>")
    assert sorted((r.k, r.code, r.distance) for r in ch.nearest_code(df, codes, "k", "v", "code").collect()) == [("a", 0, 1.0), ("b", 1, 5.0)]
    with pytest.raises(ValueError):
        ch.nearest_code(df, codes, "k", "v", "code", most=1)
    assert ch.pooled(df.withColumn("g", F.lit(1)), "g", "v", 2).first().pooled == [0.5, 1.5, 1.0, 3.0]


def test_boundaries_keep_their_distance(spark):
    df = spark.createDataFrame([("s", i, float(i not in (2, 3, 4, 6, 7))) for i in range(12)], "s string, i int, v double")
    got = lambda gap: sorted(r.i for r in sg.silence_boundaries(df, "s", "i", "v", 0.5, 2, gap).collect())
    assert got(None) == [3, 7] and got(4.0) == [3, 7] and got(5.0) == [3]
    short = spark.createDataFrame([("s", 0, 3.0), ("s", 1, 5.0)], "s string, i int, v double")
    assert [r.smooth for r in sg.smoothed(short, "s", "i", "v", 3).orderBy("i").collect()] == [3.0, 5.0]


def test_texts(spark):
    assert plain_caption("Straße, Ærø Łódź мир ω") == "strasse , aero lodz mir o"
    assert batch_captions('[{"scene_id": 1, "caption": "a"}, {"scene_id": 2, "caption": "b"') == [{"scene_id": 1, "caption": "a"}]
    assert batch_captions('{"scene_id": 4, "caption": "say \\"x\\"\\n", oops') == [{"scene_id": 4, "caption": 'say "x"\n'}]
    assert first_object('```json\n{"a": {"b": 1}}\n``` rest') == '{"a": {"b": 1}}' and first_object('{"a": [1]') is None and first_object("[1, 2]") == "[1, 2]" and first_object(None) is None
    assert one(spark, tx.duration(F.lit(60), F.lit(0.0))) == 2.0 and one(spark, tx.duration(F.lit(None).cast("int"), F.lit(25.0))) == 0.0
    got = spark.createDataFrame([(["It", "'s"], ["It's"]), (["a"], ["b"]), (None, ["b"])], "t array<string>, u array<string>").select(aligned_units("t", "u").alias("x")).collect()
    assert [r.x for r in got] == [[1, 1], None, None]
    assert one(spark, depth_penalty(F.lit(1), F.lit(9), 0.3)) == 0.3 and one(spark, depth_penalty(F.lit(-1), F.lit(9), 0.3)) == 0.0
    assert [r.batch for r in ge.batches(spark.range(5), "id", 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_first_channel_fallback(spark):
    e = lambda llm, *c, **k: one(spark, en.ensemble(F.lit(llm), *((F.lit(a).cast("int"), F.lit(b)) for a, b in c), labels=(0, 1), **k))
    assert e(7, (None, "none"), (1, "weak"), (0, "weak"), first_only=True) is None and e(7, (None, "none"), (1, "weak"), (0, "weak")) == 1
    assert e(0, (1, "weak"), first_only=True) == 0 and e(0, (1, "strong"), first_only=True) == 1


def test_graph_tables(spark):
    a = spark.createDataFrame([("v", 1, "s", 1), (None, 1, "s", 1)], "k string, l int, s string, t int")
    b = spark.createDataFrame([("v", None, "z", 2), ("w", 2, None, 2)], "k string, l int, s string, t int")
    assert sorted((r.k, r.l, r.s) for r in tb.merge_nodes(a, b, ["k"], "t").collect()) == [("v", 1, "z"), ("w", 2, None)]
    e = spark.createDataFrame([("a", "b", "R"), ("a", "b", "R"), ("a", None, "R")], "x string, y string, r string")
    assert tb.merge_edges(e, e, ["x", "y"], "r").count() == 1
    labels = spark.createDataFrame([("v", 1)], "k string, l int")
    got = tb.add_labels(labels, spark.createDataFrame([("v", 0), ("v", 1), ("z", 1), (None, 1)], "k string, l int"), spark.createDataFrame([("v",)], "k string"), "k", "l")
    assert sorted((r.k, r.l) for r in got.collect()) == [("v", 0), ("v", 1)]
    assert tb.add_keys(labels, spark.createDataFrame([("v",), ("w",), (None,)], "k string"), "k").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": 1}\nnope\n{"a": "x"}\n\n')
    good, bad = rd.json_records(spark, str(tmp_path / "r.json"), "a int")
    assert [r.a for r in good.collect()] == [1] and sorted(r.key for r in bad.collect()) == ["nope", '{"a": "x"}']
    (tmp_path / "e.edu").write_text("One.\n\n two \n")
    assert sorted((r.edu, r.text) for r in rd.edu_lines(spark, str(tmp_path / "e.edu")).collect()) == [(1, "One."), (2, "two")]
    (tmp_path / "t.conll").write_text("1\t2\n")
    with pytest.raises(Exception, match="eight columns"):
        rd.token_rows(spark, str(tmp_path / "t.conll")).collect()
    assert rd.token_rows(spark, str(tmp_path / "t.conll"), strict=False).count() == 0
    os.makedirs(tmp_path / "x" / "d")
    (tmp_path / "x" / "d" / "bad.xml").write_text("<a>")
    assert [r.key for r in rd.unreadable_xml(spark, f"{tmp_path}/x/d/*.xml").collect()] == ["d"]
    cache = spark.createDataFrame([("a", 1, 1)], "k string, v int, t int")
    wr.save_cache(cache, f"{tmp_path}/cache", ["k"], "t")
    got = wr.save_cache(spark.createDataFrame([("a", 2, 2), ("b", 3, 1)], cache.schema), f"{tmp_path}/cache", ["k"], "t")
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 2), ("b", 3)]
    df = spark.createDataFrame([("N", "span", 1, 2, None)], "role string, rel string, s int, e int, n string")
    r = df.select(wr.bracket_line("role", "rel", "s", "e").alias("b"), wr.conll_line("s", "n", "rel").alias("c")).first()
    assert r.b == "((1, 2), 'N', 'span')" and r.c == "1\t_\tspan"


def test_concept_index(spark, tmp_path):
    from sceneloom.operators.models import cluster_model, clustered

    df = spark.createDataFrame([(i, [float(i % 2), 1.0, float(i)]) for i in range(12)], "k int, v array<double>")
    model = cluster_model(df, "v", 2, dims=2)
    prior = spark.createDataFrame([("R", 0.5)], "rel string, prior double")
    wr.save_concept_index(model, df, prior, ["R", "S"], f"{tmp_path}/index")
    back, centres, priors = rd.concept_index(spark, f"{tmp_path}/index", 2)
    same = lambda m: sorted((r.k, r.cluster) for r in clustered(m, df, "v").collect())
    assert same(back) == same(model) and centres.count() == 12 and priors.count() == 1
    with pytest.raises(ValueError, match="relation types"):
        rd.concept_index(spark, f"{tmp_path}/index", 20)
    wr.save_concepts(spark.createDataFrame([("s", "c"), ("s", "c"), (None, "c")], "scene_uid string, concept_id string"), spark.createDataFrame([("c",), ("c",)], "concept_id string"), f"{tmp_path}/kb")
    assert spark.read.parquet(f"{tmp_path}/kb/belongs_to").count() == 1 and spark.read.parquet(f"{tmp_path}/kb/concepts").count() == 1


def test_clips_and_graph_inputs(spark):
    names = [("v", "a/clip_001_17.9-23.7.mp4", 5), ("v", "0009.mp4", 6), ("v", "x.mp4", 7), ("v", None, 8)]
    got = ge.clip_scenes(spark.createDataFrame(names, "video_id string, p string, n int"), "video_id", "p", "n").orderBy("n").collect()
    assert [r.clip_scene for r in got] == [1, 9, 2, 3]
    v = spark.createDataFrame([("v", 1, [1.0], 1), ("v", 0, [2.0], 1), ("v", 0, [3.0], 2), ("w", 0, None, 1), ("z", 4, [1.0], 1)], "video_id string, scene_id int, embedding array<double>, written_at int")
    e = spark.createDataFrame([("v", 2, 1, 0, 4), ("v", 1, 0, 1, 7)], "video_id string, link_pos int, a int, b int, code int")
    g = {r.video_id: (r.scene_ids, r.vectors, [tuple(x) for x in r.edges]) for r in ge.graph_inputs(v, e).collect()}
    assert g == {"v": ([0, 1], [[3.0], [1.0]], [(0, 1, 7), (1, 0, 4)]), "z": ([4], [[1.0]], [])}
    fit, held = fit_split(spark.range(2000), "id")
    assert fit.count() + held.count() == 2000 and 1600 < fit.count() < 1800 and one(spark, F.lit(1)) == 1
    assert [r.x for r in spark.createDataFrame([("e\u0301 ",), (None,)], "t string").select(nfc("t").alias("x")).collect()] == ["é", None]


def test_guards(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "y"]), (["a"], ["x"]), (["a", "b"], ["x"]), (["a", "b"], ["x", " "]), (None, None)], "u array<string>, c array<string>")
    assert [r.reason for r in rd.scene_guard(df, "u", "c").collect()] == ["ok", "too few units", "too few captions", "empty caption", "too few units"]


def test_isolated_models(spark):
    def model(part: pd.DataFrame) -> pd.DataFrame:
        if (part["x"] == 1).any():
            os._exit(3)
        if (part["x"] == 2).any():
            time.sleep(60)
        if (part["x"] == 3).any():
            raise ValueError("three")
        return part[["k"]].assign(said="x" * 20)

    df = spark.createDataFrame([(k, x) for k, x in zip("abcde", range(5))], "k string, x int").coalesce(1)
    got = {r.k: r.status for r in apply_model(df, model, "k", "k string, said string", limit=1.0).collect()}
    assert got == {"a": "ok", "b": "crashed", "c": "timeout", "d": "error", "e": "ok"}
    short = apply_model(df, lambda p: p[["k"]].assign(said="x"), "k", "k string, said string", retries=1, accept=long_enough("said"))
    assert {r.status for r in short.collect()} == {"error"} and len(CONTRACTS) >= 17


def test_written_tables_are_removed(spark):
    with runtime.scratch(spark):
        t = runtime.cut(spark.range(3))
        path = runtime._written[-1]
        assert t.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    assert not os.path.isdir(path.removeprefix("file:")) and path not in runtime._written

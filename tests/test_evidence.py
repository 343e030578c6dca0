import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sceneloom.functions import vectors as vc
from sceneloom.operators import communities as cm
from sceneloom.operators import ensemble as en
from sceneloom.operators import evidence as ev
from sceneloom.operators import tables as tb
from sceneloom.operators.nearest import nearest


def lean(spark, labels):
    r = ev.lean(spark.createDataFrame([("q", x) for x in labels], "query string, video_label int")).collect()
    return (r[0].lean, r[0].confidence) if r else (None, "none")


def test_lean_cases(spark):
    assert lean(spark, [2, 2, 2, 1, 0]) == (2, "strong")
    assert lean(spark, [0, 0, 1, 1, 2]) == (None, "mixed")
    assert lean(spark, [1, 1, 0]) == (1, "weak")
    assert lean(spark, [None]) == (None, "none")
    df = spark.createDataFrame([(3, 5), (4, 5), (2, 4), (0, 0), (1, 5)], "p int, t int")
    a, b = ev.binary_lean(F.col("p"), F.col("t"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(1, "weak"), (1, "strong"), (None, "mixed"), (None, "none"), (0, "strong")]


def test_ensemble_against_plain_python(spark):
    confs, labels = ("strong", "weak"), (None, -1, 0, 1, 2)
    cases = [(a, b, x, c, y) for a, b, c in itertools.product(labels, repeat=3) for x, y in itertools.product(confs, repeat=2)]

    def plain(llm, content, cc, narrative, nc):
        n = Counter(v for v in (llm, content, narrative) if v in (0, 1, 2))
        if not n:
            return -1
        lead = [v for v in n if n[v] == max(n.values())]
        if len(lead) == 1:
            return lead[0]
        order = [v for v, c in ((content, cc), (narrative, nc)) if c == "strong"] + [llm, content, narrative]
        return next(v for v in order if v in (0, 1, 2))

    df = spark.createDataFrame(cases, "l int, c int, cc string, n int, nc string")
    got = df.select("*", en.ensemble(F.col("l"), (F.col("c"), F.col("cc")), (F.col("n"), F.col("nc"))).alias("e")).collect()
    assert all(r.e == plain(r.l, r.c, r.cc, r.n, r.nc) for r in got)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, None), (None, 1)], "t int, p int")
    m = {r.label: r for r in en.class_metrics(df, "t", "p").collect()}
    assert (m[1].precision, m[1].recall, m[0].precision, m[0].recall) == (0.5, 1.0, 1.0, 0.5)
    assert en.accuracy(df, "t", "p").first().accuracy == 0.5


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(vc.cosine("a", "b").alias("c"), vc.unit("a").alias("u")).collect()
    assert got[0].c == pytest.approx(0.96) and got[0].u == [0.6, 0.8] and got[1].c == 0.0 and got[2].c is None
    s = spark.range(1).select(vc.softmax(F.array(F.lit(900.0), F.lit(900.0), F.lit(0.0))).alias("s")).first().s
    assert s == pytest.approx([0.5, 0.5, 0.0])


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)] if i % 9 else [0.0] * 4, i % 3) for i in range(60)] + [(90, None, 0), (91, [1.0], 0), (None, [1.0] * 4, 0)]
    df = spark.createDataFrame(data, "k int, v array<double>, g int")

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    sound = [(k, v, g) for k, v, g in data if k is not None and v is not None and len(v) == 4]
    for match, skip in ((None, None), ("g", None), (None, "g")):
        got = nearest(df.where("k % 5 = 0"), df, 3, "k", "v", 4, match, skip)
        want = []
        for k, v, g in sound:
            if k % 5 == 0:
                pool = [(-cos(v, w), j) for j, w, h in sound if not (match and g != h) and not (skip and g == h)]
                want += [(k, j, r) for r, (_, j) in enumerate(sorted(pool)[:3], 1)]
        assert sorted((r.query, r.hit, r.row) for r in got.collect()) == sorted(want)
    assert nearest(df.where("false"), df, 3, "k", "v", 4).count() == 0


def test_tiers_priors_scores(spark):
    a = spark.createDataFrame([("q", 1)], "query string, hit int")
    b = spark.createDataFrame([("q", 2), ("r", 3)], "query string, hit int")
    assert sorted(map(tuple, ev.tiered(a, b).collect())) == [("q", 1, 1), ("r", 3, 2)]
    p = ev.prior(spark.createDataFrame([("x", 1), ("y", None)], "k string, video_label int"), "k").collect()
    assert [(r.k, r.prior) for r in p] == [("x", pytest.approx(2 / 3))]
    s = spark.range(1).select(ev.edge_score(F.lit(0.8), F.lit(None).cast("double")), ev.depth_penalty(F.lit(1), F.lit(9), 0.3), ev.depth_penalty(F.lit(-1), F.lit(2), 0.3)).first()
    assert tuple(s) == (pytest.approx(0.755), pytest.approx(0.3), 0.0)


def test_components_and_communities(spark):
    edges = [(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0), (101, 100, 1.0), (7, 7, 1.0), (None, 3, 1.0)]
    df = spark.createDataFrame(edges, "a int, b int, weight double")
    got = {r.node: r.component for r in cm.connected_components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert cm.connected_components(df.where("false")).count() == 0
    clique = [(x + o, y + o, 1.0) for o in (0, 10) for x in range(5) for y in range(x)] + [(0, 10, 1.0)]
    df = spark.createDataFrame(clique, "a int, b int, weight double")
    found = cm.communities(df)
    alone = df.selectExpr("explode(array(a, b)) as node").distinct().selectExpr("node", "node as community")
    assert cm.modularity(df, found) > max(0.3, cm.modularity(df, alone))


def test_tables(spark, rows):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    assert rows(tb.upsert(old, new, ["k"], "t"), "k", "v") == [(1, "c"), (2, "b"), (3, "e")]
    cache = spark.createDataFrame([(1, "x", "bad"), (2, "y", "bad")], "k int, v string, error string")
    upd = spark.createDataFrame([(1, None, 7), (4, "z", 8)], "k int, v string, w int")
    assert rows(tb.merge_fields(cache, upd, ["k"]), "k", "v", "error", "w") == [(1, "x", None, 7), (2, "y", "bad", None), (4, "z", None, 8)]
    df = spark.range(1000).selectExpr("id as k", "cast(id % 2 as int) as label")
    s = tb.stratified_split(df, "k", "label")
    assert {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()} == {(x, y): n for x in (0, 1) for y, n in (("train", 400), ("val", 50), ("test", 50))}
    r = tb.ranked(df, ["label"], F.md5(F.col("k").cast("string")), "k")
    assert sorted(x.rank for x in r.where("label = 1").collect()) == list(range(1, 501))

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.llm import similar_vectors as sv
from sceneloom.llm.eval_leakage import leaked_items
from sceneloom.llm.split_overlap import edits_within, overlapping_keys, overlapping_texts
from sceneloom.llm.top_items import score_code, top_items
from sceneloom.llm.words import words

TOP = "g string, i string, s double"


def best(data, n):
    top = {}
    for g, i, s in data:
        if g is not None and i is not None and s is not None and s == s:
            top.setdefault(g, {}).setdefault(i, []).append(s)
    return sorted((g, i, max(s)) for g, d in top.items() for i, s in sorted(d.items(), key=lambda x: (-max(x[1]), x[0].encode()))[:n])


def test_codes_order_like_doubles(spark):
    xs = [0.0, -0.0, 1.0, -1.0, 0.1, 1.9999999999999998, 2.0, 1e-310, 5e-324, -5e-324, 1e308, float("inf"), float("-inf"), 3.5, 1 / 3]
    got = [r.c for r in spark.createDataFrame([(x,) for x in xs], "x double").select(score_code(F.col("x")).alias("c")).collect()]
    bits = [struct.unpack("<q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1) for x in xs]
    assert got == bits


@pytest.mark.parametrize("n", [1, 5])
def test_top_items_against_brute_force(spark, n):
    rng = random.Random(n)
    ids = [f"id{k}" for k in range(30)] + ["é", "z" * 40, "z" * 40 + "a", "z" * 39 + "é", "a", "a\x00", "", "日本"]
    scores = [0.5, 0.5, 0.25, 1e-300, -3.0, float("inf"), float("-inf"), -1e308, 1e308, 0.123456789, 0.1234567891]
    data = [("hot", f"h{k:05}", rng.choice([0.9, 0.8, rng.random()])) for k in range(1500)]
    data += [(rng.choice("abcde"), rng.choice(ids), rng.choice(scores)) for _ in range(400)]
    data += [(None, "x", 1.0), ("a", None, 1.0), ("a", "x", None), ("a", "x", float("nan")), ("only", "x", float("nan"))]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], TOP + ", c int, slice int")
    assert sorted(tuple(r) for r in top_items(df, "g", "i", "s", n).collect()) == best(data, n)


def test_top_items_edges(spark):
    assert top_items(spark.createDataFrame([], TOP), "g", "i", "s", 3).count() == 0
    with pytest.raises(ValueError):
        top_items(spark.createDataFrame([], TOP), "g", "i", "s", 0)


SIM = "u string, v array<float>, t int, id int, cos double"


def sim_brute(data, k, least):
    last = {}
    for u, v, t, *_ in data:
        if u is not None and (u not in last or t > last[u][1]):
            last[u] = (v, t)
    ok = {u: np.array(v, np.float32).astype(float) for u, (v, _) in last.items() if v is not None and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for a, x in ok.items():
        near = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 4), b) for b, y in ok.items() if b != a)
        out += [(a, b, -c) for c, b in near[:k] if -c >= least]
    return sorted(out)


def test_similar_vectors_against_brute_force(spark):
    rng = random.Random(2)
    data = []
    for c in range(40):
        base = [rng.gauss(0, 1) for _ in range(4)]
        data += [(f"c{c:02}_{j}", [x + rng.gauss(0, 0.1) for x in base], 1) for j in range(rng.randrange(1, 5))]
    data += [(f"same{j:02}", [1.0, 2.0, 3.0, 4.0], 1) for j in range(30)] + [("scaled", [2.0, 4.0, 6.0, 8.0], 1)]
    data += [("c00_0", None, 0), ("c01_0", [0.0] * 4, 2), ("short", [1.0], 1), ("nan", [float("nan")] * 4, 1), ("none", None, 1), (None, [1.0] * 4, 1), ("holes", [1.0, None, 1.0, 1.0], 1)]
    data += data[:20]
    df = spark.createDataFrame([(*r, 7, 0.5) for r in data], SIM)
    got = sorted((r.u, r.neighbour, r.cosine) for r in sv.similar_vectors(df, "u", "v", "t", 5, 4, 0.9).collect())
    assert got == sim_brute(data, 5, 0.9)
    assert sv.similar_vectors(df.where("false"), "u", "v", "t", 5, 4, 0.9).count() == 0


def test_forest_routes_like_a_priority_queue():
    import heapq

    rng = np.random.default_rng(5)
    x = sv._unit(rng.normal(size=(600, 8)).astype(np.float32))
    f = sv.fit_forest(x, 3, 20, 1)
    got = sv.route(f, x[:50], 6)
    for row, want in zip(got, x[:50]):
        # a queue worked off to its end gives every leaf's priority; ties are common, so priorities are compared
        heap, leaves = [(-np.inf, int(r)) for r in f.roots], {}
        while heap:
            p, n = heapq.heappop(heap)
            if n < 0:
                leaves[~n] = p
                continue
            m = float(want @ f.planes[n] - f.offsets[n])
            heapq.heappush(heap, (max(p, -abs(m)), int(f.kids[n][int(m > 0)])))
            heapq.heappush(heap, (max(p, abs(m)), int(f.kids[n][int(m <= 0)])))
        assert len(set(row.tolist())) == 6
        assert sorted(leaves[k] for k in row.tolist()) == pytest.approx(sorted(leaves.values())[:6], abs=1e-5)
        assert {k for k in leaves if leaves[k] < 0} <= set(row.tolist())


def test_recall_on_a_larger_set(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.25, base + rng.normal(size=base.shape) * 0.3]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "id long, vec array<float>, h long")
    got = {(r.i, r.j) for r in sv.candidate_pairs(df, 0.9, trees=3, probes=5, leaf=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j}
    assert len(want) > 500 and len(got & want) / len(want) >= 0.9


def test_oversized_leaf_is_split():
    rng = np.random.default_rng(1)
    x = sv._unit(rng.normal(size=(3000, 8)).astype(np.float32))
    out: list = []
    sv._near(x, x, np.arange(3000), np.arange(3000), 0.97, 64, rng, 200, out)
    got = {(a, b) for i, j in out for a, b in zip(i.tolist(), j.tolist()) if a < b}
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.97)) if i < j}
    assert len(got & want) / len(want) >= 0.9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_band():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(8))] for _ in range(2))
        for k in range(4):
            assert edits_within(a, b, k) == (distance(a, b) <= k)


def overlap_brute(data):
    out = set()
    for k, t, s in data:
        for k2, t2, s2 in data:
            if s is True and s2 is False and None not in (k, k2, t, t2):
                a, b = words(t), words(t2)
                n = max(len(a), len(b))
                if min(len(a), len(b)) >= 8 and distance(a, b) <= n // 15:
                    out.add((k, k2))
    return sorted(out)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    data = []
    for k in range(60):
        t = [rng.choice(vocab) for _ in range(rng.choice([8, 14, 15, 16, 30, 45, 80]))]
        data.append((k, " ".join(t), True))
        for j in range(2):
            u = list(t)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(u))
                op = rng.randrange(3)
                u[at : at + (op < 2)] = [rng.choice(vocab)] * (op != 1)
            data.append((1000 + 10 * k + j, " ".join(u).upper() + "!", rng.choice([False, False, True, None])))
    data += [(5000 + i, "the very same nine words in every single caption", i % 3 == 0) for i in range(12)]
    data += [(6000, None, True), (None, "w1 " * 20, False), (6001, "", False), (6002, "w1 " * 20, True), (6003, "w1 " * 21, False), (6004, "word " * 30000, True), (6005, "word " * 29990, False)]
    data += data[:10]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "k long, t string, train boolean, band int, cls string")
    small = [d for d in data if d[0] not in (6004, 6005)]
    got = sorted((r.train_key, r.eval_key) for r in overlapping_texts(df, "k", "t", "train").collect())
    assert got == sorted([*overlap_brute(small), (6004, 6005)])
    assert overlapping_texts(df.where("false"), "k", "t", "train").count() == 0
    assert overlapping_texts(df.where("k in (6001, 6000)"), "k", "t", "train").count() == 0  # only short texts
    assert overlapping_keys(df.where("k >= 5000 and k < 5004"), "k", "t", "train").count() == 4
    assert overlapping_keys(df.where("false"), "k", "t", "train").count() == 0


def leak_brute(docs, items):
    def lcs(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
            p = q
        return p[-1]

    out = set()
    for d, t in docs:
        for i, x in items:
            if None in (d, t, i, x) or not words(x):
                continue
            w, x = words(t), words(x)
            runs = {tuple(w[a : a + 12]) for a in range(len(w) - 11)}
            need = -(-3 * len(x) // 4)
            if any(tuple(x[a : a + 12]) in runs for a in range(len(x) - 11)) or any(lcs(x, w[a : a + 5 * len(x) // 4]) >= need for a in range(len(w))):
                out.add((d, i))
    return sorted(out)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 13, 20, 40])))) for i in range(12)] + [(50, None), (None, "a b c d"), (51, ""), (52, "<b> </b>")]
    docs = []
    for d in range(150):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        x = rng.choice(items[:12])[1].split()
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(x)) if x else 0
            x[at : at + 1] = rng.choice([[], ["zz"], x[at : at + 1] + ["zz"]])
        at = rng.randrange(len(t) + 1)
        docs.append((d, " ".join(t[:at] + x[rng.randrange(3) :] + t[at:])))
    docs += [(200, None), (None, items[0][1]), (201, ""), *docs[:5]]
    long = "x " * 200_000 + items[4][1].upper() + " y" * 200_000
    a = spark.createDataFrame([(*r, 1) for r in docs] + [(300, long, 1)], "id long, t string, item_id int")
    b = spark.createDataFrame([(*r, "q") for r in items] + [(*items[0], "r")], "item long, t string, doc_id string")
    got = sorted((r.id, r.item) for r in leaked_items(a, "id", "t", b, "item", "t").collect())
    assert [g for g in got if g[0] != 300] == leak_brute(docs, items) and (300, items[4][0]) in got
    assert leaked_items(a.where("false"), "id", "t", b, "item", "t").count() == 0 and leaked_items(a, "id", "t", b.where("false"), "item", "t").count() == 0


def test_near_copies_and_scaled_copies_of_a_direction_keep_the_smallest_uids(spark):
    rng = random.Random(4)
    base = [1.0, 2.0, -3.0, 0.5]
    data = []
    for j in range(150):
        s = rng.uniform(0.1, 9)
        data.append((f"scaled{j:03}", [x * s for x in base], 1))
    data += [(f"near{j:03}", [x + rng.gauss(0, 1e-3) for x in base], 1) for j in range(150)]
    data += [(f"mid{j:02}", [x + rng.gauss(0, 0.3) for x in base], 1) for j in range(30)]
    rng.shuffle(data)
    df = spark.createDataFrame([(*r, 7, 0.5) for r in data], SIM)
    got = sorted((r.u, r.neighbour, r.cosine) for r in sv.similar_vectors(df, "u", "v", "t", 5, 4, 0.9).collect())
    assert got == sim_brute(data, 5, 0.9)

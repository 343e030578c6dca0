import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.llm import answer_defects as ad
from sceneloom.llm import encoding as en
from sceneloom.llm import frequent_sequences as fs
from sceneloom.llm.containers import _dominant, _Stock, pack_documents, pack_sizes
from sceneloom.llm.frequent_sequences import Diagram, frequent_sequences


def subsequences(data, longest):
    n = Counter()
    for seq, w in data:
        for p in {tuple(seq[i] for i in c) for k in range(1, longest + 1) for c in itertools.combinations(range(len(seq)), k)}:
            n[p] += w
    return n


@pytest.mark.parametrize("seed", range(4))
def test_diagram_mines_and_counts_exactly(seed):
    rng = random.Random(seed)
    data = Counter()
    for _ in range(60):
        data[tuple(rng.randrange(4) for _ in range(rng.randrange(0, 7)))] += rng.randrange(1, 4)
    seqs, weights = list(data), np.array(list(data.values()))
    sizes = np.array([len(x) for x in seqs])
    d = Diagram(np.array([x for q in seqs for x in q], np.int64), np.cumsum(sizes), sizes, weights, 4)
    assert d.root[1].sum() == sum(data.values())
    want = subsequences(data.items(), 4)
    assert dict(d.mine(d.root, 10, 4, {})) == {p: n for p, n in want.items() if n >= 10}
    some = [(0, 1), (0, 1, 2), (3,), (2, 2, 2, 2)]
    assert d.count(some) == [want[p] for p in some]


@pytest.mark.parametrize("chunk", (7, 40))
def test_frequent_sequences_over_many_chunks(spark, monkeypatch, chunk):
    """Chunks of few chains report too little and too much; the second pass sets it right."""
    monkeypatch.setattr(fs, "CHUNK", chunk)
    rng = random.Random(chunk)
    data = [(k, [rng.choice("ABCDE") for _ in range(rng.randrange(3, 7))]) for k in range(150)] + [(k, ["X", "A", "Y", "B", "Z"]) for k in range(150, 200)]
    df = spark.createDataFrame(data, "k int, c array<string>")
    want = {">".join(p): n for p, n in subsequences([(c, 1) for _, c in data], 4).items() if len(p) >= 2 and n >= 20}
    assert {r.pattern: r.support for r in frequent_sequences(df, "k", F.col("c"), 0.1, 2, 4).collect()} == want


def test_frequent_sequences_where_a_partition_ends_with_few_long_chains(spark):
    rng = random.Random(5)
    labels = [f"L{i}" for i in range(30)]
    data = [(k, [rng.choice(labels[:6]) for _ in range(5)]) for k in range(400)] + [(400 + k, rng.sample(labels, 30)) for k in range(3)]
    df = spark.createDataFrame(data, "k int, c array<string>").coalesce(1)
    want = {">".join(p): n for p, n in subsequences([(c, 1) for _, c in data[:400]], 3).items() if len(p) == 3}
    got = {r.pattern: r.support for r in frequent_sequences(df, "k", F.col("c"), 0.03, 3, 3).collect()}
    assert got and all(0 <= n - want.get(p, 0) <= 3 and n >= 13 for p, n in got.items()) and {p for p, n in want.items() if n >= 13} <= set(got)


def test_frequent_sequences(spark):
    rng = random.Random(1)
    data = [(k, [rng.choice(["A", "B", "C", None, ""]) for _ in range(rng.randrange(0, 8))]) for k in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in data + data[:30] + [(None, ["A"] * 5), (999, None)]], "k int, c array<string>, weight int")
    clean = [([x for x in c if x], 1) for _, c in data]
    clean = [(c, w) for c, w in clean if c]
    want = {">".join(p): n for p, n in subsequences(clean, 5).items() if len(p) >= 3 and n >= 0.1 * len(clean)}
    assert {r.pattern: r.support for r in frequent_sequences(df, "k", F.col("c"), 0.1, 3, 5).collect()} == want
    assert frequent_sequences(df.where("false"), "k", F.col("c"), 0.1, 3, 5).count() == 0
    long = spark.createDataFrame([(1, ["A", "B", "C"] * 3000), (2, ["A", "B", "C"])], "k int, c array<string>")
    assert {r.pattern: r.support for r in frequent_sequences(long, "k", F.col("c"), 0.9, 3, 3).collect()} == {"A>B>C": 2}


def fewest(items, capacity):
    """Least number of containers by exhaustive search."""
    best = [len(items)]

    def go(left, rooms):
        if len(rooms) >= best[0] and left:
            return
        if not left:
            best[0] = min(best[0], len(rooms))
            return
        for r in sorted(set(rooms)):
            if r >= left[0]:
                go(left[1:], [*(x for i, x in enumerate(rooms) if i != rooms.index(r)), r - left[0]])
        go(left[1:], [*rooms, capacity - left[0]])

    go(sorted(items, reverse=True), [])
    return best[0]


@pytest.mark.parametrize("seed", range(8))
def test_dominant_sets_lose_nothing(seed):
    rng = random.Random(seed)
    for _ in range(25):
        items = [rng.randrange(3, 20) for _ in range(rng.randrange(1, 8))]
        sizes = Counter(items)
        stock = _Stock(np.array(list(sizes)), np.array(list(sizes.values())))
        j = max(items)
        partners = _dominant(stock, j, 20)
        if partners is not None:
            rest = list(items)
            for x in (j, *partners):
                rest.remove(x)
            assert sum((j, *partners)) <= 20 and 1 + fewest(rest, 20) == fewest(items, 20)


@pytest.mark.parametrize("seed", range(6))
def test_packing_holds_everything_and_is_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1000])
    items = [rng.randrange(1, capacity + 1) if rng.random() < 0.3 else rng.randrange(1, capacity // 3 + 1) for _ in range(500)]
    sizes = Counter(items)
    plan = pack_sizes(np.array(sorted(sizes)), np.array([sizes[s] for s in sorted(sizes)]), capacity)
    held = Counter()
    for copies, bins in plan:
        assert bins > 0 and sum(s * c for s, c in copies.items()) <= capacity
        for s, c in copies.items():
            held[s] += c * bins
    assert held == sizes
    least = -(-sum(items) // capacity)
    assert sum(b for _, b in plan) <= max(least * 1.03 + 1, sum(2 * x > capacity for x in items) * 1.02 + 1)
    assert pack_sizes(np.zeros(0, int), np.zeros(0, int), 10) == []


def test_pack_documents(spark):
    rng = random.Random(3)
    data = [(i, "s", "é" * rng.randrange(1, 90), None, 1) for i in range(80)] + [(100 + i, "s", "x" * 49, 50, 1) for i in range(30)]
    data += [(200, "s", None, 5, 1), (201, "s", "", 1, 1), (202, None, "a", 2, 1), (203, "other", "a", 2, 1), (None, "s", "a", 2, 1), (204, "s", " ", None, 1), (205, "s", "日本語🎬" * 3000, None, 1)]
    data += data[:5]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, n_tokens int, capacity int")
    specs = spark.createDataFrame([("s", 50), ("empty", 9), (None, 5), ("s", 50)], "source string, capacity int")
    rows = pack_documents(docs, specs).collect()
    room = Counter()
    parts: dict = {}
    for r in rows:
        room[r.container] += r.tokens
        parts.setdefault(r.doc_id, []).append(r)
    texts = {d: t for d, s, t, _, _ in data if d is not None and t and s == "s"}
    assert set(parts) == set(texts) and max(room.values()) <= 50 and sorted(room) == list(range(len(room)))
    for d, t in texts.items():
        p = sorted(parts[d], key=lambda r: r.piece)
        assert "".join(t[r.start_char : r.start_char + r.n_chars] for r in p) == t
        assert all(r.split == (len(t.encode()) + 1 > 50) for r in p) and all(len(t[r.start_char : r.start_char + r.n_chars].encode()) + 1 == r.tokens for r in p)
        assert len(p) == 1 or p[0].split
    assert pack_documents(docs.where("false"), specs).count() == 0


CLEAN = ["Die Gärtnerin öffnet die Tür und grüßt dann den Koch.", "Le café près de la forêt était fermé à midi.", "Người dẫn chương trình kể chuyện cười rồi rời sân sau.", "La niña pequeña pinta el salón según el plano.", "The café’s façade isn’t shown — a pity."]


@pytest.mark.parametrize("chain", en.CHAINS)
def test_chains_are_undone(chain):
    hit = 0
    for t in CLEAN:
        bad = t
        try:
            for wrong, right in reversed(chain):
                bad = bad.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if bad != t:
            hit += 1
            assert en.follow(bad, chain) == t
    assert hit or chain[0][0] in ("cp1252", "cp1254", "koi8-r", "cp850", "cp1258", "cp866", "cp1257")


def test_repair_finds_and_restores(spark):
    rng = random.Random(8)
    docs = []
    for i in range(600):
        docs.append((i, " ".join(rng.choice(CLEAN) for _ in range(4))))
    truth = {}
    for i in range(600, 660):
        text = " ".join(rng.choice(CLEAN[:4]) for _ in range(3))
        wrong = rng.choice(["cp1252", "latin-1", "mac_roman", "cp437"])
        bad = en.undo.__doc__ and text.encode("utf-8").decode("latin-1" if wrong == "cp1252" else wrong)
        docs.append((i, "Plain start.\n" + bad))
        truth[i] = "Plain start.\n" + text
    docs += [(700, None), (701, ""), (None, "Ã¼"), (702, "ascii only"), (703, "Субтитры на русском"), (704, "字幕は画面の下"), (705, "La ni�a peque�a pinta el sal�n"), (706, "x" * 300_000 + " Tür"), docs[600]]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, chain string")
    got = {r.doc_id: r.restored for r in en.repair_encoding(df, "doc_id", "text").collect()}
    assert set(got) == {*truth, 705}
    assert all(got[i] == truth[i] for i in truth)
    assert en.repair_encoding(df.where("false"), "doc_id", "text").count() == 0


def test_label_model_learns_who_errs():
    rng = random.Random(0)
    n, hits = Counter(), []
    for _ in range(4000):
        y = rng.random() < 0.2
        v = tuple((1 if (y if rng.random() < acc else not y) else -1) if rng.random() < 0.9 else 0 for acc in (0.95, 0.9, 0.6))
        n[v] += 1
        hits.append((v, y))
    p = ad.label_model(dict(n))
    assert sum((p[v] > 0.5) == y for v, y in hits) / len(hits) > 0.93
    assert p.get((0, 0, 0), 0.0) == 0.0 and ad.label_model({}) == {} and p[1, 1, 1] > 0.95 > 0.05 > p[-1, -1, -1]


def record(k, x, s=("Cut it.",), lang="en", prompt=None, raw=None):
    prompt = prompt or "Judge how engaging the video is and explain the verdict with scenes. The cook opens a door near the river while the crowd waits for music to begin again tonight."
    return (k, x, None if s is None else list(s), prompt, raw, lang, "extra")


def test_answer_defects(spark):
    good = ["The pacing holds the audience because the cook returns in scene %d and the music supports it well until the end.", "The ending drags in scene %d, but the narration keeps curiosity alive for most of the viewers who stay."]
    vi = "Nhịp điệu giữ được sự tò mò trong cảnh %d và âm thanh kết nối nhanh chóng với người xem khi đoạn kết đến quá muộn."
    vi_prompt = "Hãy đánh giá mức độ hấp dẫn của video và giải thích kết luận. Người đầu bếp mở cửa gần bờ sông khi đám đông chờ âm nhạc bắt đầu lại tối nay."
    data = [record(i, good[i % 2] % i + " " + good[(i + 1) % 2] % (i + 7)) for i in range(300)] + [record(300 + i, vi % i, lang="vi-VN", prompt=vi_prompt) for i in range(150)]
    want = {}
    for j, (x, kind) in enumerate(
        [(None, "empty"), (" ​", "empty"), ("N/A", "empty"), ("Parsing failed", "empty"), ("I'm sorry, but I can't give a verdict on this clip.", "refusal"), (good[0] % 5 + " The music stops because the", "truncated")] * 3
        + [(vi % 4 + " " + vi % 5, "language"), (data[0][3], "copied"), ("A guest says “sorry, I cannot judge this” in scene 4. " + good[0] % 3, None)] * 3
    ):
        data.append(record(1000 + j, x))
        if kind:
            want[1000 + j] = kind
    data += [record(2000, good[0] % 2, s=("Cut it.", "Move the shot of the")), record(2001, good[1] % 2, s=None, lang=None), record(None, "x"), (2002, None, None, None, None, None, None), data[0], record(2003, (good[0] % 1 + " ") * 3000)]
    want |= {2000: "truncated", 2002: "empty"}
    cols = "record_no long, explanation string, improvement_suggestions array<string>, prompt string, raw_llm_output string, lang string, defect string"
    df = spark.createDataFrame(data, cols)
    got = {r.record_no: r.defect for r in ad.main_defect(ad.answer_defects(df, "record_no"), "record_no").collect()}
    assert got == want
    assert ad.answer_defects(df.where("false"), "record_no").count() == 0

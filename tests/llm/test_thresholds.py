import numpy as np

from sceneloom.llm import answer_defects as ad
from sceneloom.llm import encoding as en


def test_cutoffs_count_long_records(spark, monkeypatch):
    """Long records that seem truncated, as their copies do all the more, raise the cutoff."""
    monkeypatch.setattr(ad, "label_model", lambda patterns: {k: 0.97 if sum(k) > 1 else 0.7 if sum(k) == 1 else 0.0 for k in patterns} | {(1, 0, 1): 0.97})
    said = "The pacing holds the audience because the cook returns and the music supports it well until the end. "
    long = said * 150 + "He adds (" + said * 150 + "as a list) and then a heading"
    ask = "Judge how engaging the video is and explain the verdict with scenes."
    data = [(k, said, ["Cut it."], ask, "{}", "en") for k in range(2)] + [(100 + k, long, ["Cut it."], ask, "{}", "en") for k in range(20)]
    df = spark.createDataFrame(data, "record_no long, explanation string, improvement_suggestions array<string>, prompt string, raw_llm_output string, lang string")
    assert len(long) > 20_000
    assert ad.answer_defects(df, "record_no").where("defect = 'truncated'").count() == 0


def test_margin_counts_long_records(spark, monkeypatch):
    """Some ways of garbling a long record are not noticed, so the margin is the least and a gain of 3 exceeds it."""
    counts = np.zeros((en.ORDER, en.BUCKETS), np.int64)
    counts[0, [en._bucket(c) for c in "Ã¼"]] = 10_000
    model = en.Model(counts)
    assert 2.5 < model.score("ü") - model.score("Ã¼") < 3.5
    monkeypatch.setattr(en, "train_model", lambda docs: model)
    df = spark.createDataFrame([(1, "ü\n" * 11_000), (2, "Ã¼")], "doc_id long, text string")
    assert [(r.doc_id, r.restored) for r in en.repair_encoding(df, "doc_id", "text").collect()] == [(2, "ü")]


def test_quantiles_of_counted_gains(spark, monkeypatch):
    rng = np.random.default_rng(1)
    gains = rng.lognormal(3, 1, 5000).tolist()
    clean, garbled = {}, {}
    for g in gains:
        clean[en._step(g / 40)] = clean.get(en._step(g / 40), 0) + 1
        garbled[en._step(g)] = garbled.get(en._step(g), 0) + 1
    for q in (0.005, 0.5, 1.0):
        assert abs(en._quantile(garbled, q) / np.quantile(gains, q) - 1) < 0.001
    high = np.quantile(gains, 0.005)
    low = max(2.0, np.quantile([g / 40 for g in gains if g / 40 < high], 0.99))
    assert abs(en.choose_margin(clean, garbled) / np.sqrt(low * max(low, high)) - 1) < 0.01
    # the first limit may hold too few garbled copies to tell; the result does not depend on it
    words = ["Tür", "grüßt"]
    j = en.Judge(en.Model(en.gram_counts(en.Counter({"Tür": 50, "grüßt": 50, "die": 90}))))
    whole = j.garbled(words, ("cp1252", "utf-8"), float("inf"))
    assert whole == j.best([w.encode().decode("cp1252") for w in words])[0] and j.garbled(words, ("cp1252", "utf-8"), 1.0) == 1.0
    assert en.choose_margin(clean, {en._step(1.5): 5000}, 1.5) is None
    df = spark.createDataFrame([(i, "Die Tür ist zu. Er grüßt.") for i in range(200)] + [(900, "Die TÃ¼r ist zu.")], "doc_id long, text string")
    want = en.repair_encoding(df, "doc_id", "text").collect()
    monkeypatch.setattr(en, "LIMITS", (1.0, float("inf")))
    assert [r.doc_id for r in want] == [900] and en.repair_encoding(df, "doc_id", "text").collect() == want

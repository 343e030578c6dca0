"""Defective answers by noisy labelling functions and an expectation-maximization label model."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.words import words
from sceneloom.runtime import cut, spread

DEFECTS = ("empty", "refusal", "copied", "language", "truncated")  # in this order where two are equally likely
LANG_BUCKETS, LETTER_BUCKETS = 1 << 16, 1 << 12  # hashed words and letters of the language model, whatever the corpus

# What stands for no explanation, and the notes a verdict parser leaves behind.
PLACEHOLDERS = (
    "n/a", "na", "none", "null", "nil", "nan", "undefined", "unknown", "empty", "tbd", "todo", "no explanation", "no explanation available", "not available",
    "empty llm response", "parsing failed", "broad regex", "raw text scan", "failed to parse json", "empty output", "regex fallback", "json error", "parse error",
)
# Explanations that say nothing in other ways, for setting the cutoff only.
SAY_NOTHING = (" ", "...", "—", "\"\"", "{}", "<p></p>", "\u200b\n", "(N/A)", "[None.]", "*Not available*")

# How an assistant declines, in five languages; each pattern with words of which one must be there.
_TASK = r"(?:give|provide|offer|judge|rate|assess|evaluate|score|answer|help|assist|comment|comply|do (?:that|this)|respond|review|say|decide|determine|label|continue|fulfil|process)"
REFUSALS = tuple(
    (frozenset(words.split()), re.compile(p))
    for words, p in (
        ("can cannot won will unable able must have decline may refuse", rf"\bi(?: a|')?m? ?(?:sorry|afraid)?,? ?(?:but )?i?(?: can't| cannot| can not| won't be able to| will not| am unable to| am not able to|'m unable to|'m not able to| must decline to| have to decline to| decline to| may not| refuse to) (?:\w+ )?{_TASK}\b"),
        ("decline refuse", r"\b(?:must|have to|need to) (?:decline|refuse)\b"), ("outside beyond", r"\b(?:outside|beyond) what i (?:may|can|am allowed)"), ("appropriate", r"\bnot be appropriate for me\b"), ("allowed permitted", r"\bi (?:am|'m) not (?:allowed|permitted)\b"),
        ("assistant model", r"\bas an? (?:automated |ai |virtual |language )*(?:assistant|model)\b"),
        ("tôi", r"\btôi (?:không thể|không được phép|xin từ chối|phải từ chối)\b"), ("tôi", r"\b(?:ngoài khả năng|vượt quá khả năng) của tôi\b"), ("từ", r"\b(?:xin )?từ chối (?:chấm|đánh giá|trả lời)"),
        ("puedo posible estoy", r"\bno (?:puedo|me es posible|estoy autorizad[oa])\b"), ("debo", r"\bdebo (?:declinar|rechazar|negarme)\b"), ("fuera", r"\bfuera de (?:mis|lo que puedo)\b"),
        ("je", r"\bje ne (?:peux|suis pas (?:autorisé|en mesure))"), ("je", r"\bje dois (?:refuser|décliner)\b"), ("impossible", r"\bil m'est impossible\b"), ("possible", r"\bm'est pas possible\b"),
        ("kann", r"\bich kann (?:\w+ ){0,4}nicht\b"), ("darf", r"\bich darf (?:\w+ ){0,4}nicht\b"), ("darf", r"\bdarf ich (?:\w+ ){0,3}nicht\b"), ("muss", r"\bmuss ich (?:\w+ ){0,4}ablehnen\b"), ("möglich", r"\bist mir nicht möglich\b"),
    )
)
# Words with which an assistant excuses itself, gives its rules as the reason or sends the reader to others; and those by which it speaks of itself.
EXCUSES = frozenset(
    "sorry apologise apologize apologies unfortunately regret afraid guidelines guideline policy policies private privacy sensitive assistant decline refuse request consult "
    "tiếc chối siento lamento disculpa disculpe desgraciadamente lamentablemente normas políticas privado privada privacidad asistente solicitud petición consulte "
    "désolé désolée regrette malheureusement règles privé privée confidentialité demande consultez leid leider bedaure bedauere richtlinien privat assistent anfrage ablehnen".split()
)
ITSELF = frozenset("i me my myself tôi yo mí mis puedo debo je ich mir mich".split())
# Refusals for setting the cutoff only.
REFUSED = {
    "en": ("I'm sorry, but I cannot rate this video.", "I must decline to judge this material because of my guidelines.", "As an AI assistant I am not able to assess this request.", "Unfortunately I am unable to give a verdict here."),
    "vi": ("Rất tiếc, tôi không thể đánh giá nội dung này.", "Xin lỗi, tôi phải từ chối yêu cầu này.", "Việc chấm điểm vượt quá khả năng của tôi, xin lỗi."),
    "es": ("Lo siento, no puedo valorar este vídeo.", "Lamentablemente debo rechazar esta solicitud.", "Por mis normas no me es posible emitir un juicio."),
    "fr": ("Désolé, je ne peux pas évaluer cette vidéo.", "Malheureusement je dois refuser cette demande.", "Il m'est impossible de juger ce contenu, désolé."),
    "de": ("Es tut mir leid, ich kann diesen Inhalt nicht beurteilen.", "Leider muss ich diese Anfrage ablehnen.", "Eine Bewertung ist mir nicht möglich, leider."),
}

_CLOSERS = "\"'”’»)]}*_` \t\r\n\u200b\xa0"
_ENDS = ".!?。！？"
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|\n+")
_SPOKEN = re.compile(r"[“\"«][^”\"»]{0,80}[”\"»]")
_CODE = re.compile(r"[a-z]{2}")


class Languages:
    """Naive Bayes over hashed words and over letters, trained on the records whose prompt's language is given.

    Answers are in their prompt's language but for a few, so both texts count. A word that a language lacks gets the
    same share of its average frequency in every language, so that none gains by having fewer words. The words fall by
    their hash into two halves; each half judges for itself, so that the two do not err together.
    """

    def __init__(self, names: Sequence[str], counts: np.ndarray, letters: np.ndarray) -> None:
        self.names = list(names)
        self.logs, self.letters = (self._log(c) for c in (counts, letters))
        self.memo: dict[str, int] = {}

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(1, counts.sum(1, keepdims=True))
        return np.log(share + 0.01 * (share.mean(0, keepdims=True) if len(share) else 0) + 1e-9).astype(np.float32)

    def ids(self, ws: list[str]) -> np.ndarray:
        if len(self.memo) > 200_000:
            self.memo.clear()
        memo, out = self.memo, []
        for w in ws:
            if (b := memo.get(w)) is None:
                b = memo[w] = _bucket(w)
            out.append(b)
        return np.array(out, np.int64)

    def of(self, ws: list[str]) -> str | None:
        return self.names[int(np.argmax(self.logs[:, self.ids(ws)].sum(1)))] if ws and self.names else None

    def by_halves(self, ws: list[str], sizes: list[int]) -> np.ndarray:
        """For either half of the words the language's number of each of the sentences of ``sizes`` words; -1 where it knows no word there."""
        ids = self.ids(ws)
        starts, s = np.cumsum([0, *sizes[:-1]]), self.logs[:, ids]
        out = []
        for half in (0, 1):
            own = ids % 2 == half
            best = np.argmax(np.add.reduceat(s * own, starts, axis=1), 0)
            out.append(np.where(np.add.reduceat(own, starts) > 0, best, -1))
        return np.stack(out)

    def by_letters(self, text: str) -> int:
        n = Counter(text)
        ids = [ord(c) % LETTER_BUCKETS for c in n]
        return int(np.argmax(self.letters[:, ids] @ np.array(list(n.values()), np.float32)))


def _bucket(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % LANG_BUCKETS


def language_code(raw: str | None) -> str | None:
    """The two-letter code of a language; null for anything else, so there are at most 676."""
    code = re.split(r"[-_ ]", raw.strip().lower())[0] if raw else ""
    return code if _CODE.fullmatch(code) else None


def _broken(text: str) -> bool:
    """Whether a text stops before the end of a sentence."""
    t = text.rstrip(_CLOSERS)
    return bool(t) and (t[-1] not in _ENDS or t.endswith("..") or t.endswith(" ."))


def _grams(ws: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(ws[i:] for i in range(n))))


def _side(x: float, yes: float, no: float) -> int:
    return 1 if x >= yes else -1 if x <= no else 0


def _copied(said: list[str], asked: list[str]) -> list[int]:
    """Shares of the answer's five and three words in a row that the prompt has too, and the longest stretch it has."""
    n, known = len(said), set(asked)
    held = [w in known for w in said]
    share5 = share3 = run = best = 0
    if sum(held) > 0.4 * n:  # else neither share can reach the lower bounds
        have3 = set(_grams(asked, 3))
        share3 = sum(g in have3 for g in _grams(said, 3)) / (n - 2)
    for h in held:
        run = run + 1 if h else 0
        if run > best:
            best = run
    if best >= 5:  # else no five words in a row are the prompt's
        five, have5 = _grams(said, 5), set(_grams(asked, 5))
        share5 = sum(g in have5 for g in five) / len(five)
        run = best = 0
        for g in five:
            run = run + 1 if g in have5 else 0
            if run > best:
                best = run
        best += 4 if best else 0
    else:
        best = 0
    return [_side(share5, 0.7, 0.55), _side(share3, 0.75, 0.6), _side(best / n, 0.5, 0.15)]


def _folded(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").replace("\u200b", "").strip()


def _parts(text: str) -> Iterator[list[str]]:
    """The words of each sentence that has any."""
    return (ws for s in _SENTENCE.split(text) if (ws := words(s)))


def _empty(text: str, n: int) -> list[int]:
    plain = text.casefold().strip(" .-_*'\"`{}[]()<>:;,!?…")
    return [1 if not re.search(r"\w", text) else -1, 1 if not plain or plain in PLACEHOLDERS else -1, 1 if n < 4 and not (n and text[-1:] in _ENDS) else -1 if n >= 8 else 0]


def _refusal(text: str, said: list[str]) -> list[int]:
    n, different = len(said), set(said)
    if not n:
        return [0, 0, 0, 0]
    low = _SPOKEN.sub(" ", text.casefold().replace("’", "'"))
    declines = any(not different.isdisjoint(some) and p.search(low) for some, p in REFUSALS)
    own_words = () if different.isdisjoint(EXCUSES) and different.isdisjoint(ITSELF) else words(low)
    excuses, itself = not EXCUSES.isdisjoint(own_words), not ITSELF.isdisjoint(own_words)
    return [1 if declines else -1, 1 if excuses else -1, 1 if itself else -1, -1 if n > 60 or re.search(r"\d", text) else 0]


def _truncated(text: str, worded: bool, suggestions: Sequence[str] | None, raw: str | None) -> list[int]:
    last = (suggestions[-1] if suggestions is not None and len(suggestions) else None) or ""
    stops = [worded and _broken(text), bool(last.strip()) and _broken(last)]
    open_raw = None if raw is None or not raw.strip() else not raw.rstrip("` \n\t").endswith("}")
    pairs = any(text.count(a) > text.count(b) for a, b in ("“”", "()", "«»", "[]"))
    return [0 if not worded else 1 if any(stops) else -1, 0 if open_raw is None or not open_raw else 1, 1 if pairs else 0]


class Voter:
    """The votes on records and on copies of them with a defect put in."""

    def __init__(self, languages: Languages) -> None:
        self.languages = languages
        self.nothing = [_empty(x, sum(map(len, _parts(x)))) for x in map(_folded, SAY_NOTHING)]
        self.refused = {k: [_refusal(x, [w for ws in _parts(x) for w in ws]) for x in map(_folded, own)] for k, own in REFUSED.items()}

    def votes(self, explanation: str | None, suggestions: Sequence[str] | None, prompt: str | None, raw: str | None, lang: str | None, at: int = 0) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
        """What each labelling function says of each defect: 1 for it, -1 against it, 0 nothing; and what it says where that defect was put in.

        The functions of one defect look at different things: of ``refusal`` at phrases that decline, at words that excuse,
        at the first person, at length and numbers; of ``language`` at either half of the vocabulary and at the letters; of ``copied`` at short
        and long runs and the longest stretch; of ``truncated`` at the ends, the raw output and open brackets.

        A defect is put in by an explanation that says nothing, by a refusal in the prompt's language, by dropping the
        last third, by the end of the prompt, or by a prompt in another language; ``at`` picks among several ways. It
        is not put in where there is no explanation or too little to take it from.
        """
        languages, text = self.languages, _folded(explanation)
        parts = list(_parts(text))
        said = [w for ws in parts for w in ws]
        n, asked, code = len(said), words(prompt or ""), language_code(lang)
        out = {"empty": _empty(text, n), "refusal": _refusal(text, said), "truncated": _truncated(text, n > 0, suggestions, raw)}
        out["copied"] = _copied(said, asked) if n >= 6 and len(asked) >= 6 else [-1 if n else 0, 0, 0]
        own = code if code in languages.names else languages.of(asked)
        out["language"] = [-1 if n else 0, 0, 0]
        spoiled: dict[str, list[int]] = {}
        if several := own is not None and len(languages.names) > 1:
            mine = languages.names.index(own)
            theirs = (mine + 1 + at % (len(languages.names) - 1)) % len(languages.names)
            spoiled["language"] = out["language"]
        if n >= 4 and several:
            sizes, letters = [len(ws) for ws in parts], languages.by_letters(text.lower())
            halves = [np.bincount(h + 1, sizes, len(languages.names) + 1)[1:] for h in languages.by_halves(said, sizes)]  # words by language
            sums = [h.sum() for h in halves]
            out["language"], spoiled["language"] = ([*(1 if 2 * (m - h[k]) > m else -1 for h, m in zip(halves, sums)), 1 if letters != k else -1] for k in (mine, theirs))
        x, p = explanation or "", prompt or ""
        if not x.strip():
            return out, {}
        spoiled["empty"] = self.nothing[at % len(self.nothing)]
        declined = self.refused.get(code or own or "", self.refused["en"])
        spoiled["refusal"] = declined[at % len(declined)]
        if len(x) > 60:
            short = _folded(x[: len(x) * 2 // 3].rstrip(".!? "))
            spoiled["truncated"] = _truncated(short, any(_parts(short)), suggestions, raw)
        if len(p) > 200:
            end = [w for ws in _parts(_folded(p[-len(p) * 2 // 3 :].split(" ", 1)[-1])) for w in ws]
            spoiled["copied"] = _copied(end, asked) if len(end) >= 6 and len(asked) >= 6 else [-1 if end else 0, 0, 0]
        return out, spoiled


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """The posterior of the defect for each pattern of votes, by expectation-maximization.

    A hidden label makes every function that votes do so with its own error rates, independently of the others; a
    function that says nothing adds nothing. The start is the majority; functions that disagree with the rest lose
    weight by themselves. A pattern without any vote is no evidence and gets posterior 0.
    """
    keys = sorted(k for k in patterns if any(k))
    if not keys:
        return {}
    v, n = np.array(keys), np.array([patterns[k] for k in keys], np.float64)
    r = np.clip(0.5 + 0.5 * v.sum(1) / (v != 0).sum(1), 0.02, 0.98)
    for _ in range(rounds):
        w = np.stack([1 - r, r]) * n
        prior = (w.sum(1) + 1) / (n.sum() + 2)
        log = np.log(prior)[:, None] * np.ones(len(keys))
        for j in range(v.shape[1]):
            p = np.stack([((v[:, j] == c) * w).sum(1) for c in (-1, 1)], 1) + np.array([[0.9, 0.1], [0.1, 0.9]])
            p /= p.sum(1, keepdims=True)
            log += np.where(v[:, j] == 0, 0.0, np.log(p[:, (v[:, j] + 1) // 2]))
        r = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    return {k: 0.0 for k in patterns} | dict(zip(keys, r.tolist()))


def _cutoff(posterior: dict[tuple[int, ...], float], good: Counter, bad: Counter) -> float:
    """The posterior above which records count as defective: the best F1 on spoiled against untouched records, both as counts of patterns."""

    def f1(c: float) -> float:
        hit, wrong = (sum(n for k, n in some.items() if posterior.get(k, 0.0) > c) for some in (bad, good))
        return 2 * hit / (hit + wrong + bad.total()) if bad else 0.0

    return max((0.5, 0.6, 0.7, 0.8, 0.9, 0.95), key=lambda c: (round(f1(c), 3), -c))


def train_languages(rows: DataFrame) -> Languages:
    """The language model of all ``rows(lang, prompt, explanation)``: word counts are added up in each task and hashed, so of fixed size."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[Counter, Counter]] = {}
        out: dict[str, np.ndarray] = {}

        def settle() -> None:
            for code, (ws, letters) in seen.items():
                sums = out.setdefault(code, np.zeros(LANG_BUCKETS + LETTER_BUCKETS, np.int64))
                np.add.at(sums, np.fromiter(map(_bucket, ws), np.int64, len(ws)), np.fromiter(ws.values(), np.int64, len(ws)))
                np.add.at(sums, np.fromiter((LANG_BUCKETS + ord(c) % LETTER_BUCKETS for c in letters), np.int64, len(letters)), np.fromiter(letters.values(), np.int64, len(letters)))
            seen.clear()

        for pdf in it:
            for lang, prompt, said in zip(pdf["lang"], pdf["prompt"], pdf["explanation"]):
                if (code := language_code(lang)) is not None:
                    ws, letters = seen.setdefault(code, (Counter(), Counter()))
                    ws.update({*words(prompt or ""), *words(said or "")})
                    letters.update((said or "").lower())
            if sum(len(ws) for ws, _ in seen.values()) > 300_000:
                settle()
        settle()
        for code, sums in out.items():
            b = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": code, "b": b.astype(np.int32), "c": sums[b]})

    known = rows.where("lang is not null")
    sums = known.mapInPandas(count, "lang string, b int, c bigint").groupBy("lang", "b").agg(F.sum("c").alias("c")).toPandas()
    names = sorted(sums["lang"].unique())
    counts = np.zeros((len(names), LANG_BUCKETS + LETTER_BUCKETS))
    counts[np.searchsorted(names, sums["lang"]) if names else [], sums["b"]] = sums["c"]
    return Languages(names, counts[:, :LANG_BUCKETS], counts[:, LANG_BUCKETS:])


def answer_defects(df: DataFrame, key: str) -> DataFrame:
    """(key, defect, posterior): every defect whose posterior exceeds its cutoff, several for a record if so.

    Reads ``prompt, explanation, improvement_suggestions, raw_llm_output, lang``. Labelling functions vote on every
    record (``Voter``); the distinct vote patterns of a defect, at most 3 to the power of its functions, are counted
    over all records and give the label model its posteriors. Each cutoff is the one with the best F1 on all
    records and copies of them with the defect put in, which are voted on in the same pass.

    Two local passes; only patterns and hashed word counts are shuffled. No record meets another.

    Edge cases: null keys are dropped; rows of one key are one record; a null, blank or placeholder explanation is
    ``empty`` and nothing else; a null prompt or an unknown language gives no vote on what needs it; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    names = ["explanation", "improvement_suggestions", "prompt", "raw_llm_output", "lang"]
    rows = spread(df.select(F.col(key).alias("key"), *names).where("key is not null"))
    languages = train_languages(rows.select("lang", "prompt", "explanation"))
    shared = spark.sparkContext.broadcast(languages)
    spoilt = {d: f"{d}_spoiled" for d in DEFECTS}

    def vote(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voter = Voter(shared.value)
        for pdf in filter(len, it):
            out = [voter.votes(*(None if isinstance(x, float) else x for x in r), at) for at, *r in zip(pdf["at"], *(pdf[c] for c in names))]
            yield pd.DataFrame({"key": pdf["key"]} | {d: [v[d] for v, _ in out] for d in DEFECTS} | {spoilt[d]: [v.get(d) for _, v in out] for d in DEFECTS})

    kind = df.schema[key].dataType.simpleString()
    placed = rows.withColumn("at", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)))
    columns = [*DEFECTS, *spoilt.values()]
    voted = cut(placed.mapInPandas(vote, f"key {kind}, " + ", ".join(f"{c} array<int>" for c in columns)).groupBy("key").agg(*(F.max(c).alias(c) for c in columns)))
    plain = F.col("empty")[0] < 0
    sides = voted.select(F.inline(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("own"), F.col(spoilt[d]).alias("spoiled"), plain.alias("plain")) for d in DEFECTS))))
    counts = {d: (Counter(), Counter(), Counter()) for d in DEFECTS}  # patterns of all records, of those that say something, of the spoiled copies
    for r in sides.groupBy("defect", "own", "spoiled", "plain").count().collect():
        every, good, bad = counts[r["defect"]]
        every[tuple(r["own"])] += r["count"]
        if r["plain"]:
            good[tuple(r["own"])] += r["count"]
        if r["spoiled"] is not None:
            bad[tuple(r["spoiled"])] += r["count"]
    posterior = {d: label_model(every) for d, (every, _, _) in counts.items()}
    cutoffs = {d: _cutoff(posterior[d], good, bad) for d, (_, good, bad) in counts.items()}
    table = [(d, list(k), p) for d in DEFECTS for k, p in posterior[d].items() if p > cutoffs[d]]
    hits = F.broadcast(spark.createDataFrame(table, "defect string, pattern array<int>, posterior double"))  # at most 81 patterns a defect
    each = voted.select("key", F.inline(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))))
    return each.join(hits, ["defect", "pattern"]).select(F.col("key").alias(key), "defect", "posterior")


def main_defect(labels: DataFrame, key: str) -> DataFrame:
    """(key, defect): the likeliest defect of each record; of equally likely ones the first in DEFECTS."""
    order = reduce(lambda a, i: a.when(F.col("defect") == DEFECTS[i], -i), range(1, len(DEFECTS)), F.when(F.col("defect") == DEFECTS[0], 0))
    return labels.groupBy(key).agg(F.max_by("defect", F.struct(F.round("posterior", 2), order)).alias("defect"))

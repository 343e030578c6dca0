"""Text garbled by a wrong character encoding: found and restored by character n-gram models."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.runtime import cut, spread

# Encodings a text may have been wrongly decoded with, and those it was really in.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "cp437", "cp850", "cp866", "mac_roman", "koi8-r")
RIGHT = ("utf-8", "cp1252")
LOST = "�"

ORDER, BUCKETS = 3, 1 << 18  # n-grams up to this length, hashed; the model's size does not depend on the corpus
STRENGTH = 4.0  # weight of the shorter context in the smoothed estimates
LEAST = 2.0  # no margin is lower
LIMITS = (64.0, math.inf)  # gains of garbled copies are worked out below the first of these that holds the part of them that sets the margin
STEPS = 1000  # gains are counted by the thousandth of their logarithm
_WORD = re.compile(r"[^ \n\t]+")
_FOREIGN = re.compile(r"(?<![^ \n\t])[\x00-\x08\x0b-\x1f\x21-\x7f]*+[^\x00-\x7f][^ \n\t]*")  # a word that is not ASCII
_PASSAGE = re.compile(r"(?<=[.!?])[ \n]+|\n+")
_LOST_RUN = re.compile(LOST + "+")
_CONTROL = re.compile("[\u0080-\u009f]")
_OTHER_SCRIPT = re.compile("[A-Za-z][\u0370-\u052f]|[\u0370-\u052f][A-Za-z]")
_SHORT = 24  # a longer stretch without spaces is scored in parts of this size


def _to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that ``encoding`` shows as ``text``; what it leaves undefined shows as the control character of that number."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not _CONTROL.search(text):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) <= 0x9F:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decoded(raw: bytes | None, right: str, text: str) -> str | None:
    """What the bytes are in ``right``; None if they are no such text, or the text itself."""
    if raw is None:
        return None
    try:
        back = raw.decode(right)
    except UnicodeDecodeError:
        if right == "utf-8":
            return None
        back = raw.decode("latin-1")
    return back if back != text else None


def undo(text: str, wrong: str, right: str) -> str | None:
    """What ``text`` was before its bytes in ``right`` were decoded as ``wrong``; None if it cannot have been so."""
    return _decoded(_to_bytes(text, wrong), right, text)


def _chains() -> list[tuple[tuple[str, str], ...]]:
    once = [((w, r),) for w in WRONG for r in RIGHT if w != r and not (w == "latin-1" and r == "cp1252")]
    return once + [((a, "utf-8"), (b, "utf-8")) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")]


CHAINS = _chains()
ONCE = {chain[0]: k for k, chain in enumerate(CHAINS) if len(chain) == 1}


def follow(text: str, chain: Sequence[tuple[str, str]]) -> str | None:
    for wrong, right in chain:
        if (text := undo(text, wrong, right)) is None:
            return None
    return text


def _grams(word: str, n: int) -> list[str]:
    padded = " " * (ORDER - 1) + word + " "
    return [padded[i - n + 1 : i + 1] for i in range(ORDER - 1, len(padded))]


def _bucket(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def gram_counts(words: Counter) -> np.ndarray:
    """Hashed counts of all n-grams of 1 to ORDER characters, a row for each length; long words count in parts."""
    counts = np.zeros((ORDER, BUCKETS), np.int64)
    parts = [(w[i : i + _SHORT], c) for w, c in words.items() for i in range(0, len(w), _SHORT)]
    for n in range(1, ORDER + 1):
        grams: Counter = Counter()
        for w, c in parts:
            for g in _grams(w, n):
                grams[g] += c
        for g, c in grams.items():
            counts[n - 1, _bucket(g)] += c
    return counts


class Model:
    """Smoothed log probabilities of words by their characters, each estimate leaning on the next shorter context."""

    def __init__(self, counts: np.ndarray, letters: str = "") -> None:
        self.counts = counts.astype(np.float64)
        self.total = self.counts[0].sum()
        self.letters = letters
        self.memo: dict[str, float] = {}

    def _log(self, gram: str) -> float:
        if (p := self.memo.get(gram)) is None:
            est = (self.counts[0, _bucket(gram[-1])] + 0.01) / (self.total + 0.01 * 0x110000)
            for n in range(2, len(gram) + 1):
                # the context's count: its own n-gram count one shorter
                context = self.counts[n - 2, _bucket(gram[-n:-1])]
                est = (self.counts[n - 1, _bucket(gram[-n:])] + STRENGTH * est) / (context + STRENGTH)
            if len(self.memo) > 500_000:
                self.memo.clear()
            p = self.memo[gram] = math.log(min(est, 1.0))
        return p

    def score(self, word: str) -> float:
        return sum(self._log(g) for g in _grams(word, ORDER))

    def fill(self, word: str) -> str:
        """The word with each run of lost characters replaced by the letter that suits its neighbours best."""
        for m in reversed(list(_LOST_RUN.finditer(word))):
            left, right = ("  " + word[: m.start()])[-2:].replace(LOST, " "), (word[m.end() :] + "  ")[:2].replace(LOST, " ")
            best = max(self.letters or "e", key=lambda c: self._log(left + c) + self._log(left[-1] + c + right[0]) + self._log(c + right))
            word = word[: m.start()] + best + word[m.end() :]
        return word


class _Memo(dict):
    """What a function gives for a word, worked out once; all of it is forgotten when there is too much."""

    def __init__(self, function: Callable, most: int) -> None:
        self.function, self.most = function, most

    def __missing__(self, w: str):
        value = self.function(w)
        if len(self) >= self.most:
            self.clear()
        self[w] = value
        return value


def _garbled(word: str, wrong: str, right: str) -> str | None:
    """The word's bytes in ``right`` shown in ``wrong``; None if there is no such thing."""
    try:
        return word.encode(right).decode(wrong)
    except UnicodeError:
        return None


class Judge:
    """Gains of every chain on words and passages (given by their words that are not ASCII); a word's gains are computed once."""

    def __init__(self, model: Model, margin: float = LEAST) -> None:
        self.model, self.margin = model, margin
        self.memo: dict[str, dict[int, float]] = {}
        self.most = _Memo(lambda w: max(0.0, max(self.word(w).values(), default=0.0)), 200_000)
        self.own = _Memo(model.score, 200_000)
        self.back = {pair: _Memo(partial(self._back, pair), 20_000) for pair in ONCE}

    def may(self, words: list[str]) -> bool:
        """Whether a passage can gain more than the margin: its words' best gains, whatever their chains, add up to more."""
        return sum(map(self.most.__getitem__, words)) > self.margin

    def _back(self, pair: tuple[str, str], w: str) -> float:
        """What a word garbled by ``pair`` gains by being restored; NaN if it cannot be garbled so."""
        if (bad := _garbled(w, *pair)) is None:
            return math.nan
        return self.own[w] - self.model.score(bad) if len(bad) <= _SHORT else self.word(bad).get(ONCE[pair], 0.0)

    def garbled(self, words: list[str], pair: tuple[str, str], limit: float) -> float | None:
        """The gain of a passage's best chain after its words are garbled by ``pair``, at most ``limit``; None if that changes nothing or cannot be.

        Undoing ``pair`` is one of the chains, so others need to be tried only where it gains less than the limit.
        """
        least = sum(map(self.back[pair].__getitem__, words))
        if math.isnan(least):
            return None
        if least >= limit:
            return limit
        bad = [_garbled(w, *pair) for w in words]
        return None if bad == words else min(limit, self.best(bad)[0])

    def word(self, w: str) -> dict[int, float]:
        if (g := self.memo.get(w)) is None:
            if len(w) > _SHORT:
                g = {}
                for a in range(0, len(w), _SHORT):
                    if not (part := w[a : a + _SHORT]).isascii():
                        for k, v in self.word(part).items():
                            g[k] = g.get(k, 0.0) + v
                return g
            own, g = self.model.score(w), {}
            raw = {wrong: _to_bytes(w, wrong) for wrong in WRONG}
            for k, ((wrong, right), *rest) in enumerate(CHAINS):
                back = _decoded(raw[wrong], right, w)
                if back is not None and (back := follow(back, rest)) is not None:
                    g[k] = self.model.score(back) - own
            if LOST in w:
                g[len(CHAINS)] = self.model.score(self.model.fill(w)) - own
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = g
        return g

    def best(self, words: list[str]) -> tuple[float, int]:
        """(gain, chain) of the likeliest chain over a passage's words; words a chain cannot have made stay as they are."""
        sums: dict[int, float] = {}
        for w in words:
            for k, v in self.word(w).items():
                sums[k] = sums.get(k, 0.0) + v
        k = max(sums, key=lambda k: (sums[k], -k), default=-1)
        return sums.get(k, 0.0), k

    def restore(self, text: str) -> tuple[bool, str, str]:
        """(garbled, restored text, chain): every passage whose likeliest chain gains more than the margin is restored where it can be."""
        out, at, garbled, used = [], 0, False, ""
        for start, end in _spans(text):
            passage = text[start:end]
            if passage.isascii() or not self.may(words := _FOREIGN.findall(passage)):
                continue
            gain, k = self.best(words)
            if gain > self.margin and k >= 0:
                garbled = True
                if k < len(CHAINS):
                    used = used or ">".join(f"{w}/{r}" for w, r in CHAINS[k])
                    fixed = _WORD.sub(lambda m: m[0] if m[0].isascii() else self._fix(m[0], k), passage)
                    out += [text[at:start], fixed]
                    at = end
        return garbled, "".join([*out, text[at:]]), used

    def _fix(self, word: str, k: int) -> str:
        back = follow(word, CHAINS[k])
        return word if back is None or self.model.score(back) <= self.model.score(word) else back


def _spans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _PASSAGE.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _suspicious(text: str) -> bool:
    """Whether some word can be read as UTF-8 bytes shown in another encoding or mixes scripts, or characters are lost: such records don't train the model."""
    if LOST in text or _OTHER_SCRIPT.search(text):
        return True
    for w in set(_WORD.findall(text)):
        if not w.isascii():
            for wrong in WRONG:
                if (back := undo(w, wrong, "utf-8")) is not None and len(back) < len(w):
                    return True
    return False


def train_model(docs: DataFrame) -> Model:
    """The model of all clean records of ``docs(text)``: every task adds up its n-grams, the sums are hashed and so bounded."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        memo: dict[str, bool] = {}
        counts = np.zeros((ORDER, BUCKETS), np.int64)
        letters: Counter = Counter()
        for pdf in it:
            for t in pdf["text"]:
                own = _WORD.findall(t)
                bad = False
                for w in () if t.isascii() else set(own):
                    if not w.isascii():
                        if (b := memo.get(w)) is None:
                            b = memo[w] = _suspicious(w)
                        bad |= b
                if not bad:
                    words.update(own)
            if len(words) > 300_000:
                counts += gram_counts(words)
                _letters(words, letters)
                words.clear()
            if len(memo) > 300_000:
                memo.clear()
        counts += gram_counts(words)
        _letters(words, letters)
        n, b = np.nonzero(counts)
        yield pd.DataFrame({"n": n.astype(np.int32), "b": b.astype(np.int32), "c": counts[n, b]})
        yield pd.DataFrame({"n": np.full(len(letters), -1, np.int32), "b": np.array([ord(c) for c in letters], np.int32), "c": np.array(list(letters.values()), np.int64)})

    sums = docs.mapInPandas(count, "n int, b int, c bigint").groupBy("n", "b").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros((ORDER, BUCKETS), np.int64)
    gram = sums[sums["n"] >= 0]
    counts[gram["n"], gram["b"]] = gram["c"]
    letters = sums[sums["n"] < 0].sort_values(["c", "b"], ascending=[False, True])["b"].head(160)
    return Model(counts, "".join(map(chr, letters)))


def _letters(words: Counter, letters: Counter) -> None:
    for w, c in words.items():
        if not w.isascii():
            for ch in w:
                if ch > "\x7f":
                    letters[ch] += c


def _step(gain: float) -> int:
    return int(STEPS * math.log(gain)) if gain > 1 else 0


def _quantile(counts: dict[int, int], q: float) -> float:
    """The quantile of gains counted by step, interpolated between neighbours."""
    steps = sorted(counts)
    ends = np.cumsum([counts[x] for x in steps])
    at = q * (int(ends[-1]) - 1)
    low, high = (math.exp((steps[int(np.searchsorted(ends, k, "right"))] + 0.5) / STEPS) for k in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def choose_margin(clean: dict[int, int], garbled: dict[int, int], limit: float = math.inf) -> float | None:
    """The margin between passages and the same passages garbled on purpose, by the counts of their gains; None if ``limit`` is too low to tell.

    It is the geometric middle of the gain that 99 of 100 passages stay below (at least LEAST) and the gain that
    995 of 1000 garbled ones reach. No record is known to be clean: passages that gain as much as garbled ones do are
    left out, so that records garbled in whichever way do not raise the margin.
    """
    n = sum(garbled.values())
    if not n:
        high = math.inf
    elif limit < math.inf and sum(c for x, c in garbled.items() if x < _step(limit)) <= math.ceil(0.005 * (n - 1)):
        return None
    else:
        high = _quantile(garbled, 0.005)
    lower = {x: c for x, c in clean.items() if math.exp((x + 0.5) / STEPS) < high}
    low = max(LEAST, _quantile(lower, 0.99)) if lower else LEAST
    return math.sqrt(low * max(low, high)) if n else 2 * low


def gains(docs: DataFrame, model: Broadcast, kind: str, limit: float) -> DataFrame:
    """Of ``docs(doc_id, text, at)`` those with a passage that gains more than LEAST, with their ``top`` gain; and, where ``doc_id`` is null,
    how many (``n``) passages (``side`` 0) and garbled copies of passages (1) of records without a suspicious word gain so much (``step``).

    Every passage that is not ASCII is garbled once; which way is dealt in turn, beginning with the record's ``at``.
    """

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j, odd = Judge(model.value), _Memo(_suspicious, 200_000)
        counts: Counter = Counter()
        for pdf in it:
            rows = []
            for d, t, at in zip(pdf["doc_id"], pdf["text"], pdf["at"]):
                if t.isascii():
                    continue
                passages = [ws for a, b in _spans(t) if (ws := _FOREIGN.findall(t, a, b))]
                own = [j.best(ws)[0] if j.may(ws) else 0.0 for ws in passages]
                if (top := max(own, default=0.0)) > LEAST:
                    rows.append((d, t, top))
                if not any(any(map(odd.__getitem__, ws)) for ws in passages):
                    counts.update((0, _step(g)) for g in own)
                    for k, ws in enumerate(passages):
                        if (g := j.garbled(ws, CHAINS[(at + k) % len(CHAINS)][-1], limit)) is not None:
                            counts[1, _step(g)] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "text", "top"]).assign(side=None, step=None, n=None)
        sums = pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["side", "step", "n"])
        yield sums.assign(doc_id=None, text=None, top=None)[["doc_id", "text", "top", "side", "step", "n"]]

    return docs.mapInPandas(measure, f"doc_id {kind}, text string, top double, side int, step int, n bigint")


def repair_encoding(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, restored, chain) of every document with at least one garbled passage.

    Smoothed character n-gram models are trained on all records in which no word can be read as mis-decoded UTF-8 or mixes
    scripts.
    Each passage (a sentence or line) is scored under every encode-decode chain of CHAINS, and as having lost
    characters (U+FFFD, filled by the model for scoring only); the likeliest chain is accepted if it gains more log
    likelihood than a margin that is set on the passages of all records and the same passages garbled on purpose. ``chain``
    is empty, and the passage left as it is, where characters are lost.

    Two passes over the documents, each local to its partition, and one over those with a passage that gains enough for
    some margin; only hashed n-gram sums, of fixed size, and counts of gains to a thousandth of their size are gathered.
    Where fewer than 5 of 1000 garbled passages gain less than the first of LIMITS, the second pass is repeated with the next.

    Edge cases: null ids and texts are left out; empty and ASCII texts are never garbled; repeated rows give one
    row; an empty table gives an empty result; other columns are ignored. Texts are scored whole, however long.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    model = train_model(docs.select("text"))
    shared = spark.sparkContext.broadcast(model)
    kind = documents.schema[doc_id].dataType.simpleString()
    placed = docs.withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)))
    for limit in LIMITS:
        measured = cut(gains(placed, shared, kind, limit))
        counts: tuple[dict[int, int], dict[int, int]] = {}, {}
        for r in measured.where("side is not null").groupBy("side", "step").agg(F.sum("n").alias("n")).collect():
            counts[r.side][r.step] = r.n
        if (margin := choose_margin(*counts, limit)) is not None:
            break

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = Judge(shared.value, margin)
        for pdf in it:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                garbled, back, chain = j.restore(t)
                if garbled:
                    rows.append((d, back, chain))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "chain"])

    found = measured.where(F.col("top") > margin).select("doc_id", "text").mapInPandas(judge, f"doc_id {kind}, restored string, chain string")
    return found.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias(doc_id), "restored", "chain")

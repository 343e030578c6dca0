"""Evaluation items leaking into documents: a prefix-filtered set join, verified over item-sized windows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.words import words
from sceneloom.runtime import spread

ITEM_WORDS = 1_000_000  # words of the items whose index is sent to the executors at once: under 150 MB
CELLS = 1 << 21  # documents times items that are counted at once
SEEN = 1 << 20  # hashed word frequencies, whatever the corpus
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _bucket(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % SEEN


def _runs(ids: np.ndarray, run: int) -> np.ndarray:
    """A hash of each ``run`` consecutive numbers."""
    if len(ids) < run:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(run, _BASE))
        return (np.lib.stride_tricks.sliding_window_view(ids.astype(np.uint64) + np.uint64(1), run) * powers).sum(1, dtype=np.uint64)


def _between(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start up to before its end."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Index:
    """Items by the words and the runs of words that they cannot do without, in flat arrays.

    The prefix of an item is its rarest words: of any n - need + t of its n words a matching stretch lacks at most
    n - need, so it holds t of them. With stretches that may leave words out and put others in, no longer shingle than
    one word is sure to survive. A run of words is a shingle of that length, and an item's prefix all of them.
    """

    def __init__(self, items: list[tuple[object, list[str]]], seen: np.ndarray, run: int, share: float, stretch: float) -> None:
        self.keys, self.run = [k for k, _ in items], run
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        rarity = np.array([seen[_bucket(w)] for w in self.vocabulary], np.int64)
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in items]
        sizes = np.array([len(x) for x in self.ids], np.int64)
        self.need = np.maximum(1, np.ceil(share * sizes - 1e-9)).astype(np.int64)
        self.window = (stretch * sizes + 1e-9).astype(np.int64)
        self.least = (self.need + 1) // 2
        words_, owners, counts = [], [], []
        for i, x in enumerate(self.ids):
            rare = x[np.lexsort((x, rarity[x]))][: len(x) - self.need[i] + self.least[i]]
            w, c = np.unique(rare, return_counts=True)
            words_.append(w)
            owners.append(np.full(len(w), i, np.int32))
            counts.append(c.astype(np.int32))
        flat, self.owner, self.times = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (words_, owners, counts))
        order = np.argsort(flat, kind="stable")
        self.owner, self.times = self.owner[order], self.times[order]
        self.at = np.searchsorted(flat[order], np.arange(len(self.vocabulary) + 1))
        hashes = [_runs(x, run) for x in self.ids]
        spots = np.concatenate([np.stack([np.full(len(h), i), np.arange(len(h))], 1) for i, h in enumerate(hashes)]) if hashes else np.zeros((0, 2), np.int64)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.spots = hashes[order], spots[order].astype(np.int32)
        self.bits: dict[int, dict[int, int]] = {}

    def _bits(self, i: int) -> dict[int, int]:
        """The places of each of an item's words, as bits."""
        if (b := self.bits.get(i)) is None:
            if len(self.bits) > 5000:
                self.bits.clear()
            b = self.bits[i] = {}
            for j, w in enumerate(self.ids[i].tolist()):
                b[w] = b.get(w, 0) | 1 << j
        return b

    def _in_order(self, i: int, window: list[int]) -> bool:
        """Whether the window keeps enough of the item's words in their order: the longest common subsequence, by bits."""
        bits = self._bits(i)
        full = v = (1 << len(self.ids[i])) - 1
        for w in window:
            if m := bits.get(w):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(self.ids[i]) - v.bit_count() >= self.need[i]

    def _within(self, i: int, ids: np.ndarray, known: np.ndarray) -> bool:
        """Whether some stretch of the document does; it starts at one of the item's words and holds enough of them."""
        at = known[np.isin(ids[known], self.ids[i])]
        k, window = int(self.need[i]), int(self.window[i])
        if len(at) < k:
            return False
        starts = np.flatnonzero(at[k - 1 :] - at[: len(at) - k + 1] < window)
        return any(self._in_order(i, ids[at[s] : at[s] + window].tolist()) for s in starts)

    def match(self, lists: list[list[str]]) -> list[tuple[int, object]]:
        """(document, key) of the items that each document's words hold; documents are joined together, as many as CELLS allow."""
        step = max(1, CELLS // max(1, len(self.keys)))
        return [(a + d, self.keys[i]) for a in range(0, len(lists), step) for d, i in self._joined(lists[a : a + step])]

    def _joined(self, lists: list[list[str]]) -> set[tuple[int, int]]:
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for ws in lists for w in ws], np.int64)
        ends = np.cumsum([len(ws) for ws in lists])
        known = np.flatnonzero(ids >= 0)
        doc = np.searchsorted(ends, known, "right")
        found = set()
        # a run starts where it and the last of its words are known words of one document, with as many known ones between
        first = known[: max(0, len(known) - self.run + 1)]
        first = first[(known[self.run - 1 :] - first == self.run - 1) & (doc[self.run - 1 :] == doc[: len(first)])] if len(first) else first
        runs = _runs(ids, self.run)[first]
        low, high = np.searchsorted(self.hashes, runs, "left"), np.searchsorted(self.hashes, runs, "right")
        for r in np.flatnonzero(high > low).tolist():
            a = int(first[r])
            d = int(np.searchsorted(ends, a, "right"))
            for i, j in self.spots[low[r] : high[r]].tolist():
                if (d, i) not in found and np.array_equal(self.ids[i][j : j + self.run], ids[a : a + self.run]):
                    found.add((d, i))
        v, n = max(1, len(self.vocabulary)), max(1, len(self.keys))
        distinct = np.unique(doc * v + ids[known])
        starts, stops = self.at[distinct % v], self.at[distinct % v + 1]
        posted = _between(starts, stops)
        held = np.bincount(np.repeat(distinct // v, stops - starts) * n + self.owner[posted], self.times[posted], len(lists) * n)
        for c in np.flatnonzero(held >= np.tile(self.least, len(lists))).tolist() if len(self.keys) else ():
            d, i = divmod(c, n)
            if (d, i) not in found:
                a, b = (int(ends[d - 1]) if d else 0), int(ends[d])
                own = known[np.searchsorted(known, a) : np.searchsorted(known, b)] - a
                if self._within(i, ids[a:b], own):
                    found.add((d, i))
        return found


def leaked_items(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, share: float = 0.75, stretch: float = 1.25) -> DataFrame:
    """(doc_id, item_id): the document holds ``run`` consecutive words of the item, or a stretch of at most ``stretch``
    times the item's length keeps at least ``share`` of the item's words in their order.

    Words are ordered by their frequency over all documents, rarest first. An item is joined to the documents that
    hold enough of its prefix of rarest words; then its words must lie close enough together (length and position),
    and the stretches that start at one of them are verified exactly by the length of the longest common subsequence.
    Runs are joined by shingles of ``run`` words and verified word by word. Every bound is a necessary condition, so
    nothing is lost. Whole texts are read, in one pass for the frequencies, which serve all items, and one for the join;
    nothing but the found pairs is shuffled. The items' index goes to the executors in blocks of at most ITEM_WORDS
    words (some 10,000 items), with one pass of the join for each, so its size is bounded.

    Edge cases: null ids and texts have no match, nor have items without words; an item of fewer than ``run`` words
    is found only by the second rule; rows given twice count once; empty tables give an empty result; other columns
    are ignored.
    """
    spark = documents.sparkSession
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    held = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where("k is not null and t is not null").distinct()
    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros(SEEN, np.int64), Counter()

        def settle() -> None:
            np.add.at(sums, np.fromiter(map(_bucket, n), np.int64, len(n)), np.fromiter(n.values(), np.int64, len(n)))
            n.clear()

        for pdf in it:
            for t in pdf["text"]:
                n.update(words(t))
            if len(n) > 300_000:
                settle()
        settle()
        b = np.flatnonzero(sums)
        yield pd.DataFrame({"b": b.astype(np.int32), "n": sums[b]})

    counted = docs.select("text").mapInPandas(count, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(SEEN, np.int64)
    seen[counted["b"]] = counted["n"]
    blocks = max(1, math.ceil((held.agg(F.sum(F.length("t"))).first()[0] or 0) / 2 / ITEM_WORDS))  # a word and what parts it from the next have two characters or more
    parts = []
    for b in range(blocks):
        listed = [(r.k, ws) for r in held.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect() if (ws := words(r.t))]
        index = spark.sparkContext.broadcast(_Index(listed, seen, run, share, stretch))

        def join(it: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in it:
                own = pdf["doc_id"].to_numpy(object)
                rows = [(own[d], k) for d, k in index.value.match([words(t) for t in pdf["text"]])]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        parts.append(docs.mapInPandas(join, out))
    return reduce(DataFrame.unionByName, parts).distinct().select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))

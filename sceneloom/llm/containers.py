"""Items into containers of fixed capacity: dominance reduction, then best fit."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.runtime import cut

PART_ROWS = 1_000_000  # items of a part; the numbering of equal items is spread over parts of about this size, 64 at least


class _Stock:
    """Counts of items by size, with the sizes still in stock in order."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.n = dict(zip(sizes.tolist(), counts.tolist()))
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def left(self, size: int, but: int) -> int:
        return self.n.get(size, 0) - (size == but)

    def largest(self, limit: int, but: int) -> int:
        """The largest size of at most ``limit``, one item of size ``but`` being away; 0 if there is none."""
        i = bisect_left(self.sizes, limit + 1) - 1
        while i >= 0 and self.left(self.sizes[i], but) <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, k: int, but: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), max(0, self.left(s, but)))
            if len(out) == k:
                break
        return out


def _dominant(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """The partners of an item of size j in a set that dominates every feasible set with j, or None.

    A set dominates another if the other's items can be put into groups, each no larger than an item of its own.
    """
    room = capacity - j
    k = stock.largest(room, j)
    if not k:
        return ()
    least = stock.smallest(3, j)
    if k == room or sum(least[:2]) > room or len(least) < 2:
        return (k,)
    if len(least) == 3 and sum(least) <= room:
        return None  # three partners fit: not decided by sets of this size
    # at most two partners fit: compare every pair x >= y, room for both, that one partner k cannot stand for
    second = stock.largest(room - k, j) if stock.left(k, j) > 1 or room - k < k else stock.largest(min(room - k, k - 1), j)
    i = bisect_left(stock.sizes, room // 2 + 1) - 1
    while i >= 0:
        y = stock.sizes[i]
        i -= 1
        if stock.left(y, j) <= 0:
            continue
        x = stock.largest(room - y, j)
        if x < y or (x == y and stock.left(y, j) < 2) or x + y <= k:
            continue
        return (k, second) if second and y <= second else None
    return (k,)


def pack_sizes(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(copies by size, number of such containers)] that hold ``counts`` items of each of the ``sizes``.

    Equal items are handled as one with a count, so time and result depend on the capacity, not on the number of items.
    First every set that provably dominates the alternatives of its largest item is fixed and taken out, until nothing
    changes; the rest is packed by falling size, each item into the fullest container that still has room for it.
    """
    stock, fixed = _Stock(sizes, counts), []
    changed = True
    while changed and stock.sizes:
        changed = False
        for j in reversed(list(stock.sizes)):
            while stock.n.get(j, 0):
                partners = _dominant(stock, j, capacity)
                if partners is None:
                    break
                copies: dict[int, int] = {}
                for x in (j, *partners):
                    copies[x] = copies.get(x, 0) + 1
                bins = min(stock.n[x] // c for x, c in copies.items())
                if not partners:
                    bins = stock.n[j]
                for x, c in copies.items():
                    stock.take(x, c * bins)
                fixed.append((copies, bins))
                changed = True
    # best fit by classes of equal containers: (room, contents as a linked list)
    rooms: list[int] = []
    classes: dict[int, list[list]] = {}

    def put(room: int, what: tuple, bins: int) -> None:
        if bins:
            if room not in classes:
                classes[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            classes[room].append([what, bins])

    for s in reversed(stock.sizes):
        n = stock.n[s]
        while n:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                what, bins = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    del rooms[i]
            else:
                room, what, bins = capacity, (), n  # new containers, as many as may be needed
            each = room // s
            full = min(bins, n // each)
            n -= full * each
            put(room - each * s, (s, each, what), full)
            bins -= full
            if bins and 0 < n < each:
                put(room - n * s, (s, n, what), 1)
                n, bins = 0, bins - 1
            if what:
                put(room, what, bins)
    out = list(fixed)
    for group in classes.values():
        for what, bins in group:
            copies = {}
            while what:
                s, c, what = what
                copies[s] = copies.get(s, 0) + c
            out.append((copies, bins))
    return out


def _pieces(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut each text into runs of whole characters that fill the capacity, counted as UTF-8 bytes and one end token."""
    for pdf in it:
        rows = []
        for doc, source, text, capacity in zip(pdf["doc_id"], pdf["source"], pdf["text"], pdf["capacity"]):
            raw, at, char, piece = text.encode(), 0, 0, 0
            room = max(4, capacity - 1)  # a character has up to four bytes
            while at < len(raw):
                end = min(at + room, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                n = len(raw[at:end].decode())
                rows.append((doc, source, piece, char, n, end - at + 1))
                at, char, piece = end, char + n, piece + 1
        yield pd.DataFrame(rows, columns=["doc_id", "source", "piece", "start_char", "n_chars", "tokens"])


def pack_documents(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """(source, container, doc_id, piece, start_char, n_chars, tokens, split): every non-empty text of a source with a capacity, once.

    A text's size is ``n_tokens``, or its UTF-8 bytes and one end token where that is null; a text above its source's
    capacity, and only that, is split at characters into pieces that fill containers and one rest. Containers are
    numbered from 0 in each source.

    Only the histogram of sizes, at most ``capacity`` rows a source, meets in one task; the plan that comes back is
    bounded by the capacity too. Texts never leave the scan. Items of equal size are numbered in parts with
    offsets, the more the more items there are, so one source or one size that holds most rows is spread, and each finds its container by that number.

    Edge cases: null and empty texts, null sources and sources without a capacity are left out; white space counts
    as text; rows with one ``doc_id`` are one text; capacities below 5 are raised to 5, one character and the end
    token; an empty table gives an empty result; other columns are ignored.
    """
    caps = specs.where("source is not null and capacity is not null").groupBy("source").agg(F.greatest(F.max("capacity"), F.lit(5)).cast("int").alias("capacity"))
    texts = (
        documents.select("doc_id", "source", "text", F.coalesce("n_tokens", F.octet_length("text") + 1).alias("tokens"))
        .where("doc_id is not null and text is not null and text <> ''")
        .join(caps, "source")
    )
    whole = texts.where("tokens <= capacity").select(
        "doc_id", "source", F.lit(0).alias("piece"), F.lit(0).alias("start_char"), F.char_length("text").alias("n_chars"), F.greatest("tokens", F.lit(1)).alias("tokens")
    )
    parts = texts.where("tokens > capacity").select("doc_id", "source", "text", "capacity").mapInPandas(
        _pieces, "doc_id bigint, source string, piece int, start_char int, n_chars int, tokens int"
    )
    items = whole.withColumn("split", F.lit(False)).unionByName(parts.withColumn("split", F.lit(True)))
    items = items.groupBy("doc_id", "piece").agg(*(F.min(c).alias(c) for c in ("source", "start_char", "n_chars", "tokens", "split")))
    items = cut(items)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(64, items.count() // PART_ROWS))).cast("int"))
    counts = items.groupBy("source", "tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, base, used = [], 0, {}
        for p, (copies, bins) in enumerate(pack_sizes(pdf["tokens"].to_numpy(), pdf["n"].to_numpy(), int(pdf["capacity"].iloc[0]))):
            for s, c in copies.items():
                at = used.get(s, 0)
                rows.append((pdf["source"].iloc[0], s, at, c, base))
                used[s] = at + bins * c
            base += bins
        return pd.DataFrame(rows, columns=["source", "tokens", "from", "copies", "base"])

    slots = (
        counts.groupBy("source", "tokens").agg(F.sum("n").alias("n")).join(caps, "source")
        .groupBy("source").applyInPandas(plan, "source string, tokens int, from bigint, copies int, base bigint").toPandas()
    ).sort_values(["source", "tokens", "from"])
    keys = {k: i for i, k in enumerate(dict.fromkeys(zip(slots["source"], slots["tokens"])))}
    start = np.array([keys[k] for k in zip(slots["source"], slots["tokens"])], dtype=np.int64) * (1 << 40) + slots["from"].to_numpy(np.int64)
    first, copies, base = (slots[c].to_numpy(np.int64) for c in ("from", "copies", "base"))

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            code = np.array([keys[k] for k in zip(pdf["source"], pdf["tokens"])], dtype=np.int64)
            at = np.searchsorted(start, code * (1 << 40) + pdf["ordinal"].to_numpy(np.int64), side="right") - 1
            pdf["container"] = base[at] + (pdf["ordinal"].to_numpy(np.int64) - first[at]) // copies[at]
            yield pdf[["source", "container", "doc_id", "piece", "start_char", "n_chars", "tokens", "split"]]

    row = F.row_number().over(Window.partitionBy("source", "tokens", "part").orderBy("doc_id", "piece")) - 1
    return (
        items.withColumn("row", row)
        .join(offsets, ["source", "tokens", "part"])
        .withColumn("ordinal", F.col("offset") + F.col("row"))
        .drop("part", "row", "offset")
        .mapInPandas(place, "source string, container bigint, doc_id bigint, piece int, start_char int, n_chars int, tokens int, split boolean")
    )

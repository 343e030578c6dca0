"""Frequent gapped subsequences over weighted sequence diagrams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.runtime import cut

CHUNK = 20_000  # distinct sequences in one diagram; the number of chunks grows with the data, their size does not
SLACK = 0.8  # what a chunk reports, as a part of the share that is asked for


class Diagram:
    """A shared directed acyclic graph of item sequences; a database is a set of weighted nodes of it.

    A node stands for a sequence: its first item and the node of the rest. Equal rests exist once, whatever stands
    before them, and the weights of equal sequences add up on their node. Nodes are numbered by length (0 is the empty
    sequence), so everything about all nodes is worked out a length at a time.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray, weights: np.ndarray, items: int) -> None:
        """``codes`` holds all sequences one after another, that of row i ends before ``ends[i]`` and has ``sizes[i]`` items."""
        at = np.zeros(len(sizes), np.int64)
        item, rest = [np.full(1, -1, np.int64)], [np.zeros(1, np.int64)]
        self.levels, total = [0, 1], 1
        for d in range(int(sizes.max(initial=0))):
            rows = np.flatnonzero(sizes > d)
            keys, node = np.unique(codes[ends[rows] - 1 - d] * total + at[rows], return_inverse=True)
            item.append(keys // total)
            rest.append(keys % total)
            at[rows] = node + total
            total += len(keys)
            self.levels.append(total)
        self.item, self.rest, self.items = np.concatenate(item), np.concatenate(rest), items
        self.after: dict[int, np.ndarray] = {}
        self.holds = np.zeros((total, items), np.float64)
        for a, b in zip(self.levels[1:], self.levels[2:]):
            self.holds[a:b] = self.holds[self.rest[a:b]]
            self.holds[np.arange(a, b), self.item[a:b]] = 1
        self.root = self._merged(at, weights.astype(np.float64))

    def _merged(self, nodes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.bincount(nodes, weights, len(self.item))
        kept = np.flatnonzero(sums)
        return kept, sums[kept]

    def extensions(self, base: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each item the weight of the sequences that hold it."""
        return base[1] @ self.holds[base[0]]

    def cond(self, base: tuple[np.ndarray, np.ndarray], x: int) -> tuple[np.ndarray, np.ndarray]:
        """The conditional diagram of x: what follows the first x in each sequence that has one."""
        if (after := self.after.get(x)) is None:
            after = self.after[x] = np.full(len(self.item), -1, np.int64)
            for a, b in zip(self.levels[1:], self.levels[2:]):
                after[a:b] = np.where(self.item[a:b] == x, self.rest[a:b], after[self.rest[a:b]])
        there = after[base[0]]
        return self._merged(there[there >= 0], base[1][there >= 0])

    def mine(self, base: tuple[np.ndarray, np.ndarray], least: float, longest: int, memo: dict) -> list[tuple[tuple[int, ...], int]]:
        """All patterns of at most ``longest`` items with support of ``least`` and more, with their support; equal databases are mined once."""
        key = (longest, xxhash.xxh3_128_digest(base[0].tobytes()), xxhash.xxh3_128_digest(base[1].tobytes()))
        if (r := memo.get(key)) is None:
            r = memo[key] = []
            support = self.extensions(base)
            for x in np.flatnonzero((support >= least) & (support > 0)).tolist():
                r.append(((x,), int(support[x])))
                if longest > 1:
                    r += [((x, *rest), s) for rest, s in self.mine(self.cond(base, x), least, longest - 1, memo)]
        return r

    def count(self, patterns: list[tuple[int, ...]]) -> list[int]:
        """The support of each pattern; patterns that start alike share their conditional diagrams."""
        memo: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {(): self.root}

        def of(p: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
            if (r := memo.get(p)) is None:
                r = memo[p] = self.cond(of(p[:-1]), p[-1])
            return r

        return [int(of(p)[1].sum()) for p in patterns]


def _diagram(chains: pa.Table, least: float, wanted: set[str] | None = None) -> tuple[Diagram, list[str]]:
    """The diagram of chains(chain, weight) over the items of ``wanted``, or else those with support of ``least``."""
    lists = chains.column("chain").combine_chunks()
    weights = chains.column("weight").to_numpy().astype(np.int64)
    named = lists.flatten().dictionary_encode()
    codes, sizes = named.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    names, n = named.dictionary.to_pylist(), max(1, len(named.dictionary))
    once = np.unique(row * n + codes)
    support = np.bincount(once % n, weights[once // n], n)
    kept = [i for i, x in enumerate(names) if (x in wanted if wanted is not None else support[i] >= least)]
    number = np.full(n, -1, np.int64)
    number[kept] = np.arange(len(kept))
    codes = number[codes]
    sizes = np.bincount(row[codes >= 0], minlength=len(sizes))
    return Diagram(codes[codes >= 0], np.cumsum(sizes), sizes, weights, len(kept)), [names[i] for i in kept]


def frequent_sequences(df: DataFrame, key: str, chain: Column, share: float, shortest: int, longest: int, sep: str = ">") -> DataFrame:
    """(pattern, support): item sequences that occur in order, gaps allowed, in ``share`` of the distinct keys or more.

    ``chain`` is an array of strings, already normalised; null and empty items are dropped, and only keys whose
    chain is then non-empty count. Rows of one key are one record. Equal chains are merged with their number.

    The distinct chains are dealt by hash into equal chunks of about CHUNK, so no chunk is short, however the rows lie
    in partitions, and no item's or group's conditional database is gathered in one task. Each chunk is compressed into
    one diagram (``Diagram``); conditional diagrams are pushed per prefix item, equal subproblems are solved once, and
    patterns with SLACK of the share in the chunk are reported with their support there. A pattern that is frequent
    over all is reported by some chunk, and what the others may hold of it is bounded, which rules out all but few that
    are not frequent. Those few are counted, in a second pass, only in the chunks that did not report them; so every
    support is exact. Nothing is sent to the driver but three sums.

    Edge cases: null keys are dropped; an empty table gives an empty result; chains of any length work.
    """
    clean = F.filter(chain, lambda x: x.isNotNull() & (x != ""))
    records = df.select(F.col(key).alias("k"), clean.alias("chain")).where("k is not null and size(chain) > 0").groupBy("k").agg(F.max("chain").alias("chain"))
    chains = cut(records.groupBy("chain").agg(F.count("*").alias("weight")))
    different, n = chains.agg(F.count("*"), F.sum("weight")).first()
    least, chunks = max(1, math.ceil(share * (n or 0) - 1e-9)), max(1, round(different / CHUNK))
    dealt = chains.select(F.pmod(F.xxhash64("chain"), F.lit(chunks)).cast("int").alias("chunk"), "chain", "weight")

    def mine(part: pa.Table) -> pa.Table:
        weight = int(part.column("weight").to_numpy().sum())
        floor = max(1, math.ceil(SLACK * share * weight - 1e-9))
        d, names = _diagram(part, floor)
        found = [(sep.join(names[x] for x in p), s) for p, s in d.mine(d.root, floor, longest, {}) if len(p) >= shortest]
        rows = [(part.column("chunk")[0].as_py(), p, s, floor - 1) for p, s in [(None, 0), *found]]  # the row without a pattern tells the chunk's floor
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["chunk", "pattern", "support", "missed"])

    local = cut(dealt.groupBy("chunk").applyInArrow(mine, "chunk int, pattern string, support bigint, missed bigint"))
    floors = local.where("pattern is null").agg(F.sum("missed")).first()[0] or 0
    sums = local.where("pattern is not null").groupBy("pattern").agg(F.sum("support").alias("support"), F.sum("missed").alias("missed"), F.count("*").alias("chunks"))
    possible = cut(sums.where(F.col("support") + floors - F.col("missed") >= least).select("pattern", "support", "chunks"))
    known = possible.select("pattern", "support")
    absent = possible.where(F.col("chunks") < chunks).select("pattern", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    absent = cut(absent.join(local.select("pattern", "chunk"), ["pattern", "chunk"], "left_anti"))
    if not absent.isEmpty():

        def count(part: pa.Table, asked: pa.Table) -> pa.Table:
            patterns = asked.column("pattern").to_pylist()
            if not len(part) or not patterns:
                return pa.table({"pattern": pa.array([], pa.string()), "support": pa.array([], pa.int64())})
            split = [p.split(sep) for p in patterns]
            d, names = _diagram(part, 0, {x for p in split for x in p})
            number = {x: i for i, x in enumerate(names)}
            rows = [(p, tuple(number[x] for x in s)) for p, s in zip(patterns, split) if all(x in number for x in s)]
            return pa.table({"pattern": pa.array([p for p, _ in rows], pa.string()), "support": pa.array(d.count([s for _, s in rows]), pa.int64())})

        some = dealt.join(absent.select("chunk").distinct(), "chunk", "left_semi")
        more = some.groupBy("chunk").cogroup(absent.groupBy("chunk")).applyInArrow(count, "pattern string, support bigint")
        known = known.unionByName(more).groupBy("pattern").agg(F.sum("support").alias("support"))
    return known.where(F.col("support") >= least)

"""Most similar vectors of every vector: a forest of random-projection trees, one shared priority queue, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.runtime import cut

SAMPLE_LEAST, SAMPLE_MOST = 4096, 200_000  # vectors that the split planes are fitted on
LEAF_SAMPLE = 8  # sample vectors for each leaf, so the sample's size follows the table's up to SAMPLE_MOST
ROUNDING = 2e-6  # what a cosine of single precision may be off by
MERGE_DIGITS = 6  # vectors whose unit vectors agree to so many digits are one in the search
BLOCK = 1 << 22  # products held at once


@dataclass
class Forest:
    """Planes of all trees. ``kids`` holds inner nodes as numbers from 0 and leaves as ~leaf."""

    planes: np.ndarray
    offsets: np.ndarray
    kids: np.ndarray
    roots: np.ndarray
    leaves: int


def _plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.float32] | None:
    """The plane between two random points after a few moves to their sides' centres; None if all points are one."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(3):
        side = x @ (a - b) > (a @ a - b @ b) / 2
        if side.all() or not side.any():
            break
        a, b = x[side].mean(0), x[~side].mean(0)
    v = a - b
    size = np.linalg.norm(v)
    return (v / size, ((a + b) @ v) / 2 / size) if size > 1e-6 else None


def fit_forest(x: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
    """Random-projection trees over the rows of ``x``, split until a node holds at most ``leaf`` of them."""
    rng = np.random.default_rng(seed)
    planes, offsets, kids, roots, leaves = [], [], [], [], 0
    for _ in range(trees):
        todo = [(np.arange(len(x)), -1, 0)]
        first = len(planes)
        while todo:
            rows, parent, side = todo.pop()
            split = None
            for _ in range(8 if len(rows) > leaf else 0):
                if (p := _plane(x[rows], rng)) is not None:
                    right = x[rows] @ p[0] > p[1]
                    if 0.05 < right.mean() < 0.95:
                        split = p
                        break
                    split = split or (p if right.any() and not right.all() else None)
            if split is None:
                me = ~leaves
                leaves += 1
            else:
                me = len(planes)
                planes.append(split[0])
                offsets.append(split[1])
                kids.append([0, 0])
                right = x[rows] @ split[0] > split[1]
                todo += [(rows[~right], me, 0), (rows[right], me, 1)]
            if parent >= 0:
                kids[parent][side] = me
            elif me < 0:  # a tree of one leaf
                roots.append(me)
        if len(planes) > first:
            roots.append(first)
    dim = x.shape[1]
    return Forest(np.array(planes, np.float32).reshape(-1, dim), np.array(offsets, np.float32), np.array(kids, np.int64).reshape(-1, 2), np.array(roots, np.int64), leaves)


def route(forest: Forest, x: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` best leaves of each row over all trees, best first; the first ones are each tree's own leaf.

    One priority queue serves all trees: a node's priority is the smallest margin on the way to it, negative where the
    way crossed a plane. As the near child keeps its parent's priority, at each level only the best ``probes`` nodes
    can lead to one of the best ``probes`` leaves, so the queue of every row is worked off level by level.
    """
    n, t = len(x), len(forest.roots)
    probes = max(probes, t)
    node = np.repeat(forest.roots[None], n, 0)
    prio = np.full((n, t), np.inf, np.float32)
    dense = x @ forest.planes.T - forest.offsets if 0 < len(forest.planes) <= 4096 else None
    while (inner := node >= 0).any():
        at = np.where(inner, node, 0)
        if dense is not None:
            m = np.take_along_axis(dense, at, 1)
        else:
            m = np.einsum("npd,nd->np", forest.planes[at], x) - forest.offsets[at]
        near = (m > 0).astype(np.int64)
        size = np.abs(m)
        node = np.concatenate([np.where(inner, forest.kids[at, near], node), np.where(inner, forest.kids[at, 1 - near], -1)], 1)
        prio = np.concatenate([np.where(inner, np.minimum(prio, size), prio), np.where(inner, np.minimum(prio, -size), -np.inf)], 1)
        if node.shape[1] > probes:
            best = np.argpartition(-prio, probes - 1, axis=1)[:, :probes]
            node, prio = np.take_along_axis(node, best, 1), np.take_along_axis(prio, best, 1)
    order = np.argsort(-prio, axis=1, kind="stable")
    leaf = np.take_along_axis(~node, order, 1)
    return np.where(np.isneginf(np.take_along_axis(prio, order, 1)), -1, leaf)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return x.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(np.float32).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near(
    q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, least: float, keep: int, rng: np.random.Generator, biggest: int, out: list,
    q_off: np.ndarray | None = None, x_off: np.ndarray | None = None, tie: float = 0.0, same: bool = True,
) -> None:
    """Appends (query rows, index rows) of all that may be among the best ``keep`` per query of ``least`` and more; splits what is larger than ``biggest``.

    ``q_off`` and ``x_off`` are the angles that the rows may be off by; cosines within ``tie`` count as equal. Two
    vectors that reach ``least`` are at most a known distance apart, so a query searches both sides of every plane
    that is no farther than that. ``same``: both sides are numbered alike, and a row is no candidate of its own.
    """
    if not len(qi) or not len(xi):
        return
    q_off = np.zeros(len(q), np.float32) if q_off is None else q_off
    x_off = np.zeros(len(x), np.float32) if x_off is None else x_off
    widest = np.arccos(np.clip(least - tie, -1, 1)) + float(q_off[qi].max()) + float(x_off[xi].max())
    if len(xi) > biggest and (p := _plane(x[xi], rng)) is not None:
        right, m = x[xi] @ p[0] > p[1], q[qi] @ p[0] - p[1]
        spill = 2 * np.sin(min(widest, np.pi) / 2) + ROUNDING
        if 0.02 < right.mean() < 0.98:
            for own, there in ((m > -spill, right), (m < spill, ~right)):
                _near(q, x, qi[own], xi[there], least, keep, rng, biggest, out, q_off, x_off, tie, same)
            return
    floor = np.cos(min(widest, np.pi)) - ROUNDING
    step = max(1, BLOCK // len(xi))
    for a in range(0, len(qi), step):
        rows = qi[a : a + step]
        s = q[rows] @ x[xi].T
        i, j = np.nonzero(s >= floor)
        if same:
            i, j = (c[rows[i] != xi[j]] for c in (i, j))
        angle, off = np.arccos(np.clip(s[i, j], -1, 1)), q_off[rows[i]] + x_off[xi[j]]
        low, high = np.cos(np.minimum(angle + off, np.pi)) - ROUNDING, np.cos(np.maximum(angle - off, 0)) + ROUNDING
        order = np.lexsort((-low, i))
        i, j, low, high = i[order], j[order], low[order], high[order]
        last = np.searchsorted(i, i, side="left") + keep - 1  # where the query's last of the best would stand
        there = np.minimum(last, max(0, len(i) - 1))
        bar = np.where((last < len(i)) & (i[there] == i), low[there] - tie, -np.inf)
        top = (high >= bar) & (high >= least - tie)
        out.append((rows[i[top]], xi[j[top]]))


def _direction(v: Column, digits: int = MERGE_DIGITS) -> Column:
    """The unit vector to ``digits`` digits, as whole numbers."""
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  a value that a lambda only names would be made again for every element
    size = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    over = lambda d, n: once(F.struct(d.alias("d"), n.alias("n")), lambda r: F.transform(r["d"], lambda x: x / r["n"]))
    small = once(F.transform(v, lambda x: x.cast("double")), lambda d: over(d, F.array_max(F.transform(d, F.abs))))
    return F.transform(once(small, lambda d: over(d, size(d))), lambda x: F.round(x * 10**digits).cast("bigint"))


def equal_groups(df: DataFrame, uid: str, vec: str, at: str, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(directions(id, vec, h, merged), vectors(id, vid, vec), members(id, vid, uid)): the latest row of each uid, if its vector is sound, by equal vectors, and these by direction."""
    v = F.col(vec)
    sound = F.coalesce(
        (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = df.select(F.col(uid).alias("uid"), F.col(at).alias("at"), v.alias("vec"), F.xxhash64(v).alias("h"), F.xxhash64(v, F.lit(7)).alias("h2"), sound.alias("sound")).where("uid is not null")
    latest = rows.groupBy("uid").agg(F.max(F.struct("at", "sound", "h", "h2")).alias("r")).select("uid", "r.*").where("sound")
    members = cut(latest.select("uid", "h", "h2"))
    kept = members.select("h", "h2").distinct()
    vectors = rows.where("sound").groupBy("h", "h2").agg(F.first("vec").alias("vec")).join(kept, ["h", "h2"], "left_semi")
    way = F.transform(F.array(_direction(F.col("vec"))), lambda w: F.struct(F.xxhash64(w).alias("d"), F.xxhash64(w, F.lit(7)).alias("d2")))[0]
    vectors = cut(vectors.withColumn("vid", F.monotonically_increasing_id()).withColumn("way", way).select("h", "h2", "vec", "vid", "way.d", "way.d2"))
    several = cut(vectors.groupBy("d", "d2").agg(F.min("vid").alias("id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    named = vectors.join(several, ["d", "d2"], "left").withColumn("merged", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", "vid"))
    return named.where("id = vid").select("id", "vec", "h", "merged"), named.where("merged").select("id", "vid", "vec"), members.join(named.select("h", "h2", "id", "vid"), ["h", "h2"]).select("id", "vid", "uid")


def candidate_pairs(vectors: DataFrame, least: float, trees: int, probes: int, leaf: int, seed: int = 7, k: int = 5, tie: float = 1.1e-4) -> DataFrame:
    """(i, j) with i < j: pairs of ids that meet in a probed leaf and may, by their codes, have a cosine of ``least`` and be among either's best ``k`` there or tie with them."""
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "i bigint, j bigint")
    want = int(min(SAMPLE_MOST, max(SAMPLE_LEAST, LEAF_SAMPLE * n / leaf)))
    part = vectors if n <= want else vectors.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1, 1.2 * want / n)))
    sample = _unit(_matrix(part.orderBy("h").limit(want).select("vec").toArrow().column(0)))
    forest = spark.sparkContext.broadcast(fit_forest(sample, trees, max(2, int(leaf * len(sample) / n)), seed))
    dim = sample.shape[1]
    body = np.dtype([("id", "<i8"), ("scale", "<f4"), ("off", "<f4"), ("home", "u1"), ("code", "i1", (dim,))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("vec")))
            leaves = route(f, x, probes)
            rec = np.zeros(len(x), body)
            rec["id"] = batch.column("id").to_numpy()
            top = np.abs(x).max(1)
            rec["scale"] = top / 127
            rec["code"] = np.rint(x / top[:, None] * 127)
            apart = np.linalg.norm(x - _unit(rec["code"].astype(np.float32)), axis=1)
            rec["off"] = 2 * np.arcsin(np.minimum(apart / 2, 1)) + ROUNDING
            for p in range(leaves.shape[1]):
                ok = leaves[:, p] >= 0
                rec["home"] = p < trees
                raw = rec[ok].tobytes()
                size = body.itemsize
                at = pa.py_buffer(np.arange(0, len(raw) + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(leaves[ok, p].astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(raw) // size, [None, at, pa.py_buffer(raw)])], names=["leaf", "body"])

    def search(group: pa.Table) -> pa.Table:
        rec = np.frombuffer(b"".join(group.column("body").to_pylist()), body)
        x = rec["code"].astype(np.float32) * rec["scale"][:, None]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        _near(x, x, np.arange(len(x)), np.flatnonzero(rec["home"]), least, k, np.random.default_rng(seed), 4 * leaf, out, rec["off"], rec["off"], tie)
        i, j = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), ())))
        a, b = rec["id"][i], rec["id"][j]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        return pa.table({"i": pa.array(pairs[:, 0], pa.int64()), "j": pa.array(pairs[:, 1], pa.int64())})

    return vectors.select("id", "vec").mapInArrow(spread, "leaf int, body binary").groupBy("leaf").applyInArrow(search, "i bigint, j bigint").distinct()


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double arithmetic."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_vectors(
    df: DataFrame, uid: str, vec: str, at: str, k: int, dim: int, least: float, digits: int = 4, trees: int = 3, probes: int = 5, leaf: int = 1000
) -> DataFrame:
    """(uid, neighbour, cosine): for every vector the ``k`` others of highest cosine (rounded to ``digits``), those of ``least`` and more.

    Equal cosines go by smaller uid. All vectors are indexed and all are queries. The forest's planes are fitted on a
    sample of at most SAMPLE_MOST vectors, picked by hash. Each vector goes to its own leaf of every tree and, as a
    query, to the ``probes`` best leaves of all trees together; what a leaf's one-byte codes cannot rule out of the
    best ``k`` is then scored exactly on the full vectors. A leaf larger than four times ``leaf`` is split further in
    its task. Vectors of one direction, whatever their lengths, are one in the search, so a direction that a third of
    the rows share is searched once; each of its rows gets its neighbours from the shared list of k + 1. Only where
    the rounded cosine of two directions hangs on which of their vectors is taken are these scored one by one. The
    result is approximate in one way: a pair is missed if its two ends share no probed leaf (recall in the README).
    Vectors that are close but not of one direction are scored pair by pair where their codes tie.

    Edge cases: of a uid only the latest row counts; null uids, and vectors that are null, all zero, not finite, hold
    nulls or are not of length ``dim``, count nowhere; an empty table gives an empty result; other columns are ignored.
    """
    directions, vectors, members = equal_groups(df, uid, vec, at, dim)
    members = cut(members)
    half = 0.5 * 10**-digits
    slack = np.sqrt(dim) * 10.0**-MERGE_DIGITS  # how far the vectors of a direction may be apart
    pairs = candidate_pairs(directions, least, trees, probes, leaf, k=k, tie=2 * (half + 2 * slack))
    left, right = (directions.select(F.col("id").alias(i), F.col("vec").alias(a), F.col("merged").alias(m)) for i, a, m in (("i", "a", "m"), ("j", "b", "n")))
    c, off = cosine(F.col("a"), F.col("b")), slack * (F.col("m").cast("int") + F.col("n").cast("int"))
    scored = pairs.join(left, "i").join(right, "j").withColumn("c", c).withColumn("off", off).where(F.col("c") + F.col("off") >= least - half)
    scored = scored.withColumn("clear", F.round(F.col("c") - F.col("off"), digits) == F.round(F.col("c") + F.col("off"), digits))
    scored = cut(scored.select("i", "j", "clear", F.round("c", digits).alias("cos"), *(F.when(~F.col("clear"), F.col(x)).alias(x) for x in ("a", "b"))))
    own = lambda i, v, x: vectors.select(F.col("id").alias(i), F.col("vid").alias(v), F.col("vec").alias(x))
    each = scored.where("not clear").join(own("i", "vi", "va"), "i", "left").join(own("j", "vj", "vb"), "j", "left")
    each = each.select(F.coalesce("vi", "i").alias("i"), F.coalesce("vj", "j").alias("j"), F.round(cosine(F.coalesce("va", "a"), F.coalesce("vb", "b")), digits).alias("cos"))
    several = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("other"), F.lit(1.0).alias("cos"))

    def lists(pairs: DataFrame, by: str, name: str) -> DataFrame:
        """(by, name): the best k + 1 rows (-cosine, neighbour) over the pairs of ids ``by``."""
        few = members.withColumn("row", F.row_number().over(Window.partitionBy(by).orderBy("uid"))).where(F.col("row") <= k + 1)
        near = pairs.where(F.col("cos") >= least).join(few.select(F.col(by).alias("other"), F.col("uid").alias("neighbour")), "other")
        ranked = near.withColumn("row", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "neighbour"))).where(F.col("row") <= k + 1)
        return ranked.groupBy(F.col("id").alias(by)).agg(F.collect_list(F.struct((-F.col("cos")).alias("o"), "neighbour")).alias(name))

    both = lambda p: p.select(F.col("i").alias("id"), F.col("j").alias("other"), "cos").unionByName(p.select(F.col("j").alias("id"), F.col("i").alias("other"), "cos"))
    shared, alone = lists(both(scored.where("clear")).unionByName(several), "id", "shared"), lists(both(each), "vid", "alone")
    none = F.array().cast("array<struct<o:double,neighbour:string>>")
    near = F.array_sort(F.filter(F.concat(F.coalesce("shared", none), F.coalesce("alone", none)), lambda x: x["neighbour"] != F.col("uid")))
    best = members.join(shared, "id", "left").join(alone, "vid", "left").select("uid", F.slice(near, 1, k).alias("list"))
    return best.select(F.col("uid").alias(uid), F.inline("list")).select(uid, "neighbour", (-F.col("o")).alias("cosine"))
